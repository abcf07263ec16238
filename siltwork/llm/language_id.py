"""Language identification by bit-sliced Bloom filters: one lookup gives the languages that contain an n-gram."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, buffers, cut, lean, mix64, small_batches, steps, U64

#: Lengths of the n-grams over a word's letters with a mark on either side.
ORDERS = (1, 2, 3, 4, 5)
#: A language contains an n-gram that makes up this share of its n-grams of that length, so at most 1 / RATE of a length.
RATE = 2e-5
#: Slots of a language's filter and places of an n-gram in it. With at most 5 / RATE n-grams 0.3 of the bits are set.
SLOTS, PLACES = 1 << 21, 3
#: Languages that one broadcast filter tells apart; more than these are an error, since a mask would have no bound.
LANGUAGES = 1024
UNKNOWN = "und"
_STEP = 1 << 20
_SALT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: belongs to a word (letter or mark), is a letter, lower case (where that is one code point)."""
    if not _TABLES:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        word, letter = np.array([k in "LM" for k in kinds]), np.array([k == "L" for k in kinds])
        low = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(letter).tolist():
            if len(x := chr(c).lower()) == 1:
                low[c] = ord(x)
        _TABLES.extend((word, letter, low))
    return tuple(_TABLES)


class Words:
    """The words of a run of texts: which text each is in, and every distinct word once."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        word, letter, low = tables()
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        # code points before each byte place: those bytes that do not go on with a character
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        at, n = before[offs], len(points)
        self.points, inside = low[points], word[points]
        self.has_letter = np.diff(np.concatenate(([0], np.cumsum(letter[points])))[at]) > 0
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        prev, nxt = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
        self.start = np.flatnonzero(inside & (~prev | edge[:-1])) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(inside & (~nxt | edge[1:])) + 1 if n else np.zeros(0, np.int64)
        self.row = np.searchsorted(at, self.start, side="right") - 1
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((self.points.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        self.key = mix64((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def letters(self, k: int) -> str:
        return self.points[self.start[k] : self.end[k]].tobytes().decode("utf-32-le")


def grams(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hash, word) of every n-gram of the given words, each with a mark before and after it."""
    if not len(start):
        return
    size = end - start + 2
    base = np.concatenate(([0], np.cumsum(size)))
    stream = np.zeros(base[-1], U64)
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(base[-1]) - base[word]
    body = (inner > 0) & (inner < size[word] - 1)
    stream[body] = points[start[word[body]] + inner[body] - 1].astype(U64) + U64(1)
    h = np.zeros(base[-1], U64)
    for n in range(1, max(ORDERS) + 1):
        h = mix64(h[: len(stream) - n + 1] * U64(0x9FB21C651E98DF25) + stream[n - 1 :] + U64(n))
        if not len(h):
            return
        if n in ORDERS:
            fits = inner[: len(h)] + n <= size[word[: len(h)]]
            if n == 1:
                fits = fits & body[: len(h)]
            yield n, h[fits], word[: len(h)][fits]


def places(h: np.ndarray) -> list[np.ndarray]:
    return [(mix64(h ^ U64(s)) & U64(SLOTS - 1)).astype(np.int64) for s in _SALT[:PLACES]]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, count), each distinct word of a step once."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        data, offs = buffers(batch.column("text"))
        for i, j in steps(offs, _STEP):
            w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            names = sorted(set(langs[i:j]))
            code = np.array([names.index(x) for x in langs[i:j]], U64)[w.row] if len(w.row) else np.zeros(0, U64)
            _, first, count = np.unique(mix64(w.key + code * U64(0xD6E8FEB86659FD93)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([names[int(code[k])] for k in first], pa.string()), "word": pa.array([w.letters(k) for k in first], pa.string()), "count": pa.array(count, pa.int64())})


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram, count) of distinct words with their counts."""
    for batch in batches:
        langs, counts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("count").to_numpy(zero_copy_only=False)
        data, offs = buffers(batch.column("word"))
        for i, j in steps(offs, _STEP):
            points = np.frombuffer(data[offs[i] : offs[j]].tobytes().decode().encode("utf-32-le"), np.uint32)
            before = np.concatenate(([0], np.cumsum((data[offs[i] : offs[j]] & 0xC0) != 0x80)))
            at = before[offs[i : j + 1] - offs[i]]
            names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
            for n, h, word in grams(points, at[:-1], at[1:]):
                by = np.lexsort((h, code[word]))
                h, c, k = h[by], code[word][by], counts[i:j][word][by]
                if not len(h):
                    continue
                first = np.flatnonzero(np.concatenate(([True], (np.diff(h) != 0) | (np.diff(c) != 0))))
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array(names[c[first]].tolist(), pa.string()), "size": pa.array(np.full(len(first), n), pa.int32()), "gram": pa.array(h[first].view(np.int64)), "count": pa.array(np.add.reduceat(k, first), pa.int64())}
                )


def _filter(pdf: pd.DataFrame) -> pd.DataFrame:
    """One language's filter; it has at most len(ORDERS) / RATE n-grams."""
    bits = np.zeros(SLOTS, bool)
    for p in places(pdf["gram"].to_numpy().view(U64)):
        bits[p] = True
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})


class Filters:
    """Bit-sliced filters: one mask of languages a slot, in the narrowest words that hold them."""

    def __init__(self, found: list[tuple[str, bytes]]):
        self.langs = [k for k, _ in found]
        width = next(w for w in (8, 16, 32, 64) if len(found) <= w or w == 64)
        self.width, kind = width, np.dtype(f"u{width // 8}")
        self.masks = np.zeros((max(1, -(-len(found) // width)), SLOTS), kind)
        self.false = np.zeros(len(found))
        for k, (_, packed) in enumerate(found):
            bits = np.unpackbits(np.frombuffer(packed, np.uint8))
            self.masks[k // width] |= bits.astype(kind) << kind.type(k % width)
            self.false[k] = bits.mean() ** PLACES

    def hits(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By word: number of n-grams, and of those each language contains (languages x words)."""
        total, found = np.zeros(len(start), np.int64), np.zeros((len(self.langs), len(start)), np.int64)
        for _, h, word in grams(points, start, end):
            total += np.bincount(word, minlength=len(start))
            at = places(h)
            for b, slots in enumerate(self.masks):
                mask = slots[at[0]]
                for p in at[1:]:
                    mask &= slots[p]
                for k in range(b * self.width, min((b + 1) * self.width, len(self.langs))):
                    found[k] += np.bincount(word[(mask >> mask.dtype.type(k % self.width) & mask.dtype.type(1)).astype(bool)], minlength=len(start))
        return total, found

    def decide(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and corrected share of each text."""
        w = Words(data, offs)
        _, first, of = np.unique(w.key, return_index=True, return_inverse=True)
        total, found = self.hits(w.points, w.start[first], w.end[first])
        rows = len(offs) - 1
        n = np.bincount(w.row, weights=total[of], minlength=rows)
        share = np.zeros((len(self.langs), rows))
        for k in range(len(self.langs)):
            seen = np.bincount(w.row, weights=found[k][of], minlength=rows) / np.maximum(n, 1)
            # of the n-grams that a language lacks, a known part seems to be there
            share[k] = (seen - self.false[k]) / (1 - self.false[k]) if self.false[k] < 1 else 0.0
        known = w.has_letter & bool(self.langs)
        best = share.argmax(0) if self.langs else np.zeros(rows, np.int64)
        score = np.clip(share[best, np.arange(rows)], 0, 1) if self.langs else np.zeros(rows)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def learn(texts: DataFrame) -> Filters:
    """Filters of the languages of `texts` (lang, text): words are counted first, n-grams over distinct words."""
    spark = texts.sparkSession
    small_batches(spark)
    words = texts.mapInArrow(lean(_count_words), "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))
    counted = cut(words.mapInArrow(lean(_count_grams), "lang string, size int, gram long, count long").groupBy("lang", "size", "gram").agg(F.sum("count").alias("count")))
    totals = counted.groupBy("lang", "size").agg(F.sum("count").alias("total"))
    some = totals.select("lang").distinct().limit(LANGUAGES + 1).count()
    if some > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # totals: LANGUAGES * len(ORDERS) rows at most
    kept = counted.join(F.broadcast(totals), ["lang", "size"]).where(F.col("count") >= RATE * F.col("total")).select("lang", "gram")
    found = kept.groupBy("lang").applyInPandas(_filter, "lang string, bits binary").collect()
    return Filters(sorted((r.lang, bytes(r.bits)) for r in found))


def language_id(docs: DataFrame, parts: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by filters learned from rows that are not held out.

    A row is held out where `parts` divides the CRC-32 of the decimal doc_id; a null id has held_out null and teaches
    nothing, nor does a null lang. Words are runs of letters and marks in lower case, n-grams lie within a word and its
    two marks. Score is the best language's share of the text's n-grams, freed of the false positives that the filter's
    fill predicts; equal shares go to the language that comes first. `und` with score 0: null or empty text, text
    without a letter, or nothing learned. Rows that repeat are judged, and teach, each time. Other columns take no part.
    """
    small_batches(docs.sparkSession)
    part = F.expr(f"crc32(cast(doc_id as string)) % {parts}")
    filters = docs.sparkSession.sparkContext.broadcast(learn(docs.where((part != 0) & F.col("lang").isNotNull()).select("lang", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            said, scores = [], []
            for i, j in steps(offs, _STEP):
                got, score = filters.value.decide(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                said += got
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(said, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (part == 0).alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")
