"""Gloss expansion: phrases of a table found in texts, longest first, each word used once; then words less an ending."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..plans.session import cut, ship

#: Words of the longest phrase.
LONGEST = 4
#: Bits that travel for a table of phrases: so many a phrase, and at most.
BITS_A_PHRASE, BITS_MOST = 32, 1 << 27
#: Words of texts that a task looks at at once.
WORD_STEP = 500_000


def words(text: Column, pattern: str = "[^\\s.,;:!?()\"]+") -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), F.lower)


def stems(word: Column, endings: tuple[str, ...]) -> Column:
    """The word less each ending of the list that leaves two characters or more, in the list's order."""
    ends = F.array(*map(F.lit, endings))
    fits = F.filter(ends, lambda e: F.endswith(word, e) & (F.length(word) > F.length(e) + 1))
    return F.transform(fits, lambda e: F.substring(word, F.lit(1), F.length(word) - F.length(e)))


def _hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words), np.uint64)


def _longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs with one word more."""
    return run * np.uint64(0x9E3779B97F4A7C15) + word


def _slots(run: np.ndarray, n_bits: int) -> np.ndarray:
    x = run ^ (run >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) & np.uint64(n_bits - 1)


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases of a table, of bounded size at any size of the table. What it admits meets the table itself."""
    n_bits = 1 << max(min(phrases.count() * BITS_A_PHRASE, BITS_MOST) - 1, 1023).bit_length()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [p.split(" ") for p in batch.column(0).to_pylist() if p is not None]
            sizes = np.array([len(w) for w in said], np.int64)
            flat, start = _hashes([v for w in said for v in w]), np.cumsum(sizes) - sizes
            run = np.zeros(len(said), np.uint64)
            for k in range(int(sizes.max(initial=0))):
                on = sizes > k
                run[on] = _longer(run[on], flat[start[on] + k])
            yield pa.RecordBatch.from_arrays([pa.array([_slots(run, n_bits).astype(np.uint32).tobytes()], pa.binary())], ["at"])

    bits = np.zeros(n_bits >> 3, np.uint8)
    ship(phrases.sparkSession)
    for r in phrases.mapInArrow(task, "at binary").toLocalIterator():
        at = np.frombuffer(r.at, np.uint32)
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits


def phrases_said(texts: DataFrame, key: str, said: list[Column], table: DataFrame, endings: tuple[str, ...] = (), longest: int = LONGEST) -> DataFrame:
    """Rows of `table` (phrase, ...; phrases are distinct) with (q, rank, at, n): runs of up to `longest` words of the lists `said` that it holds, and words less an ending.

    rank is -n of a run and the ending's place of a stem. A run that the table's bits rule out is never written: what is shuffled grows
    with what texts and table share, not with the words of the texts. Neither side is searched or broadcast.
    """
    bits = _bitmap(table.select("phrase"))
    sent, n_bits = texts.sparkSession.sparkContext.broadcast(bits), len(bits) << 3
    ship(texts.sparkSession)

    def held(run: np.ndarray) -> np.ndarray:
        at = _slots(run, n_bits)
        return (sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def shorter(word: str) -> list[str]:
        return [word[: -len(e)] for e in endings if len(word) > len(e) + 1 and word.endswith(e)]

    def found(ids: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        text, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left, word = np.repeat(sizes, sizes) - at, _hashes(known)[code] if known else np.zeros(0, np.uint64)
        run, out = np.zeros(len(code), np.uint64), []
        for n in range(1, longest + 1):
            run = _longer(run[: len(code) - n + 1], word[n - 1 :]) if n <= len(code) else run[:0]
            hit = np.flatnonzero(held(run) & (left[: len(run)] >= n))
            out.append((text[hit], np.full(len(hit), -n), at[hit] + 1, np.full(len(hit), n), [" ".join(known[c] for c in code[i : i + n]) for i in hit.tolist()]))
        stem = [shorter(w) for w in known] if endings else []
        flat = [v for s in stem for v in s]
        if flat:
            sound = held(_longer(np.zeros(len(flat), np.uint64), _hashes(flat))).tolist()
            good, lo = {}, 0
            for c, s in enumerate(stem):
                if keep := [(k, v) for k, v in enumerate(s, 1) if sound[lo + k - 1]]:
                    good[c] = keep
                lo += len(s)
            hit = np.flatnonzero(np.isin(code, np.fromiter(good, np.int64)))
            rows = [(i, k, v) for i in hit.tolist() for k, v in good[code[i]]]
            i = np.array([r[0] for r in rows], np.int64)
            out.append((text[i], np.array([r[1] for r in rows], np.int64), at[i] + 1, np.ones(len(rows), np.int64), [r[2] for r in rows]))
        cols = [np.concatenate([o[c] for o in out]) for c in range(4)]
        ints = [pa.array(c.astype(np.int32)) for c in cols[1:]]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), *ints, pa.array([p for o in out for p in o[4]], pa.string())], ["q", "rank", "at", "n", "phrase"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(1, batch.num_columns):
                lo, ends = 0, batch.column(c).offsets.to_numpy()
                while lo < len(batch):
                    hi = max(int(np.searchsorted(ends, ends[lo] + WORD_STEP, side="right")) - 1, lo + 1)
                    yield found(batch.column(0).slice(lo, hi - lo), batch.column(c).slice(lo, hi - lo))
                    lo = hi

    src = texts.select(F.col(key).alias("q"), *(w.alias(f"w{i}") for i, w in enumerate(said)))
    kind = src.schema["q"].dataType.simpleString()
    return src.mapInArrow(task, f"q {kind}, rank int, at int, n int, phrase string").join(table, "phrase")


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, hits) with the hits that count, in turn: phrases by length, then by place; stems by place, then by ending."""
    order = lambda x: (True, x["at"], x["rank"]) if x["rank"] > 0 else (False, x["rank"], x["at"])
    for batch in batches:
        row, turn, kept = [], [], []
        for i, hits in enumerate(batch.column(1).to_pylist()):
            used: set[int] = set()
            n = 0
            for x in sorted(hits, key=order):
                places = range(x["at"], x["at"] + x["n"])
                if used.isdisjoint(places):
                    used.update(places)
                    row.append(i)
                    turn.append(n)
                    kept.append(x)
                    n += 1
        cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(turn, pa.int32()), pa.array([x["phrase"] for x in kept], pa.string()), pa.array([x["at"] for x in kept], pa.int32()), pa.array([x["gloss"] for x in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["q", "turn", "phrase", "at", "gloss"])


def glosses(texts: DataFrame, key: str, text: Column, table: DataFrame, endings: tuple[str, ...], longest: int = LONGEST) -> DataFrame:
    """(key, turn, phrase, at, gloss): what a text's words mean by `table` (phrase, gloss), of any size.

    Runs of up to `longest` words meet the table by equality (``phrases_said``). Of those that
    share a word the longer one counts, of equally long ones the first. A word that no phrase used is then tried without
    each ending in turn; the first that the table holds counts, whole words going before it. Of several rows of a phrase the
    least gloss counts. A text's hits are gathered in one row. Texts without a hit have no row.
    """
    entries = cut(table.groupBy("phrase").agg(F.min("gloss").alias("gloss")))
    found = phrases_said(texts, key, [words(text)], entries, endings, longest)
    hits = found.groupBy("q").agg(F.collect_list(F.struct("rank", "at", "n", "phrase", "gloss")).alias("hits"))
    kind = hits.schema["q"].dataType.simpleString()
    return hits.mapInArrow(_taken, f"q {kind}, turn int, phrase string, at int, gloss string").withColumnRenamed("q", key)


def said_runs(text: Column, longest: int = LONGEST) -> Column:
    """Every run of up to `longest` words of a text; a text shorter than a run has none of its length."""
    sizes = F.array(*(F.lit(n) for n in range(1, longest + 1)))
    run = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return once(words(text), lambda w: F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.size(w)), lambda n: run(w, n))))


def expand(texts: DataFrame, key: str, text: str, table: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """texts with `expanded`, the text and after it the glosses of its words, phrases by length first, unchanged without any; and `n_glosses`, how many."""
    g = glosses(texts, key, F.col(text), table, endings).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "gloss"))).alias("_hits"))
    hits = g.select(key, F.array_join(F.transform("_hits", lambda x: x["gloss"]), " ").alias("_said"), F.size("_hits").alias("_n"))
    return texts.join(hits, key, "left").withColumn("expanded", F.concat_ws(" ", text, "_said")).withColumn("n_glosses", F.coalesce("_n", F.lit(0)).cast("long")).drop("_said", "_n")
