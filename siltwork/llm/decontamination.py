"""Benchmark decontamination: seeds that miss nothing, CGK embedding and bit-sampling LSH, then exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, small_batches, U64

#: Edits allowed, as a share of the item's length.
EDIT_SHARE = 0.2
#: Characters of a seed, at least and at most, and bits of a seed table's slots.
MIN_SEED, MAX_SEED, SLOT_BITS = 2, 7, 18
#: An item with ``most`` edits is cut into most // 2 + 1 pieces, of which one has one edit at most, so a half of that piece
#: has none. Of a group of g pieces within 2 g - 1 edits one part of it is so, too: pairs, fours and eights are looked
#: at in turn, and none that the item's edits allow is passed over. Pieces of a group; begins looked at together.
GROUPS = ((2, 4), (4, 8), (8, 16))
#: Characters of text taken in one step.
STEP_CHARS = 1 << 22
#: CGK walks, samples drawn from each, and places a sample. A window with any sample of its item is measured whole at once,
#: any other after its fours and eights, so that no sample's chance loses a passage.
WALKS, SAMPLES, PLACES = 4, 16, 2
#: Items of one broadcast block; more items are taken in further blocks.
BLOCK_ITEMS = 20_000
_B = U64(0x9E3779B97F4A7C15)
_FULL = ((1 << np.arange(MAX_SEED + 1)) - 1).astype(np.uint8)


def normal(text: str) -> str:
    """Lower case, white space of any length as one blank."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def embed(windows: np.ndarray, lengths: np.ndarray, walk: int, out_len: int) -> np.ndarray:
    """CGK random-walk embedding of rows of characters: at each step the character is put out, and a random bit of
    (walk, step, character) says whether the walk goes on to the next. Past the end it puts out 0."""
    n = len(windows)
    at, out, rows = np.zeros(n, np.int64), np.empty((out_len, n), np.uint32), np.arange(n)
    flat, width = windows.reshape(-1), windows.shape[1]
    base = rows * width
    for j in range(out_len):
        c = np.where(at < lengths, flat[base + np.minimum(at, width - 1)], 0)
        out[j] = c
        at += (_coin(c, walk, j) & (c > 0)).astype(np.int64)
    return out


def _coin(c: np.ndarray, walk: int, step: int) -> np.ndarray:
    x = c + np.uint32(0x9E3779B9 * (walk * 100_003 + step + 1) & 0xFFFFFFFF)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return (x >> np.uint32(31)) == 1


def edits_inside(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """Fewest edits between the item and any part of the text, and where that part ends; None beyond ``most``.

    Sellers' recurrence by rows of the item; the running minimum does the insertions of a row at once.
    """
    n = len(text)
    row, steps = np.zeros(n + 1, np.int32), np.arange(n + 1, dtype=np.int32)
    for i, c in enumerate(item, 1):
        new = np.empty(n + 1, np.int32)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != c), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        if i - most > 0 and row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


def fewest_edits(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``edits_inside`` for many pairs at once, one a column: fewest edits, and where that part of the text ends.

    Counts up to ``most`` are exact, others only beyond it. The insertions of a row are runs; minima over 1, 2, 4, ...
    neighbours cover all runs of at most ``most``.
    """
    n = len(texts)
    most = n if most is None else min(most, n)
    kind = np.int8 if len(items) + n < 120 else np.int16 if len(items) + n < 30_000 else np.int32
    steps, step = np.arange(n + 1, dtype=kind)[:, None], kind(1)
    row = np.zeros((n + 1, texts.shape[1]), kind)
    new, wrong = np.empty_like(row), np.empty(texts.shape, bool)
    shortest = int(lengths.min())
    for i in range(len(items)):
        new[0] = i + 1
        np.not_equal(texts, items[i], out=wrong)
        np.add(row[:-1], wrong.view(np.int8), out=new[1:])
        np.minimum(new[1:], row[1:] + step, out=new[1:])
        new -= steps
        reach = 1
        while reach <= most:
            np.minimum(new[reach:], new[:-reach], out=new[reach:])
            reach *= 2
        new += steps
        if i < shortest:
            row, new = new, row
        else:
            np.copyto(row, new, where=lengths > i)
    end = row.argmin(axis=0)
    return row[end, np.arange(row.shape[1])], end


def seed_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Short hash of every run of ``size`` codes; equal hashes of unequal runs only cost a look."""
    n = max(len(x) - size + 1, 0)
    h = np.zeros(n, np.uint32)
    for i in range(size if n else 0):
        h *= np.uint32(0x9E3779B1)
        h += x[i : i + n]
    return h * np.uint32(0x85EBCA6B)


class Index:
    """The items' pieces with the seeds that find them, and the items' bit-sampling tables."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.ids = [i for i, _ in items]
        self.items = [codes(normal(t)) for _, t in items]
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.most = np.array([int(share * n) for n in self.lengths], np.int64)
        self.pieces = self.most // 2 + 1
        brute = self.lengths < 2 * MIN_SEED * self.pieces
        self.short = np.flatnonzero(brute & (self.lengths > 0)).tolist()
        # characters of the items count from 1, all others are 0
        self.flat = np.concatenate([*self.items, np.zeros(0, np.uint32)])
        used = np.unique(self.flat)
        self.code = np.zeros(0x110000, np.uint8 if len(used) < 256 else np.uint32)
        self.code[used] = np.arange(1, len(used) + 1)
        self.flat, self.base = self.code[self.flat], np.cumsum(self.lengths) - self.lengths
        rows: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
        for k in np.flatnonzero(~brute).tolist():
            n, p = len(self.items[k]), int(self.pieces[k])
            for c in range(p):
                lo, hi = c * n // p, (c + 1) * n // p
                mid = (lo + hi) // 2
                left, right = min(mid - lo, MAX_SEED), min(hi - mid, MAX_SEED)
                rows.setdefault((left, 1), []).append((k, c, mid - left, mid, right))
                rows.setdefault((right, -1), []).append((k, c, mid, mid - 1, left))
        self.seeds = {k: self.table(*k, np.array(r, np.int64)) for k, r in sorted(rows.items())}
        self.width = max((len(x) for x in self.items), default=1)
        grid = self.grid(self.items)
        self.tables = [self.samples(grid, self.lengths, self.lengths, w) for w in range(WALKS)] if self.items else []

    def table(self, size: int, way: int, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Seeds by slot: each slot's first row and rows, hashes, rows (item, piece, offset, first place of the other half,
        its length), and the other halves from the seed on, a column each."""
        place = self.base[rows[:, 0]] + rows[:, 2]
        h = np.zeros(len(rows), np.uint32)
        for i in range(size):
            h = h * np.uint32(0x9E3779B1) + self.flat[place + i]
        h *= np.uint32(0x85EBCA6B)
        order = np.argsort(h, kind="stable")
        rows, h = rows[order], h[order]
        n = np.bincount(h >> np.uint32(32 - SLOT_BITS), minlength=1 << SLOT_BITS)
        i = np.minimum(np.arange(MAX_SEED)[:, None], rows[:, 4] - 1)
        return np.cumsum(n) - n, n.astype(np.int32), h, rows, self.flat[self.base[rows[:, 0]] + rows[:, 3] + way * i]

    def grid(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), self.width), np.uint32)
        for k, x in enumerate(rows):
            out[k, : len(x)] = x[: self.width]
        return out

    def samples(self, grid: np.ndarray, lengths: np.ndarray, items: np.ndarray, walk: int) -> np.ndarray:
        """(SAMPLES, rows) hashes of PLACES places of the embedding, drawn within twice the item's length, where a walk mostly still is."""
        e = embed(grid, lengths, walk, 2 * self.width)
        out = np.empty((SAMPLES, len(grid)), U64)
        cols = np.arange(len(grid))
        for s in range(SAMPLES):
            x = np.full(len(grid), walk * SAMPLES + s + 1, U64)
            for p in range(PLACES):
                draw = mix64(np.array([(walk * SAMPLES + s) * PLACES + p + 1], U64) * _B)[0]
                place = ((items.astype(np.float64) * 2 - 1) * (float(draw >> U64(11)) / 2**53)).astype(np.int64)
                x = mix64(x * U64(0x9FB21C651E98DF25) + e[place, cols])
            out[s] = x
        return out

    def seeded(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """(item, piece, begin, place) where half of a piece is in x as such, at ``place``, and the other half is next to it within
        one edit; ``begin`` is where the item would begin if there were no edits before the seed."""
        pad = np.concatenate([np.zeros(MAX_SEED + 1, x.dtype), x, np.zeros(2 * MAX_SEED + 1, x.dtype)])
        for (size, way), (first, n, hashes, rows, other) in self.seeds.items():
            h, sizes = seed_hashes(x, size), np.ascontiguousarray(rows[:, 4])
            slot = (h >> np.uint32(32 - SLOT_BITS)).astype(np.int32)
            hits = np.flatnonzero((n > 0).take(slot))
            for lo in range(0, len(hits), 1 << 15):
                at = hits[lo : lo + (1 << 15)]
                here = slot[at]
                many = n[here].astype(np.int64)
                ends = np.cumsum(many)
                seed, where = np.arange(ends[-1]) + np.repeat(first[here] - ends + many, many), np.repeat(at, many)
                same = h[where] == hashes[seed]
                seed, where = seed[same], where[same]
                # bit i: character i of the other half is in its place, or in the place before or after
                near = [pad[MAX_SEED + 1 + (size if way > 0 else -1) + way * i :] if way > 0 or i <= MAX_SEED else pad for i in range(-1, MAX_SEED + 1)]
                length = sizes.take(seed)
                e0, em, ep = (np.zeros(len(seed), np.uint8) for _ in range(3))
                before, now = near[0].take(where), near[1].take(where)
                for i in range(int(rows[:, 4].max())):
                    after, c = near[i + 2].take(where), other[i].take(seed)
                    e0 |= (c == now).view(np.uint8) << np.uint8(i)
                    em |= (c == before).view(np.uint8) << np.uint8(i)
                    ep |= (c == after).view(np.uint8) << np.uint8(i)
                    before, now = now, after
                full = _FULL[length]
                wrong = ~e0 & full
                low = wrong & (~wrong + np.uint8(1))
                since = full & ~(low - np.uint8(1))
                past = since & ~low
                good = np.flatnonzero((wrong == 0) | (e0 & past == past) | (em & past == past) | (ep & since == since))
                if len(good):
                    seed = seed[good]
                    yield np.stack([rows[seed, 0], rows[seed, 1], where[good] - rows[seed, 2], where[good]])

    def within(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: np.ndarray, group: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of ``found`` (text, item, piece, begin) whose group of pieces is there within its edits, one of each stretch of
        ``wide`` begins, with the edits and the place where it ends."""
        text, item, piece, begin = found
        first = piece // group * group
        last = np.minimum(first + group, self.pieces[item])
        lo, hi = (v * self.lengths[item] // self.pieces[item] for v in (first, last))
        most = np.minimum(2 * (last - first) - 1, self.most[item])
        begin = begin // wide * wide
        order = np.lexsort((begin, first, item, text))
        key = np.stack([text, item, first, begin])[:, order]
        one = order[np.concatenate([np.ones(min(1, len(order)), bool), (key[:, 1:] != key[:, :-1]).any(axis=0)])]
        text, item, piece, begin, lo, hi, most = (v[one] for v in (text, item, piece, begin, lo, hi, most))
        at = np.clip(begin + lo - most, starts[text], ends[text])
        to = np.clip(begin + wide + hi + most, at, ends[text])
        edits, stop = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
        order = np.argsort(hi - lo, kind="stable")
        for k in (order[c : c + 2048] for c in range(0, len(order), 2048)):
            cols = at[k] + np.arange(int((to - at)[k].max()))[:, None]
            texts = np.where(cols < to[k], x[np.minimum(cols, len(x) - 1)], x.dtype.type(0))
            chars = self.flat[self.base[item[k]] + lo[k] + np.minimum(np.arange(int((hi - lo)[k].max()))[:, None], (hi - lo)[k] - 1)]
            edits[k], stop[k] = fewest_edits(chars, (hi - lo)[k], texts, int(most[k].max()))
        good = edits <= most
        return np.stack([text, item, piece, begin])[:, good], edits[good], (at + stop)[good]

    def proposed(self, raw: np.ndarray, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether a bit sample of the item-sized window at each place is that of its item."""
        out = np.zeros(found.shape[1], bool)
        for lo in range(0, len(out), 4096):
            text, item, _, begin = found[:, lo : lo + 4096]
            begin = np.maximum(begin, 0)
            size = np.clip(ends[text] - begin, 0, self.lengths[item])
            cols = np.arange(self.width)
            grid = np.where(cols < size[:, None], raw[np.minimum(begin[:, None] + cols, len(raw) - 1)], 0).astype(np.uint32)
            for w in range(WALKS):
                out[lo : lo + 4096] |= (self.samples(grid, size, self.lengths[item], w) == self.tables[w][:, item]).any(axis=0)
        return out

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item id, edits, place of the end) of each item that a text holds within the edits allowed."""
        parts = [codes(normal(t)) for t in texts]
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
        raw = np.concatenate([v for p in parts for v in (p, np.zeros(1, np.uint32))])
        x = self.code[raw]
        x[ends] = 0
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for k in self.short:
            for i, p in enumerate(parts):
                if len(p) and (got := edits_inside(self.items[k], p, int(self.most[k]))) is not None:
                    found[i, k] = got
        got = [np.zeros((4, 0), np.int64)]
        for item, piece, begin, place in self.seeded(x):
            text = np.searchsorted(starts, place, side="right") - 1
            got.append(self.within(x, starts, ends, np.stack([text, item, piece, begin]), *GROUPS[0])[0])
        near = np.concatenate(got, axis=1)
        if near.size:
            sure = self.proposed(raw, ends, near)
            rest = near[:, ~sure]
            for group in GROUPS[1:]:
                rest = self.within(x, starts, ends, rest, *group)[0]
            whole = np.concatenate([near[:, sure], rest], axis=1)
            (text, item, *_), edits, stop = self.within(x, starts, ends, whole, int(self.pieces.max()), GROUPS[-1][1])
            for i, k, e, z in zip(text.tolist(), item.tolist(), edits.tolist(), stop.tolist(), strict=True):
                if (i, k) not in found or e < found[i, k][0]:
                    found[i, k] = (e, z - int(starts[i]))
        return [(i, self.ids[k], e, end) for (i, k), (e, end) in sorted(found.items())]


def _searching(items: list[tuple[int, str]], share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, share)
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), [], []
            size, first = 0, 0
            for r, t in enumerate(batch.column(1), 1):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= STEP_CHARS or r == len(ids):
                    rows += [(ids[first + i], *hit) for i, *hit in index.find(texts)]
                    texts, size, first = [], 0, r
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "edits", "end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = EDIT_SHARE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, edits, end_at): the items that a text holds within ``share`` of their length in edits, whole
    texts and items taken in lower case with single blanks; end_at is a place in that form of the text.

    The items are a stated query set: they go to the executors in blocks of ``block_items``. Null and
    blank texts or items match nothing, a null item id is an item like any other; repeated rows give
    repeated results, a repeated item is one item. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    parts, block, out = [], [], None
    for r in items.toLocalIterator():
        if r[1].strip():
            block.append((r[0], r[1]))
        if len(block) == block_items:
            parts.append(block)
            block = []
    parts.append(block)
    for p in parts:
        got = src.mapInArrow(lean(_searching(sorted(p, key=repr), share)), "doc_id long, item_id long, edits int, end long").withColumnRenamed("end", "end_at")
        out = got if out is None else out.unionByName(got)
    return out
