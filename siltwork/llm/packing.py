"""Token sequences by best fit and swap-based local search, over shards that grow in number, not in size."""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, small_batches

SEQUENCE = 2048
#: Pieces that one packing task gets on average; a shard wastes less than one sequence.
SHARD_PIECES = 16_384
_CODERS: dict[tuple, object] = {}
_SPECIAL = "<|endoftext|>"


def coder(vocabulary: str, ranks: str, pattern: str):
    """text -> ids. Where a text can't hold a special token the rank file gives the same ids, five times as fast."""
    key = (vocabulary, ranks, pattern)
    if key not in _CODERS:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        slow: list = []

        def encode(text: str) -> list[int]:
            if _SPECIAL in text:
                if not slow:
                    slow.append(Tokenizer.from_file(vocabulary))
                return slow[0].encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _CODERS[key] = encode
    return _CODERS[key]


def _cutter(vocabulary: str, ranks: str, pattern: str, size: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def batch_of(cols: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(vocabulary, ranks, pattern)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                first = (len(ids) - 1) % size + 1
                start, piece = 0, 0
                while start < len(ids):
                    end = start + (first if piece == 0 else size)
                    for c, v in zip(cols, (i, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())), strict=True):
                        c.append(v)
                    start, piece = end, piece + 1
            yield batch_of(cols)

    return run


def pieces(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(lean(_cutter(vocabulary, ranks, pattern, size)), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space; the set bits of ``mask`` are the free spaces that some bin has."""

    def __init__(self, size: int):
        self.size, self.mask = size, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.items: list[list[int]] = []

    def best_fit(self, k: int, length: int) -> None:
        rest = self.mask >> length
        if rest:
            free = length + (rest & -rest).bit_length() - 1
            at = self.by_free[free].pop()
            if not self.by_free[free]:
                self.mask ^= 1 << free
            self.items[at].append(k)
        else:
            free, at = self.size, len(self.items)
            self.items.append([k])
        if left := free - length:
            self.by_free[left].append(at)
            self.mask |= 1 << left


def fewest(lengths: list[int], size: int) -> int:
    """A bound that no packing is under: for any a up to half the size, items over size - a are alone, items over half
    are apart, and what is at least a must fit beside the latter (Martello and Toth)."""
    count = np.bincount(np.array(lengths, np.int64), minlength=size + 1)
    total = count * np.arange(size + 1)
    n, t = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])  # of items under a length
    half, best = size // 2, -(-int(t[-1]) // size)
    for a in range(1, half + 1):
        apart, beside = int(n[-1] - n[half + 1]), int(t[half + 1] - t[a])
        room = int((n[size - a + 1] - n[half + 1]) * size - (t[size - a + 1] - t[half + 1])) if size - a > half else 0
        best = max(best, apart + max(0, -(-(beside - room) // size)))
    return best


class Search:
    """Local search over bins: moves, one-for-one and two-for-one exchanges out of a bin into a bin at least as full.

    Every step raises the sum of squared fills. Bins with room are kept in order of it, the roomiest first:
    no bin can gain more than its room, so a scan ends as soon as the best gain found is the next one's room.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = [list(b) for b in bins], lengths, size
        self.fill = [sum(lengths[k] for k in b) for b in bins]
        self.open = sorted((self.fill[i] - size, i) for i in range(len(bins)) if 0 < self.fill[i] < size)

    def _refill(self, at: int, by: int) -> None:
        old = (self.fill[at] - self.size, at)
        k = bisect.bisect_left(self.open, old)
        if k < len(self.open) and self.open[k] == old:
            del self.open[k]
        self.fill[at] += by
        if 0 < self.fill[at] < self.size:
            bisect.insort(self.open, (self.fill[at] - self.size, at))

    def step(self, at: int) -> bool:
        """The exchange out of bin ``at`` with the greatest gain; false if there is none."""
        own, lengths = self.bins[at], self.lengths
        outs = [(lengths[k], (k,)) for k in own] + [(lengths[a] + lengths[b], (a, b)) for i, a in enumerate(own) for b in own[i + 1 :]]
        best, found = 0, None
        for short, to in self.open:
            room = -short
            if room <= best:
                break
            if to == at or self.fill[to] < self.fill[at]:
                continue
            for total, out in outs:
                if len(out) == 1 and best < total <= room:
                    best, found = total, (out, to, None)
                for k in self.bins[to]:
                    if best < total - lengths[k] <= room:
                        best, found = total - lengths[k], (out, to, k)
        if found is None:
            return False
        out, to, back = found
        self.bins[at] = [k for k in own if k not in out] + ([] if back is None else [back])
        self.bins[to] = [k for k in self.bins[to] if k != back] + list(out)
        self._refill(at, -best)
        self._refill(to, best)
        return True


def improve(bins: list[list[int]], lengths: list[int], size: int, least: int) -> list[list[int]]:
    """Passes of local search from the emptiest bin on, until bins are as few as ``least`` or no step is left. Each step raises
    the sum of squared fills, so it ends."""
    search, live, moved = Search(bins, lengths, size), len(bins), True
    while live > least and moved:
        moved = False
        for at in [i for _, i in search.open]:
            while live > least and search.bins[at] and search.fill[at] < size and search.step(at):
                moved = True
                live -= not search.bins[at]
    return [b for b in search.bins if b]


def pack(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers: best fit in order of falling length, then local search."""
    bins = Bins(size)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bins.best_fit(k, lengths[k])
    return improve(bins.items, lengths, size, fewest(lengths, size))


def _packer(size: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths, base = shard["length"].to_pylist(), (shard["shard"][0].as_py() << 32)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n, items in enumerate(pack(lengths, size)):
            at = 0
            for k in items:
                seq[k], off[k] = base + n, at
                at += lengths[k]
        return shard.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    return run


def best_fit_packing(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and an id 0; a null text is an empty one, so its document is the id 0
    alone. Longer documents than ``size`` are cut so that all pieces but the first are full. Rows that
    repeat are packed as often as they come; a null id is carried. An empty table gives an empty result.
    """
    cuts = cut(pieces(docs, vocabulary, ranks, pattern, id_col, text_col, size))
    shards = max(1, -(-cuts.count() // shard_pieces))
    dealt = cuts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_packer(size), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
