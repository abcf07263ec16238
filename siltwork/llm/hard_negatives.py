"""Hard-negative mining: anchor blocks times candidate blocks as float64 products, positives first, then windowed negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, small_batches
from .merkle_manifest import numbered

#: Anchors of one broadcast block, candidates of one packed block, anchors of one product.
BLOCK, CHUNK, SLICE = 8192, 4096, 512
#: Bytes of a broadcast block's vectors; long vectors make blocks of fewer anchors.
BLOCK_BYTES = 64 << 20
POSITIVES, NEGATIVES = 5, 5
#: A negative's score as a share of its positive's, in percent.
LOW, HIGH = 80, 100
SCALE = 256
_EXACT = 1 << 53
#: Pieces of a candidate side: tasks whose tables of best rows are merged; by cores, not by rows.
TASKS_A_CORE = 4

_PACKED = pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string())])
_PACKED_DDL = "n int, dim int, ids binary, labels binary, vectors binary, kind string"
_BEST_DDL = "part long, scores binary, ids binary"
_BEST = pa.schema([("part", pa.int64()), ("scores", pa.binary()), ("ids", pa.binary())])
#: No such row.
NONE = np.iinfo(np.int64).min


def eligible(rows: DataFrame) -> DataFrame:
    """Rows that take part, their label moved where 7 divides the id, and their components as whole numbers."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.where(ok & finite).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")


def whole(col: pa.Array, n: int) -> np.ndarray:
    """floor(256 * x) of every component as float64; shorter vectors go on with zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    dim = int(sizes.max()) if n else 0
    if n and (sizes == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to blocks of at most CHUNK in order of label, vectors in the narrowest type that holds them."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            b = batch.slice(at, CHUNK)
            n = b.num_rows
            ids, labels = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
            v, by = whole(b.column("embedding"), n), np.lexsort((ids, labels))
            top = float(np.abs(v).max()) if v.size else 0.0
            kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
            yield pa.RecordBatch.from_pydict(
                {"n": [n], "dim": [v.shape[1]], "ids": [ids[by].astype("<i8").tobytes()], "labels": [labels[by].astype("<i8").tobytes()], "vectors": [v[by].astype(kind).tobytes()], "kind": [kind]}, schema=_PACKED
            )


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], r["dim"]).astype(np.float64)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as exact whole numbers; missing components count as zero.

    float64 is exact as long as no sum of products can reach 2^53; beyond that Python's own integers are used, and a
    result that no long can hold is an error.
    """
    dim = min(a.shape[1], c.shape[1])
    a, c = a[:, :dim], c[:, :dim]
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)))
    if float(np.abs(a).max()) * float(np.abs(c).max()) * dim < _EXACT:
        return a @ c.T
    rows = [[int(x) for x in v] for v in c]
    out = np.array([[sum(x * y for x, y in zip(v, w, strict=True)) for w in rows] for v in ([int(x) for x in u] for u in a)], dtype=object)
    if max(abs(int(x)) for x in out.ravel()) >= 1 << 62:
        raise ValueError("an inner product does not fit a long")
    return out.astype(np.int64)


class Best:
    """The first k (score descending, id ascending) of each anchor and window, fed block by block, in any order.

    A window holds scores from low to high: one window for positives, one a positive for negatives.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.full((*low.shape, k), NONE), np.full((*low.shape, k), NONE)

    def feed(self, rows: slice, scores: np.ndarray, ids: np.ndarray, skip: np.ndarray | None) -> None:
        """`scores` of the anchors in `rows` by candidate; `skip` marks pairs that don't count; ids ascend."""
        if skip is not None and skip.all():
            return
        low, high, worst = self.low[rows], self.high[rows], self.scores[rows][:, :, -1]
        floor = np.maximum(low, worst)
        some = (scores >= floor.min(1)[:, None]) & (scores <= high.max(1)[:, None])
        if skip is not None:
            some &= ~skip
        r, c = np.nonzero(some)
        if not len(r):
            return
        s, i = scores[r, c].astype(np.int64), ids[c]
        for w in range(low.shape[1]):
            last = self.ids[rows][:, w, -1]
            keep = (s >= low[r, w]) & (s <= high[r, w]) & ((s > worst[r, w]) | ((s == worst[r, w]) & (i < last[r])))
            if keep.any():
                self._take(rows.start + r[keep], w, s[keep], i[keep])

    def _take(self, r: np.ndarray, w: int, s: np.ndarray, i: np.ndarray) -> None:
        """Merge found (anchor, score, id) into the tables of window w."""
        own = np.unique(r)
        old_s, old_i = self.scores[own, w], self.ids[own, w]
        have = old_s != NONE
        r = np.concatenate((r, np.repeat(own, have.sum(1))))
        s, i = np.concatenate((s, old_s[have])), np.concatenate((i, old_i[have]))
        by = np.lexsort((i, -s, r))
        r, s, i = r[by], s[by], i[by]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        first = place < self.k
        self.scores[own, w] = NONE
        self.scores[r[first], w, place[first]], self.ids[r[first], w, place[first]] = s[first], i[first]

    def parts(self, size: int = SLICE) -> pa.RecordBatch:
        at = range(0, len(self.scores), size)
        return pa.RecordBatch.from_pydict(
            {"part": list(at), "scores": [self.scores[x : x + size].astype("<i8").tobytes() for x in at], "ids": [self.ids[x : x + size].astype("<i8").tobytes() for x in at]}, schema=_BEST
        )


def _slices(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, start, end) of ascending labels."""
    at = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *at.tolist(), len(labels)]
    return [(int(labels[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _positives(block: tuple):
    """Task: the best other rows of an anchor's label. Only products within a label are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = block.value[:3]
        n, wide = len(ids), np.iinfo(np.int64).max
        best, own = Best(np.full((n, 1), NONE + 1), np.full((n, 1), wide), POSITIVES), {k: (a, b) for k, a, b in _slices(labels)}
        for cid, clabel, cvec in unpack(batches):
            for k, ca, cb in _slices(clabel):
                if k not in own:
                    continue
                for a in range(own[k][0], own[k][1], SLICE):
                    rows = slice(a, min(a + SLICE, own[k][1]))
                    best.feed(rows, products(vectors[rows], cvec[ca:cb]), cid[ca:cb], ids[rows][:, None] == cid[None, ca:cb])
        yield best.parts()

    return run


def _negatives(block: tuple):
    """Task: for each positive of an anchor the best rows of other labels within its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, top = block.value
        # LOW * p <= 100 * n <= HIGH * p, in whole numbers; no such n where p is below zero or missing
        none = (top == NONE) | (top < 0)
        whole_part, rest = np.divmod(np.where(none, 0, top), 100)  # by parts: LOW * p need not fit a long
        low, high = np.where(none, 1, LOW * whole_part - (-LOW * rest // 100)), np.where(none, 0, HIGH * whole_part + HIGH * rest // 100)
        best = Best(low, high, NEGATIVES)
        for cid, clabel, cvec in unpack(batches):
            by = np.argsort(cid, kind="stable")
            cid, clabel, cvec = cid[by], clabel[by], cvec[by]
            for a in range(0, len(ids), SLICE):
                rows = slice(a, min(a + SLICE, len(ids)))
                best.feed(rows, products(vectors[rows], cvec), cid, labels[rows][:, None] == clabel[None, :])
        yield best.parts()

    return run


def _merged(k: int, windows: int):
    """Group: tables of the same anchors, from all tasks, become one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = [np.stack([np.frombuffer(x, "<i8").reshape(-1, windows, k) for x in pdf[c]]) for c in ("scores", "ids")]
        n = tables[0].shape[1]
        s, i = (np.moveaxis(t, 0, 2).reshape(n, windows, -1) for t in tables)
        # the best first; absent rows have the least score
        by = np.lexsort((i, -np.where(s == NONE, NONE + 1, s)), axis=-1)[..., :k]
        s, i = np.take_along_axis(s, by, -1), np.take_along_axis(i, by, -1)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "scores": [s.astype("<i8").tobytes()], "ids": [i.astype("<i8").tobytes()]})

    return run


def _block(anchors: DataFrame, b: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One block of anchors (at most `size`), in order of label and id."""
    rows = anchors.where((F.col("at") >= b * size) & (F.col("at") < (b + 1) * size)).select("vec_id", "label", "embedding")
    found = list(unpack(pack(rows.toArrow().to_batches())))
    dim = max(v.shape[1] for _, _, v in found)
    ids, labels = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    vectors = np.concatenate([np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for _, _, v in found])
    by = np.lexsort((ids, labels))
    return ids[by], labels[by], vectors[by]


def hard_negatives(rows: DataFrame, every: int = 100, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows whose id `every` divides.

    Candidates are packed once into blocks of CHUNK vectors. Anchors go out in blocks of a fixed number, one after the
    other, each broadcast to all candidate blocks: first pass, five best others of the same label; second pass, for each
    of them the five best of other labels within its window. Scores are exact whole numbers. A task keeps one table of
    bests for the block, whatever it reads, and tables are merged by slices of anchors.

    Rows with a null label, vector or component, or one that isn't finite, take no part, nor do rows with a null id,
    since nothing could name them. Vectors of unequal length: missing components count as zero. "Other" rows are those
    with another id; rows that repeat are candidates, and anchors, of their own. Equal scores rank by smaller id. Without
    anchors or candidates there are no rows. Other columns take no part.
    """
    spark = rows.sparkSession
    small_batches(spark, CHUNK)
    taking = eligible(rows.select("vec_id", "label", "embedding"))
    packed = cut(taking.mapInArrow(lean(pack), _PACKED_DDL)).coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    anchors = cut(numbered(taking.where(F.col("vec_id") % every == 0), "at", F.col("vec_id")))
    out, (count, dim) = None, anchors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * max(dim or 1, 1))))
    for b in range(-(-count // block)):
        ids, labels, vectors = _block(anchors, b, block)
        first = spark.sparkContext.broadcast((ids, labels, vectors))
        found = packed.mapInArrow(lean(_positives(first)), _BEST_DDL).groupBy("part").applyInPandas(_merged(POSITIVES, 1), _BEST_DDL)
        tables = sorted((r.part, r.scores, r.ids) for r in found.collect())
        top, who = (np.concatenate([np.frombuffer(t[k], "<i8").reshape(-1, POSITIVES) for t in tables]) for k in (1, 2))
        second = spark.sparkContext.broadcast((ids, labels, vectors, top))
        best = packed.mapInArrow(lean(_negatives(second)), _BEST_DDL).groupBy("part").applyInPandas(_merged(NEGATIVES, POSITIVES), _BEST_DDL)
        said = cut(best.mapInPandas(_rows(spark.sparkContext.broadcast((ids, top, who))), OUT_DDL))
        out = said if out is None else out.unionByName(said)
    return spark.createDataFrame([], OUT_DDL) if out is None else out


OUT_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _rows(block):
    """Tables of bests as rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, top, who = block.value
        for pdf in frames:
            for part, scores, neg in zip(pdf["part"], pdf["scores"], pdf["ids"], strict=True):
                s, i = (np.frombuffer(x, "<i8").reshape(-1, POSITIVES, NEGATIVES) for x in (scores, neg))
                a, w, k = np.nonzero(s != NONE)
                at = part + a
                yield pd.DataFrame({"anchor_id": ids[at], "positive_id": who[at, w], "rank": (k + 1).astype(np.int32), "negative_id": i[a, w, k], "positive_score": top[at, w], "negative_score": s[a, w, k]})

    return run


OP13_SQL = """WITH taking AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.rid, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM taking a JOIN taking c ON a.vec_id <> c.vec_id OR a.label <> c.label WHERE a.vec_id % 100 = 0),
positives AS (SELECT rid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS place FROM pairs WHERE same QUALIFY place <= 5),
found AS (
    SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.rid, p.place ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positives p JOIN pairs n ON n.rid = p.rid AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5"""
