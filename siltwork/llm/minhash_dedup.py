"""Near-duplicate components by circulant MinHash, banding and exact Jaccard verification on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ids_of, lean, mix64, small_batches, text_sets, U64
from .components import components

#: 32 bands of 4 coordinates: a pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
#: Members of a star (of each of two kinds) that the others are compared with in a round, and the share of members apart that must find a link for another round.
LEADS, ROUND_SHARE = 8, 0.05
_SKETCH = "id long, n_shingles long, digest binary, bands array<long>"


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A fixed bijection of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """(size, sets) coordinates: the minimum of pi over the sigma-permuted elements, pi shifted circularly by one place per coordinate."""
    slots = _permute((hashes >> U64(32)).astype(np.uint32), 0x21F0AAAD, 0xD35A2D97)  # sigma
    out = np.empty((size, len(starts)), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(_permute(slots + np.uint32(k), 0x7FEB352D, 0x846CA68B), starts)  # pi, shifted by k
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys; the number of the band is part of the key."""
    out = np.empty((sig.shape[1], bands), U64)
    for b in range(bands):
        x = np.full(sig.shape[1], b + 1, U64)
        for r in range(rows):
            x = mix64(x * U64(0x9FB21C651E98DF25) + sig[b * rows + r])
        out[:, b] = x
    return out.view(np.int64)


def _sketcher(k: int, bands: int, rows: int):
    def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        counts, keys = np.zeros(len(sets), np.int64), np.zeros(0, np.int64)
        if len(full):
            allh = np.concatenate(sets)
            starts = (np.cumsum(sizes) - sizes)[full]
            keys = band_keys(circulant_signatures(allh, starts, bands * rows), bands, rows).reshape(-1)
            counts[full] = bands
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        digests = [hashlib.sha256(x.tobytes()).digest() for x in sets]  # of the whole sorted set
        cols = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys))]
        return pa.RecordBatch.from_arrays(cols, ["id", "n_shingles", "digest", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, sets, held = batch.column(0).to_pylist(), [], [], 0
            for r, s in text_sets(batch.column(1), k):
                own.append(ids[r])
                sets.append(s)
                held += len(s)
                if held > 200_000:
                    yield flush(own, sets)
                    own, sets, held = [], [], 0
            if own:
                yield flush(own, sets)

    return run


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(lean(_sketcher(k, bands, rows)), _SKETCH)


def _jaccard(k: int, diffs: bool):
    names = ["a", "b", "inter", "na", "nb"] + ["lacks", "adds"] * diffs

    def lists(parts: list[np.ndarray]) -> pa.Array:
        at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            a, b = ids_of(batch.column(0)), ids_of(batch.column(1))
            inter, na, nb = (np.zeros(len(a), np.int64) for _ in range(3))
            lacks, adds = [], []
            new = [i for i in range(len(a)) if a[i] != (a[i - 1] if i else last)]
            heads = dict(zip(new, (s for _, s in text_sets(batch.column(2).take(pa.array(new, pa.int64())), k)), strict=True))
            for r, s in text_sets(batch.column(3), k):
                if r in heads:
                    mine = heads.pop(r)
                inter[r] = len(np.intersect1d(mine, s, assume_unique=True))
                na[r], nb[r] = len(mine), len(s)
                if diffs:
                    lacks.append(np.setdiff1d(mine, s, assume_unique=True).view(np.int64))
                    adds.append(np.setdiff1d(s, mine, assume_unique=True).view(np.int64))
            last = a[-1] if len(a) else last
            cols = [pa.array(x) for x in (a, b, inter, na, nb)] + ([lists(lacks), lists(adds)] if diffs else [])
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, k: int, diffs: bool = False) -> DataFrame:
    """pairs (a, b) with the sizes of their whole sets and of the intersection; a pair's texts meet by two joins on the id.

    diffs: also the hashes of the shingles of a that b lacks and of those that b adds.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    one = pairs.join(texts, pairs.b == texts.id).select("a", "b", F.col("t").alias("tb"))
    two = one.join(texts, one.a == texts.id).select("a", "b", "t", "tb")
    return two.mapInArrow(lean(_jaccard(k, diffs)), "a long, b long, inter long, na long, nb long" + ", lacks array<long>, adds array<long>" * diffs)


def _linked(percent: int):
    return F.col("inter") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("inter"))


def _members(seen: DataFrame, label: DataFrame) -> DataFrame:
    """The stars' members with their components; apart: not of the component of the star's smallest member."""
    comp = seen.join(label.withColumnRenamed("node", "b"), "b", "left").withColumn("comp", F.coalesce("label", "b")).drop("label")
    comp = comp.join(label.select(F.col("node").alias("a"), F.col("label").alias("main")), "a", "left").withColumn("main", F.coalesce("main", "a"))
    return cut(comp.select("a", "b", "na", "nb", "lacks", "adds", "comp", (F.col("comp") != F.col("main")).alias("apart")))


def _reaching(apart: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Links between members apart and other members of their stars whose components differ.

    A member's set is its star's smallest member less what it lacks and with what it adds, so the
    intersection of two members follows from these differences, and the cheap bound goes first.
    """
    x = apart.select("a", *(F.col(c).alias("x_" + c) for c in ("b", "nb", "lacks", "adds", "comp")))
    y = others.select("a", "na", *(F.col(c).alias("y_" + c) for c in ("b", "nb", "lacks", "adds", "comp", "apart")))
    reach = lambda inter: inter * 100 >= F.lit(percent) * (F.col("x_nb") + F.col("y_nb") - inter)
    lx, ly, ax, ay = (F.size(c).cast("long") for c in ("x_lacks", "y_lacks", "x_adds", "y_adds"))
    bound = F.col("na") - F.greatest(lx, ly) + F.least(ax, ay)
    inter = F.col("na") - lx - ly + F.size(F.array_intersect("x_lacks", "y_lacks")) + F.size(F.array_intersect("x_adds", "y_adds"))
    met = x.join(y, "a").where((F.col("x_comp") != F.col("y_comp")) & reach(bound) & reach(inter))
    return met.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b"), "y_apart", (F.col("x_b") < F.col("y_b")).alias("first"))


def _leads(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each star up to LEADS members near to its smallest one and up to LEADS members apart, others in each turn."""
    row = ["b", "na", "nb", "lacks", "adds", "comp", "apart"]
    drawn = F.xxhash64("b", F.lit(turn))
    dealt = members.withColumn("g", F.pmod(drawn, F.lit(LEADS)))
    near = dealt.groupBy("a", "g").agg(F.min(F.struct(F.size("lacks") * 100 + F.size("adds") * percent, *row)).alias("m"))
    some = dealt.where("apart").groupBy("a", "g").agg(F.min(F.struct(drawn, *row)).alias("m"))
    pick = [F.col(f"m.{c}").alias(c) for c in row]
    return cut(near.select("a", *pick).unionByName(some.select("a", *pick)).distinct())


def _grown(seen: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Labels of all nodes with links, those between members of one star included that its smallest member doesn't link.

    Members apart are first compared with a few leads of their star, round after round while many find a
    link, so that families within a star merge by links in proportion to their members. Then the few
    components left are compared with all members, which loses nothing.
    """
    label, turn = components(links), 0
    while True:
        members = _members(seen, label)
        apart = members.where("apart")
        n = apart.count()
        if not n:
            return label
        turn += 1
        new = cut(_reaching(apart, _leads(members, percent, turn), percent).select("a", "b").distinct())
        found = new.count()
        if found:
            links = links.unionByName(new)
            label = components(links)
        if found < ROUND_SHARE * n:
            break
    members = _members(seen, label) if found else members
    # two that are both apart meet once
    last = cut(_reaching(members.where("apart"), members, percent).where("not y_apart or first").select("a", "b").distinct())
    return label if last.isEmpty() else components(links.unionByName(last))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, class_id.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a text's set holds its distinct k-word
    shingles, the whole sequence where it has fewer words. Texts are linked when the exact Jaccard
    similarity of their whole sets is at least ``percent`` hundredths; component_id is the smallest id
    that links reach. class_id is the smallest id with the same set. Null or blank texts have an empty
    set and are linked with nothing; a row with a null id has a null component and stays. Repeated rows
    are in one class. Other columns are ignored, an empty table gives an empty result.

    Equal sets meet first (by SHA-256 over the whole sorted set) and only the class's representative is
    banded. In each bucket all members are verified against its smallest one on whole sets (a star, never
    all pairs). Members of a star that are still in different components are compared by their differences
    from its smallest member, see ``_grown``: exact, and short.
    """
    sk = cut(sketch(docs, id_col, text_col, k))
    full = sk.where("n_shingles > 0 and id is not null")
    key = ["n_shingles", "digest"]
    classes = cut(full.groupBy(*key).agg(F.min("id").alias("rep")))
    # a repeated id is one node; its rows are alike
    reps = full.join(classes.select("rep"), full.id == F.col("rep"), "left_semi")
    member = reps.select(F.explode("bands").alias("key"), "id")
    leads = member.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("most")).where("lead < most").select("key", "lead")
    stars = member.join(leads, "key").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    seen = cut(verified(docs, stars, id_col, text_col, k, diffs=True))
    label = _grown(seen, seen.where(_linked(percent)).select("a", "b"), percent)
    owner = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.col("rep"), F.coalesce("label", "rep").alias("comp"))
    done = sk.select("id", *key).join(owner, key, "left")
    comp = F.coalesce("comp", "id")
    comp = F.when(F.col("id").isNotNull(), comp)
    return done.select(F.col("id").alias("doc_id"), "n_shingles", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("class_id"))
