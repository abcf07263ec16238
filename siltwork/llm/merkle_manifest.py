"""Merkle manifest of a dataset: levels built bottom up and kept as tables, proofs pushed top down by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, LOWER, UPPER

#: Consecutive nodes that one parent covers.
ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOCAL = (1 << 33) - 1


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(col: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon and value."""
    said = col.cast("string")
    return F.when(col.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*(field(c) for c in fields))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their place from 0 in one order of the whole table, by range partitions and the counts before each.

    Rows that are alike in all of `order` are dealt by where they were read, so that no run of repeats fills one task.
    The broadcast table has one row a partition.
    """
    tied = rows.withColumn("_read", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, F.col("_read")).sortWithinPartitions(*order, F.col("_read")).drop("_read")
    placed = cut(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)).alias("_at")))
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = before.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_rows", "_before")


def _parent(pos: str) -> Column:
    return F.expr(f"{pos} div {ARITY}")


def _runs(nodes: DataFrame, *payload: str) -> DataFrame:
    """(tree, run, n, kids, digest): every run of consecutive nodes with its parent's digest; a lone node is its own parent."""
    kids = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    runs = nodes.groupBy("tree", _parent("pos").alias("run")).agg(F.first("n").alias("n"), kids.alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: k.digest), "")
    return cut(runs.withColumn("digest", F.when(F.col("n") == 1, F.col("kids")[0].digest).otherwise(F.sha2(joined, 256))))


def heights(most: int) -> int:
    """Levels of a tree of that many leaves, at least one."""
    levels, nodes = 1, -(-most // ARITY)
    while nodes > 1:
        levels, nodes = levels + 1, -(-nodes // ARITY)
    return levels


def build(leaves: DataFrame, most: int, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels from the leaves up, and (tree, digest, height) of each tree's top.

    `leaves` has tree, pos (0 to n-1 in a tree), n and digest; `most` is the largest n. Each level is a written table;
    a tree takes part as long as it has more than one node, so levels shrink by the arity.
    """
    levels, tops, nodes, n = [], None, leaves, F.expr(f"(n + {ARITY - 1}) div {ARITY}")
    for height in range(1, heights(most) + 1):
        runs = _runs(nodes, *(payload if height == 1 else ()))
        levels.append(runs)
        above = runs.select("tree", F.col("run").alias("pos"), n.alias("n"), "digest")
        top = above.where("n = 1").select("tree", "digest", F.lit(height).alias("height"))
        tops, nodes = (top if tops is None else tops.unionByName(top)), above.where("n > 1")
    return levels, tops


def push(levels: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """Leaves (fields of the lowest level's kids, `carried`, path) from `tops` (tree, height, path, `carried`).

    Level by level a parent's path is joined to its run; each child puts its siblings before it. A path is an array of
    (l, r): digests of a node's left and right siblings, from the leaf up. Only parents are shuffled, never leaves.
    """
    nodes = None
    for height in range(len(levels), 0, -1):
        here = tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("run"), "path", *carried)
        parents = here if nodes is None else nodes.select("tree", F.col("pos").alias("run"), "path", *carried).unionByName(here)
        met = levels[height - 1].drop("digest").join(parents, ["tree", "run"]).withColumn("digests", F.transform("kids", lambda k: k.digest))

        def beside(i: Column) -> Column:
            return F.struct(F.array_join(F.slice("digests", F.lit(1), i), "").alias("l"), F.array_join(F.slice("digests", i + 2, F.lit(ARITY)), "").alias("r"))

        child = F.explode_outer(F.transform("kids", lambda k, i: F.struct(k.alias("kid"), beside(i).alias("step")))).alias("child")
        kids = met.select("tree", "n", "path", *carried, child)
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array("child.step"), F.col("path")))
        nodes = kids.select("tree", "child.kid.*", path.alias("path"), *carried)
        if height > 1:
            nodes = cut(nodes)
    return nodes


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, step: digest(step.l, node, step.r))


def proof(path: Column) -> Column:
    """All siblings, from the leaf up and left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step.l, step.r)), "")


def merkle_proofs(rows: DataFrame, group: str, order: str, digest_col: str, *payload: str) -> DataFrame:
    """Rows (leaf digest in `digest_col`) with subroot of their group's tree, root of all groups and the path to it.

    Leaves of a group ascend by `order`, nulls first, rows of equal order by their digest; repeated rows are leaves of
    their own. Groups ascend by `group`, null first (null is a group), strings by UTF-8 bytes.
    """
    own = list(dict.fromkeys([order, *payload]))
    # written first: the range sort reads its input twice, and texts are to be hashed once
    leaves = cut(rows.select(F.col(group).alias("_group"), F.col(digest_col).alias("digest"), *own))
    placed = numbered(leaves, "_place", F.col("_group").asc_nulls_first(), F.col(order).asc_nulls_first(), F.col("digest"))
    # a tree is named by its first leaf's place: names ascend as groups do
    trees = cut(placed.groupBy("_group").agg(F.min("_place").alias("tree"), F.count(F.lit(1)).alias("n")))
    most, count = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    at = placed.join(trees.withColumnRenamed("_group", "_of"), F.col("_group").eqNullSafe(F.col("_of")))
    levels, tops = build(at.select("tree", "n", (F.col("_place") - F.col("tree")).alias("pos"), "digest", *own), most or 0, *own)

    order_of_trees = numbered(tops, "pos", F.col("tree"))
    upper = order_of_trees.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), "pos", "digest", F.col("tree").alias("below"), F.col("height").alias("levels"))
    above, root = build(upper, count, "below", "levels")
    crown = root.select("tree", "height", F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path"), F.col("digest").alias("root"))
    subroots = push(above, crown, "root").select(F.col("below").alias("tree"), F.col("levels").alias("height"), "path", F.col("digest").alias("subroot"), "root")
    return push(levels, cut(subroots), "subroot", "root").drop("tree", "pos").withColumnRenamed("digest", digest_col)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and whole text, each null as `-`, else with its byte count
    before it. Where 3 divides the CRC-32 of the decimal doc_id, the text is tampered with (A-Z lower-cased) before the
    root is folded again; texts without A-Z and null texts stay as they are. Null ids come first in their language,
    count as untampered, and like repeated rows are leaves of their own; rows of equal id ascend by leaf. A null lang
    is a language. A lone leaf is its language's subroot, a lone subroot is the root: proofs are then SHA-256 of nothing.
    An empty table gives no rows. Other columns take no part, whatever their names. Texts never leave their task: 64
    characters a row are shuffled, then runs of eight with their proof.
    """
    cols = [F.col(c) for c in FIELDS]
    changed = F.expr("crc32(cast(doc_id as string)) % 3 = 0")
    tampered = leaf([*cols[:-1], F.translate("text", UPPER, LOWER)])
    rows = docs.select("doc_id", "lang", leaf(cols).alias("leaf"), F.when(changed, tampered).alias("changed"))
    got = merkle_proofs(rows, "lang", "doc_id", "leaf", "changed")
    folded = got.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
OP11_SQL = f"""WITH RECURSIVE leaves AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
           CASE WHEN {_CRC} % 3 = 0 THEN sha256({_LEAF} || {_FIELD.format("translate(text, '" + UPPER + "', '" + LOWER + "')")}) END AS changed
    FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT lang, 0 AS lvl, pos, n, leaf AS digest FROM placed
    UNION ALL SELECT lang, lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 8),
subs AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (SELECT 0 AS lvl, pos, n, subroot AS digest FROM subs
    UNION ALL SELECT lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY lvl, pos // 8),
beside AS (SELECT lang, lvl, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                  coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY lang, lvl, pos // 8 ORDER BY pos)),
above AS (SELECT lvl, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM crown WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // 8 ORDER BY pos)),
walk AS (SELECT rid, lang, 0 AS lvl, pos, n, coalesce(changed, leaf) AS node, '' AS proof FROM placed
    UNION ALL SELECT w.rid, w.lang, w.lvl + 1, w.pos // 8, (w.n + 7) // 8, sha256(b.l || w.node || b.r), w.proof || b.l || b.r
    FROM walk w JOIN beside b ON w.lang IS NOT DISTINCT FROM b.lang AND w.lvl = b.lvl AND w.pos = b.pos WHERE w.n > 1),
climb AS (SELECT w.rid, 0 AS lvl, s.pos, s.n, w.node, w.proof FROM walk w JOIN subs s ON w.lang IS NOT DISTINCT FROM s.lang WHERE w.n = 1
    UNION ALL SELECT c.rid, c.lvl + 1, c.pos // 8, (c.n + 7) // 8, sha256(a.l || c.node || a.r), c.proof || a.l || a.r
    FROM climb c JOIN above a ON c.lvl = a.lvl AND c.pos = a.pos WHERE c.n > 1)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = r.digest AS verified
FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang JOIN climb c ON c.rid = p.rid AND c.n = 1 CROSS JOIN (SELECT digest FROM crown WHERE n = 1) r"""
