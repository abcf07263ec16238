"""Sequential operators over ordered rows: heading stack, budgeted grouping, runs, draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut


def heading_stack(rows: DataFrame, doc: str, seq: str, level: Column, text: str, depth: int) -> DataFrame:
    """Adds path: for each row the open headings. A heading closes the slots of its level and below; level is null on body rows."""
    w = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    lv = rows.withColumn("_lv", level)
    for k in range(1, depth + 1):
        lv = lv.withColumn(f"_at{k}", F.last(F.when(F.col("_lv") == k, F.col(seq)), True).over(w)).withColumn(f"_t{k}", F.last(F.when(F.col("_lv") == k, F.col(text)), True).over(w))
    slots = []
    for k in range(1, depth + 1):
        open_ = F.col(f"_at{k}").isNotNull()
        for j in range(1, k):
            open_ = open_ & (F.col(f"_at{j}").isNull() | (F.col(f"_at{k}") > F.col(f"_at{j}")))
        slots.append(F.when(open_, F.col(f"_t{k}")))
    path = F.filter(F.array(*slots), lambda x: x.isNotNull())
    return lv.withColumn("path", path).drop("_lv", *(f"_at{k}" for k in range(1, depth + 1)), *(f"_t{k}" for k in range(1, depth + 1)))


def budget_groups(rows: DataFrame, key: list[str], seq: str, size: str, target: int) -> DataFrame:
    """Adds group number: a group closes as soon as its sizes come to the target. One ordered fold per key."""
    items = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(size).cast("long").alias("n")))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("g"), F.array().cast("array<struct<s:bigint,g:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["n"]
        full = total >= target
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(total).alias("sum"), (acc["g"] + full.cast("int")).alias("g"), F.concat(acc["out"], F.array(F.struct(x["s"].cast("long").alias("s"), acc["g"].alias("g")))).alias("out"))

    return items.select(*key, F.explode(F.aggregate("xs", start, step, lambda a: a["out"])).alias("x")).select(*key, F.col("x.s").alias(seq), F.col("x.g").alias("grp"))


def runs(rows: DataFrame, key: list[str], seq: str, value: str) -> DataFrame:
    """Gaps and islands: adds run, the number of the stretch of equal values."""
    w = Window.partitionBy(*key).orderBy(seq)
    change = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def capped_draw(rows: DataFrame, key: str, ident: str, seed: int, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` rows of a key and ``limit`` in all, in an order that the seed decides."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")).cast("binary"))
    w = Window.partitionBy(key).orderBy("o", ident)
    return rows.withColumn("o", order).withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).orderBy("o", ident).limit(limit).drop("o", "r")


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with their number from 1 within their group, in order; null is a group, equal rows are numbered as they were read.

    Rows are dealt by ranges of group and order, so that a group of any size fills many tasks; a partition's rows of a group
    are numbered where they lie, from the count of those before, of which there is one a partition and group.
    """
    keys = [F.col(group).asc_nulls_first(), *(F.col(o).asc_nulls_first() for o in order), F.col("_read")]
    ranged = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.select(F.col("_part").alias("_p"), "_group", (before - F.col("_first") + 1).alias("_shift"))
    j = placed.join(start, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return j.withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_group", "_shift")


def round_robin(rows: DataFrame, bucket: list[str], ident: str, seed: int, limit: int) -> DataFrame:
    """Rows spread over buckets: every bucket's first row, then every second one, up to ``limit``."""
    o = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")).cast("binary"))
    w = Window.partitionBy(*bucket).orderBy("o", ident)
    return rows.withColumn("o", o).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).orderBy("turn", *bucket).limit(limit).drop("o")


def orphan_share(lines: DataFrame, path: str, most: float = 0.02) -> DataFrame:
    """One row (lines, orphans, share, passes): body lines without any heading above them may be a share of ``most``."""
    share = F.coalesce(F.avg((F.size(path) == 0).cast("double")), F.lit(0.0))
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.size(path) == 0).alias("orphans"), share.alias("share"), (share <= most).alias("passes"))


def prose_groups(rows: DataFrame, doc: str, seq: str, path: str, size: str, target: int) -> DataFrame:
    """Adds run and grp: rows gather while the path stays the same, and a group closes as soon as its sizes come to the target."""
    r = runs(rows, [doc], seq, path)
    return budget_groups(r, [doc, "run"], seq, size, target)


def later_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with the same key the last one. Rows are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def number_titles(lines: DataFrame, doc: str, seq: str, text: str, bare: str) -> DataFrame:
    """(doc, seq, number, title): lines that are a number alone, with the line after them as their title."""
    w = Window.partitionBy(doc).orderBy(seq)
    return lines.withColumn("title", F.lead(text).over(w)).where(F.col(text).rlike(bare)).select(doc, seq, F.col(text).alias("number"), "title")


def heading_levels(rows: DataFrame, key: list[str], size: str, keyword: Column, deepest: int = 4) -> DataFrame:
    """Adds level: the rank of the size among the key's distinct sizes, at most ``deepest``; a keyword takes a heading up by one."""
    tier = F.least(F.dense_rank().over(Window.partitionBy(*key).orderBy(F.desc(size))), F.lit(deepest))
    return rows.withColumn("level", F.greatest(F.lit(1), tier - F.when(keyword, 1).otherwise(0)))
