"""Site-relative line frequency: lines that too large a share of a host's pages holds are boilerplate. Native only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A line of more than this share of its host's pages is dropped, where so many pages hold it.
RATIO, PAGES = 0.02, 5
#: So many boilerplate lines may be broadcast (16 bytes each, with their host); more are joined by shuffle.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """(host, key) of the lines to drop: md5 of the trimmed line. A page counts once for a line however often it has it."""
    own = docs.select(host.alias("host"), F.coalesce(text.cast("string"), F.lit("")).alias("t"))
    lines = own.select("host", F.explode(F.array_distinct(F.transform(F.split("t", "\n", -1), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    held = lines.groupBy("host", _key(F.col("line")).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= pages)
    total = own.groupBy("host").agg(F.count("*").alias("total"))
    return held.join(total, held.host.eqNullSafe(total.host)).where(F.col("n") > ratio * F.col("total")).select(held.host, "key")


def drop_boilerplate(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, pages: int = PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row per input row: doc_id, host, n_lines, n_dropped, text (without the lines dropped).

    Lines are split at \\n and compared after trimming blanks; empty lines are never dropped and stay. A
    null host is a host of its own; a null text is an empty one, of one empty line. Repeated rows are
    pages of their own. Other columns are ignored, so none can clash.

    A host has at most (distinct lines of a page) / ratio lines to drop on average, so its list is short
    however many pages it has.
    """
    drops = cut(boilerplate(docs, host, F.col(text_col), ratio, pages))
    lists = drops.groupBy("host").agg(F.collect_list("key").alias("drop")).select(F.col("host").alias("h"), "drop")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    if drops.count() <= broadcast_lines:
        lists = F.broadcast(lists)
    j = src.join(lists, src.host.eqNullSafe(F.col("h")), "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<binary>")))
    lines = j.withColumn("lines", F.split("t", "\n", -1))
    kept = lines.withColumn("kept", F.when(F.size("drop") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("drop", _key(F.trim(x))))))
    return kept.select("doc_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


OP3_SQL = f"""
WITH l AS (SELECT DISTINCT d.doc_id, d.source, trim(x.line, ' ') AS line FROM documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) AS x(line)),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT l.source, l.line FROM l JOIN t ON l.source = t.source WHERE l.line <> '' GROUP BY l.source, l.line, t.total HAVING count(*) >= {PAGES} AND count(*) > {RATIO} * t.total),
f AS (SELECT source, list(line) AS lines FROM b GROUP BY source),
s AS (SELECT d.doc_id, d.source AS host, string_split(coalesce(d.text, ''), chr(10)) AS xs, coalesce(f.lines, []) AS ys FROM documents d LEFT JOIN f ON d.source = f.source)
SELECT doc_id, host, len(xs) AS n_lines, len(xs) - len(list_filter(xs, lambda x: NOT list_contains(ys, trim(x, ' ')))) AS n_dropped,
  array_to_string(list_filter(xs, lambda x: NOT list_contains(ys, trim(x, ' '))), chr(10)) AS text
FROM s
"""
