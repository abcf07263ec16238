"""Nested tables: literal grids, and grids built from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grids as G
from ..operators import structure
from .base import Registry, table, values

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

ONE = (("Term", "Rate", "Fee"), ("3 months", "12%", "10"), ("6 months", "", "20"))
TWO = (("Feature", "Products", "", ""), ("", "Alpha", "Beta", "Gamma"), ("Limit", "100", "200", "300"), ("Section", "", "", ""), ("Charge", "5", "5", "7"))
SINGLE = (("Name", "Only", ""), ("Amount", "", "1-5"), ("Term", "x", "y"))


def grids(spark):
    rows = [("one", [list(r) for r in ONE]), ("single", [list(r) for r in SINGLE]), ("two", [list(r) for r in TWO])]
    return spark.createDataFrame(rows, "id string, rows array<array<string>>")


@R.add("tbl01_merged_cells", "SELECT 'a;;;b' AS out")
def _(spark, sf):
    s = spark.sql("SELECT array(named_struct('text', 'a', 'span', 3), named_struct('text', 'b', 'span', 1)) AS spans")
    return s.select(F.array_join(G.expand_merged(F.col("spans")), ";").alias("out"))


@R.add("tbl02_header_depth", "SELECT * FROM (VALUES ('one', 1), ('single', 1), ('two', 2)) t(id, depth)")
def _(spark, sf):
    return grids(spark).select("id", G.header_depth(F.col("rows")).alias("depth"))


@R.add("tbl03_columns_and_banner", "SELECT * FROM (VALUES ('one', '1;2', '0', 0), ('single', '1', '0;2', 0), ('two', '1;2;3', '0', 1)) t(id, data, labels, banner)")
def _(spark, sf):
    g = grids(spark).withColumn("d", G.header_depth(F.col("rows")))
    g = g.withColumn("data", G.data_columns(F.col("rows"), F.col("d")))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
    return g.select("id", join(F.col("data")).alias("data"), join(G.label_columns(F.col("rows"), F.col("data"))).alias("labels"), G.banner_rows(F.col("rows"), F.col("d"), F.col("data")).alias("banner"))


@R.add("tbl04_serial_rows", "SELECT 'Term: 3 months — Rate: 12% — Fee: 10 ।' || chr(10) || 'Term: 6 months — Fee: 20 ।' AS out")
def _(spark, sf):
    return grids(spark).where("id = 'one'").select(G.serial_rows(F.col("rows")).alias("out"))


@R.add("tbl04_serial_rows_parts", "SELECT p_partkey, 'name: ' || p_name || ' — brand: ' || p_brand || ' — size: ' || p_size || ' ।' AS out FROM part")
def _(spark, sf):
    rows = F.array(F.array(F.lit("name"), F.lit("brand"), F.lit("size")), F.array("p_name", "p_brand", F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", G.serial_rows(rows).alias("out"))


@R.add("tbl05_serial_columns", "SELECT 'Products ।' || chr(10) || 'Section ।' || chr(10) || 'Alpha — Limit: 100; Charge: 5 ।' || chr(10) || 'Beta — Limit: 200; Charge: 5 ।' || chr(10) || 'Gamma — Limit: 300; Charge: 7 ।' AS out")
def _(spark, sf):
    return grids(spark).where("id = 'two'").select(G.serial_columns(F.col("rows")).alias("out"))


@R.add("tbl05_serial_columns_subset", "SELECT 'Products ।' || chr(10) || 'Section ।' || chr(10) || 'Beta — Limit: 200; Charge: 5 ।' AS out")
def _(spark, sf):
    return grids(spark).where("id = 'two'").select(G.serial_columns(F.col("rows"), F.array(F.lit(2))).alias("out"))


@R.add("tbl06_oversize_split", "SELECT l_orderkey, parts, row_count FROM (SELECT k AS l_orderkey, CAST(max(g) + 1 AS INT) AS parts, count(*) AS row_count FROM (WITH RECURSIVE o AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS i FROM lineitem), f AS (SELECT k, i, CASE WHEN n >= 90 THEN 0 ELSE n END AS acc, 0 AS g, CASE WHEN n >= 90 THEN 1 ELSE 0 END AS nxt FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, CASE WHEN f.acc + o.n >= 90 THEN 0 ELSE f.acc + o.n END, f.nxt, CASE WHEN f.acc + o.n >= 90 THEN f.nxt + 1 ELSE f.nxt END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1) SELECT * FROM f) GROUP BY k) WHERE parts > 1")
def _(spark, sf):
    """Rows of a large table go to parts of bounded size; a table of one part stays as it is."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    g = structure.budget_groups(rows, ["l_orderkey"], "l_linenumber", "q", 90)
    return g.groupBy("l_orderkey").agg((F.max("grp") + 1).cast("int").alias("parts"), F.count("*").alias("row_count")).where("parts > 1")


BLOCKS = values("doc seq kind bold txt", ("a", 1, "head", False, "H"), ("a", 2, "p", True, "Caption one"), ("a", 3, "p", False, "between"), ("a", 4, "table", False, ""), ("a", 5, "p", False, "x"), ("a", 6, "p", False, "y"), ("a", 7, "table", False, ""), ("b", 1, "p", True, "(k) Lettered"), ("b", 2, "p", False, "l1"), ("b", 3, "p", False, "l2"), ("b", 4, "table", False, ""))


@R.add("tbl07_own_caption", "SELECT * FROM (VALUES ('a', 4, 'Caption one'), ('a', 7, ''), ('b', 4, '(k) Lettered')) t(doc, seq, caption)")
def _(spark, sf):
    """The nearest title above with at most one paragraph between, and none beyond a table; else the nearest lettered title."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c: F.max(F.when(c, F.col("seq"))).over(w)
    title = (F.col("kind") == "p") & F.col("bold")
    lettered = title & F.col("txt").rlike("^\\(?[^\\s()]{1,2}\\)\\s*\\S")
    b = spark.sql(BLOCKS).withColumn("t", at(title)).withColumn("stop", F.coalesce(at(F.col("kind") != "p"), F.lit(0))).withColumn("l", at(lettered)).withColumn("head", F.coalesce(at(F.col("kind") == "head"), F.lit(0)))
    b = b.withColumn("tt", F.last(F.when(title, F.col("txt")), True).over(w)).withColumn("lt", F.last(F.when(lettered, F.col("txt")), True).over(w))
    near = (F.col("t") > F.col("stop")) & (F.col("seq") - F.col("t") <= 2)
    return b.where("kind = 'table'").select("doc", "seq", F.when(near, F.col("tt")).when(F.col("l") > F.col("head"), F.col("lt")).otherwise("").alias("caption"))


@R.add("tbl08_markdown_cells", "SELECT 'a;b;1;2' AS out")
def _(spark, sf):
    return spark.sql(values("s", ("text\n| a | b |\n|---|---|\n| 1 | 2 |",))).select(F.array_join(G.markdown_cells(F.col("s")), ";").alias("out"))
