"""Numbered headings of a document: their levels, signals of a broken numbering, pages that are tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rules import reasons

# Characters of a heading at most; bounds of the signals; headings and share of a contents page.
LONGEST = 90
RESET_RATE, PER_PAGE, RATIO, FEW, REPEATS = 0.10, 0.30, 3.0, 5, 0.5
CONTENTS_LINES, CONTENTS_SHARE = 6, 0.5
_NUMBER = "^\\s*([0-9]{1,6}(?:\\.[0-9]{1,6})*+)[.)]?\\s+\\S"


def levels(text: Column) -> Column:
    """The numbers of a numbered heading, one a level, in either script's digits; null for any other line."""
    n = F.regexp_extract(T.fold_digits(text), _NUMBER, 1)
    return F.when((n != "") & (F.length(F.trim(text)) < LONGEST), F.transform(F.split(n, "\\."), lambda x: x.cast("int")))


def headings(lines: DataFrame) -> DataFrame:
    """lines (doc, page, seq, text) that are numbered headings, with levels, depth, and falls: not after the heading before it.

    Numbers are compared level by level, so that 2.10 comes after 2.9 and 2 before 2.1.
    """
    h = lines.withColumn("levels", levels(F.col("text"))).where("levels is not null").withColumn("depth", F.size("levels"))
    before = F.lag("levels").over(Window.partitionBy("doc").orderBy("seq"))
    return h.withColumn("falls", F.coalesce(F.col("levels") <= before, F.lit(False)))


def signals(lines: DataFrame, chapter: str) -> DataFrame:
    """One row a document: lines, pages, headings, falls, depth1, resets, reset_rate, chapter_lines, repeated, per_page, fails.

    resets: headings of depth 1 whose number is not above that of the one before. repeated: headings of depth 1 whose number
    another has too. `chapter` is a pattern for the word that opens a chapter, looked for in short lines. fails names the bounds
    broken, none for documents too small to tell.
    """
    size = lines.groupBy("doc").agg(F.count(F.lit(1)).alias("lines"), F.greatest(F.max("page"), F.lit(1)).alias("pages"), F.count_if((F.length(F.trim("text")) < LONGEST) & F.col("text").rlike(chapter)).alias("chapter_lines"))
    h = headings(lines.select("doc", "page", "seq", "text"))
    all_ = h.groupBy("doc").agg(F.count(F.lit(1)).alias("headings"), F.count_if("falls").alias("falls"))
    top = h.where("depth = 1").select("doc", "seq", F.col("levels")[0].alias("n"))
    before = F.lag("n").over(Window.partitionBy("doc").orderBy("seq"))
    ones = top.withColumn("reset", F.coalesce(F.col("n") <= before, F.lit(False))).groupBy("doc", "n").agg(F.count(F.lit(1)).alias("times"), F.count_if("reset").alias("resets"))
    first = ones.groupBy("doc").agg(F.sum("times").alias("depth1"), F.sum("resets").alias("resets"), F.sum(F.when(F.col("times") > 1, F.col("times")).otherwise(0)).alias("repeated"))
    j = size.join(all_, "doc", "left").join(first, "doc", "left").fillna(0, ["headings", "falls", "depth1", "resets", "repeated"])
    j = j.withColumn("reset_rate", F.col("resets") / F.greatest(F.col("depth1") - 1, F.lit(1))).withColumn("per_page", F.col("depth1") / F.col("pages"))
    d = F.col("depth1")
    fails = reasons(
        ((d >= FEW) & (F.col("reset_rate") > RESET_RATE), "resets"),
        ((F.col("chapter_lines") >= 3) & (d / F.greatest("chapter_lines", F.lit(1)) > RATIO), "chapter words"),
        (F.col("per_page") > PER_PAGE, "per page"),
        ((F.col("repeated") > d * REPEATS) & (d * REPEATS >= FEW), "repeats"),
    )
    return j.withColumn("fails", fails)


def contents_pages(lines: DataFrame, least: int = CONTENTS_LINES, share: float = CONTENTS_SHARE) -> DataFrame:
    """(doc, page, lines, headings) of pages that are mostly numbered headings."""
    per = lines.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("lines"), F.count(levels(F.col("text"))).alias("headings"))
    return per.where((F.col("headings") >= least) & (F.col("headings") >= share * F.col("lines")))
