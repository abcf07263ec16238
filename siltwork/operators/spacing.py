"""Greedy spacing: of marks along a document keep the first, then each that is further than a gap from the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut

#: Positions of a piece of a document that one task orders.
PIECE = 4096


def next_allowed(marks: DataFrame, doc: str, pos: str, gap: int) -> DataFrame:
    """(doc, a, b): for each distinct mark the first one more than `gap` after it; marks without one have no row.

    A document is ordered by pieces of PIECE positions, then the pieces by their first marks, so that its length bounds nothing.
    """
    at = marks.select(F.col(doc).alias("doc"), F.col(pos).cast("long").alias("p")).distinct()
    points = at.select("doc", "p", F.col("p").alias("mark"), F.lit(None).cast("long").alias("of"))
    points = points.unionByName(at.select("doc", (F.col("p") + gap + 1).alias("p"), F.lit(None).cast("long").alias("mark"), F.col("p").alias("of"))).withColumn("piece", F.floor(F.col("p") / PIECE))
    inside = F.min("mark").over(Window.partitionBy("doc", "piece").orderBy(F.desc("p")))  # marks of the same place too
    first = points.groupBy("doc", "piece").agg(F.min("mark").alias("first"))
    later = first.select("doc", "piece", F.min("first").over(Window.partitionBy("doc").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    found = points.withColumn("inside", inside).where("of is not null").join(later, ["doc", "piece"])
    return found.select("doc", F.col("of").alias("a"), F.coalesce("inside", "later").alias("b")).where("b is not null")


def spaced(marks: DataFrame, doc: str, pos: str, gap: int) -> DataFrame:
    """(doc, pos) of the marks kept, each place once.

    The kept ones are those that the first reaches by going from each to its next allowed one. Pointers are doubled: after
    round k all marks within 2^k steps are reached, so a chain of n takes log n rounds of joins and no document is one array.
    """
    jump = cut(next_allowed(marks, doc, pos, gap))
    kept = cut(marks.groupBy(F.col(doc).alias("doc")).agg(F.min(F.col(pos).cast("long")).alias("p")).where("p is not null"))
    while not jump.isEmpty():
        reached = kept.join(jump, (kept.doc == jump.doc) & (kept.p == jump.a)).select(kept.doc, F.col("b").alias("p"))
        kept = cut(kept.unionByName(reached).distinct())
        onward = jump.select("doc", F.col("a").alias("b"), F.col("b").alias("c"))
        jump = cut(jump.join(onward, ["doc", "b"]).select("doc", "a", F.col("c").alias("b")))
    return kept.select(F.col("doc").alias(doc), F.col("p").alias(pos))


def openers(lines: DataFrame, doc: str, ordinal: str, page: str, size: str, seq: str, gap: int = 2) -> DataFrame:
    """Lines that open a chapter: of each ordinal of a document the largest print, ties to the first line; of those, in page order,
    none within `gap` pages of the last one kept, nor a second one of its page. Columns: doc, ordinal, page, seq."""
    best = lines.groupBy(doc, ordinal).agg(F.min_by(F.struct(page, seq), F.struct(-F.col(size), F.col(seq))).alias("x")).select(doc, ordinal, f"x.{page}", f"x.{seq}")
    heads = cut(best.groupBy(doc, page).agg(F.min_by(F.struct(ordinal, seq), seq).alias("x")).select(doc, page, f"x.{ordinal}", f"x.{seq}"))
    return heads.join(spaced(heads, doc, page, gap), [doc, page]).select(doc, ordinal, page, seq)
