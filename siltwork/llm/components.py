"""Connected components of a link table: contraction to leads, then least-label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of a link (a, b); label is the smallest node that links reach.

    A node first follows the smallest of its lower neighbours, its lead. Its other lower neighbours are linked with that lead
    in its place, and of equal links one is kept, so that a large group is left with links between its leads, and these alone
    are walked in rounds. A node that is itself lower than another one stays linked with its lead.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    led = cut(ends.withColumn("lead", F.min("a").over(Window.partitionBy("b"))).distinct())
    lower = led.select("a").distinct()
    follows = led.select("b", "lead").distinct()
    between = led.where("a <> lead").select("a", F.col("lead").alias("b"))
    upward = follows.where("b <> lead").join(lower, F.col("b") == F.col("a"), "left_semi").select(F.col("b").alias("a"), F.col("lead").alias("b"))
    label = passed(between.unionByName(upward).distinct())
    nodes = lower.select(F.col("a").alias("node"), F.col("a").alias("lead")).unionByName(follows.join(lower, F.col("b") == F.col("a"), "left_anti").select(F.col("b").alias("node"), "lead"))
    found = nodes.join(label.select(F.col("node").alias("lead"), "label"), "lead", "left")
    return cut(found.select("node", F.coalesce("label", "lead").alias("label")))


def passed(links: DataFrame) -> DataFrame:
    """(node, label) by passing labels over links.

    Each round passes labels over links, then replaces a label by its own label, so that a chain of
    length n takes about log n rounds. Messages to a node are combined before the shuffle.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        sent = both.join(label, both.a == label.node).select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        met = sent.unionByName(label.select("node", "label", F.col("label").alias("own"))).groupBy("node").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = cut(met.join(up, "label", "left").select("node", F.least("label", "higher").alias("label"), "own"))
        moved = not new.where("label < own").isEmpty()
        label = new.select("node", "label")
        if not moved:
            return label
