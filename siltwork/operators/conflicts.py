"""Order-greedy removal: a row stays unless it shares a key with an earlier row that stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut


def first_independent(rows: DataFrame, order: str, keys: list[Column]) -> DataFrame:
    """(order, kept, by, why): each row, and for a dropped one the earlier kept row that bars it and the first key (from 1) they share.

    The result is that of going through the rows in order, a dropped row barring nothing. It is reached in rounds: a row
    stays once no undecided row before it shares a key, and bars all others with its keys. Rounds are as many as the
    longest chain of rows of which each waits for the one before, not as many as rows; each round's rows are those that
    the last left over. `order` is unique; a null key is no key, rows without keys stay. No group is gathered: a key of
    any number of rows is one minimum. Keys that must not meet carry a prefix of their own.
    """
    said = F.array(*(F.struct(F.lit(k).alias("why"), c.cast("string").alias("key")) for k, c in enumerate(keys, 1)))
    long = cut(rows.select(F.col(order).alias("o"), F.explode(said).alias("x")).select("o", "x.why", "x.key").where("key is not null"))
    left, kept = long.select("o", "why", "key"), []
    while not left.isEmpty():
        first = left.groupBy("key").agg(F.min("o").alias("first"))
        free = cut(left.join(first, "key").groupBy("o").agg(F.bool_and(F.col("o") == F.col("first")).alias("free")).where("free").select("o"))
        kept.append(free)
        barred = left.join(free, "o", "left_semi").select("key")
        gone = left.join(barred, "key", "left_semi").select("o").distinct()
        left = cut(left.join(gone, "o", "left_anti"))
    stays = kept[0] if kept else long.select("o").where("false")
    for more in kept[1:]:
        stays = stays.unionByName(more)
    # a key has one holder: of two rows that share it one goes
    holder = long.join(stays, "o", "left_semi").groupBy("key").agg(F.min("o").alias("by"))
    bars = long.join(holder, "key").where("by < o").groupBy("o").agg(F.min_by(F.struct("by", "why"), F.struct("why", "by")).alias("bar"))
    out = rows.select(F.col(order).alias("o")).join(bars, "o", "left")
    return out.select(F.col("o").alias(order), F.col("bar").isNull().alias("kept"), F.col("bar.by").alias("by"), F.col("bar.why").alias("why"))


def bank_drops(bank: DataFrame, order: str, answer: Column, wording: Column, evidence: Column, group: Column) -> DataFrame:
    """(order, by, reason) of the questions that only a view of the whole bank refuses.

    `wording` or `evidence`: the same answer with the same wording or the same evidence as an earlier question that stays.
    `group`: not the first question of its group of alike chunks, whether or not that one stays; this reason goes before.
    """
    pair = lambda x: F.concat_ws("\x1f", F.coalesce(answer, F.lit("")), F.coalesce(x, F.lit("")))
    # one space of keys for both: evidence may bar wording
    said = bank.select(order, pair(wording).alias("a"), pair(evidence).alias("b"), group.alias("g"))
    conflicts = first_independent(said, order, [F.col("a"), F.when(F.col("a") != F.col("b"), F.col("b"))]).where("not kept")
    heads = said.where("g is not null").groupBy("g").agg(F.min(order).alias("head"))
    twins = said.join(heads, "g").where(F.col(order) != F.col("head")).select(order, "head")
    out = conflicts.select(order, "by", "why").join(twins, order, "full_outer")
    reason = F.when(F.col("head").isNotNull(), "group").when(F.col("why") == 1, "wording").otherwise("evidence")
    return out.select(order, F.coalesce("head", "by").alias("by"), reason.alias("reason"))
