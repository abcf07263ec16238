"""Scores of answers and of retrieval: fact buckets, citations with a baseline, quiet and blind questions, tag changes, armed figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gloss, joins


def fact_buckets(facts: DataFrame, answers: DataFrame, context: DataFrame, groups: DataFrame) -> DataFrame:
    """facts with their bucket: collapsed, unjudged, unachievable, hit or missed; and ``rendered`` for scoreable ones read off a page.

    facts: qid, n, kind, text, ref, verified. answers: qid, answer. context: qid, chunk_id. groups: chunk_id, dup_group. Facts of one
    question with the same text whose refs are one chunk or copies of each other count once. A fact is unachievable where
    the question's context is known and has neither its chunk nor a copy; without ref or context nothing is known and it is scored.
    """
    g = groups.select(F.col("chunk_id").alias("c"), "dup_group")
    named = lambda df, ref: df.join(g, F.col(ref) == F.col("c"), "left").withColumn("place", F.coalesce("dup_group", ref)).drop("c", "dup_group")
    w = Window.partitionBy("qid", "text", "place")
    f = named(facts, "ref").withColumn("first", F.when(F.col("ref").isNotNull(), F.min("n").over(w)))
    held = named(context, "chunk_id").select("qid", "place").distinct().withColumn("there", F.lit(True))
    known = context.select("qid").distinct().withColumn("known", F.lit(True))
    j = f.join(held, ["qid", "place"], "left").join(known, "qid", "left").join(answers, "qid", "left")
    lost = F.col("ref").isNotNull() & F.col("known").isNotNull() & F.col("there").isNull()
    bucket = (
        F.when(F.col("first") < F.col("n"), "collapsed").when(F.col("kind").isin("claim", "absent"), "unjudged").when(lost, "unachievable")
        .when(F.col("answer").contains(F.col("text")), "hit").otherwise("missed")
    )
    return j.withColumn("bucket", bucket).withColumn("rendered", F.col("bucket").isin("hit", "missed") & (F.col("verified") == "render")).drop("first", "there", "known", "place", "answer")


def citation_accuracy(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: hit, scored, unachievable, anchored, regressions.

    rows, baseline: qid, ok, achievable, each of the two unknown where null. A pass proves that the citation could be
    had, so only failures are unachievable. anchored also counts failures that the baseline could cite;
    regressions are passes of the baseline that fail now.
    """
    b = baseline.select("qid", F.col("ok").alias("base_ok"), (F.coalesce("ok", F.lit(False)) | F.coalesce("achievable", F.lit(False))).alias("reach"))
    failed = ~F.coalesce("ok", F.lit(True))
    lost = failed & ~F.coalesce("achievable", F.lit(True))
    scored = F.col("ok").isNotNull() & ~lost
    return rows.join(b, "qid", "left").agg(
        F.count_if(F.coalesce("ok", F.lit(False))).alias("hit"), F.count_if(scored).alias("scored"), F.count_if(lost).alias("unachievable"), F.count_if(scored | (lost & F.coalesce("reach", F.lit(False)))).alias("anchored"),
        F.count_if(failed & F.coalesce("base_ok", F.lit(False))).alias("regressions"),
    )


def quiet_and_blind(ranks: DataFrame, ks: tuple[int, ...], deepest: int) -> DataFrame:
    """(k, quiet, blind): share of questions without a wrong chunk among the first k, and questions without a right one among the ``deepest``.

    ranks: qid, right, wrong, the first ranks of either, null where there is none.
    """
    k = ranks.select("wrong", "right", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return k.groupBy("k").agg(F.avg((F.coalesce("wrong", F.lit(1 << 62)) > F.col("k")).cast("int")).alias("quiet"), F.count_if(F.coalesce("right", F.lit(1 << 62)) > deepest).alias("blind"))


def probe_counts(chunks: DataFrame, text: str, probes: DataFrame, longest: int = gloss.LONGEST) -> DataFrame:
    """probes (term, min_count, category) with n, how often each comes as whole words in all texts, and met.

    A probe table of any size meets the texts' runs of up to `longest` words by equality; runs are counted within a text, then
    in one combined shuffle. Terms are in lower case with single blanks; a null min_count is 1. Every use counts, overlapping ones too.
    """
    said = chunks.select(F.explode(gloss.said_runs(F.col(text), longest)).alias("term"))
    counted = said.join(probes.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    out = probes.join(counted, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("met", F.col("n") >= F.coalesce("min_count", F.lit(1)))


def probe_coverage(counts: DataFrame) -> DataFrame:
    """(category, met, total, verdict): PASS from 0.90 of a category's probes, PARTIAL from 0.60, else FAIL."""
    g = counts.groupBy("category").agg(F.count_if("met").alias("met"), F.count(F.lit(1)).alias("total"))
    share = F.col("met") / F.col("total")
    return g.withColumn("verdict", F.when(share >= 0.9, "PASS").when(share >= 0.6, "PARTIAL").otherwise("FAIL"))


def tag_changes(chunks: DataFrame, before: tuple, after: tuple, text: str = "text") -> DataFrame:
    """(tag, added, removed) between two pattern registries, for every tag of either. Both are applied in one pass."""
    a, b = joins.pattern_tags(F.col(text), before), joins.pattern_tags(F.col(text), after)
    change = lambda x, y, k: F.transform(F.array_except(x, y), lambda t: F.struct(t.alias("tag"), F.lit(k).alias("k")))
    d = chunks.select(a.alias("a"), b.alias("b")).select(F.explode(F.concat(change(F.col("b"), F.col("a"), 1), change(F.col("a"), F.col("b"), -1))).alias("x")).select("x.*")
    every = chunks.sparkSession.createDataFrame([(t,) for t in sorted({k for k, _ in (*before, *after)})], "tag string")
    return every.join(d.groupBy("tag").agg(F.count_if(F.col("k") == 1).alias("added"), F.count_if(F.col("k") == -1).alias("removed")), "tag", "left").na.fill(0)


def armed_figures(chunks: DataFrame, clause: str, key: str, text: Column, units: str) -> DataFrame:
    """(clause, numbers, pairs, provenance, dropped): figures with a unit, per clause.

    numbers in order of value, pairs with their units, the chunks that they come from, and how many distinct numbers without a unit were left out.
    """
    number = "[0-9][0-9,]*(?:\\.[0-9]+)?"
    pairs = F.regexp_extract_all(text, F.lit(f"({number} (?:{units}))"))
    bare = F.array_except(F.regexp_extract_all(text, F.lit(f"({number})")), F.transform(pairs, lambda p: F.split(p, " ")[0]))
    d = chunks.select(clause, key, pairs.alias("pairs"), bare.alias("bare"))
    p = d.select(clause, key, F.explode("pairs").alias("pair")).withColumn("v", F.regexp_replace(F.split("pair", " ")[0], ",", ""))
    armed = p.groupBy(clause).agg(F.transform(F.array_sort(F.collect_set(F.struct(F.col("v").cast("double").alias("x"), "v"))), lambda s: s["v"]).alias("numbers"), F.array_sort(F.collect_set("pair")).alias("pairs"), F.array_sort(F.collect_set(key)).alias("provenance"))
    dropped = d.select(clause, F.explode("bare").alias("b")).groupBy(clause).agg(F.count_distinct("b").alias("dropped"))
    return armed.join(dropped, clause, "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))
