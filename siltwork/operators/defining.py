"""The chunk that defines a name, not one that mentions it: additive evidence over the name's postings, best score, first of equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from . import gloss

# Points of each piece of evidence, names in a heading that then defines none, characters looked at around a name, least score.
HEADING, HEADING_END, LABEL, ITEM, VERB, TABLE, CHANGES, INTRO = 4, 2, 3, 3, 2, -2, -3, -1
CROWD, AFTER, BEFORE, LEAST = 3, 220, 12, 3
#: A label: the name, a few more characters, a colon. A list item: the name right after its mark.
LABELLED, LISTED = "^[^:\\n]{0,14}:", "(^|\\n)[ \\t]*[a-z0-9]{1,3}[).][ \\t]*$"


def postings(chunks: DataFrame, names: DataFrame, longest: int = gloss.LONGEST) -> DataFrame:
    """(name_id, alias, id): chunks whose head or body has the alias as whole words. Runs of words meet the names by equality; runs of no name are not written."""
    aliases = names.select(F.col("alias").alias("phrase")).distinct()
    said = gloss.phrases_said(chunks, "id", [gloss.words(F.col(c)) for c in ("head", "body")], aliases, longest=longest)
    met = said.select(F.col("phrase").alias("alias"), F.col("q").alias("id")).distinct()
    return met.join(names.select("name_id", "alias").distinct(), "alias").select("name_id", "alias", "id")


def evidence(chunks: DataFrame, names: DataFrame, verbs: str, changes: str, intro: str) -> DataFrame:
    """(name_id, id, ord, score, why) of every posting.

    chunks: id, ord, head, body, is_table. names: name_id, alias (lower case, words parted by one blank), any number of
    aliases a name; the best one of a chunk counts. `verbs`, `changes`, `intro`: patterns of a defining verb after the name, of a
    heading of changes, of an introduction's heading.

    A heading of the name's own counts unless it lists CROWD names or more; then one that ends with the name counts more. Only where no
    heading counts does the body: a label before a colon, else a list item. A defining verb soon after the first use in the
    body always counts. Tables, change logs and introductions count against.
    """
    held = postings(chunks, names).groupBy("id").agg(F.collect_list(F.struct("name_id", "alias")).alias("names"))
    # texts are put in lower case and parted once a chunk, not once a name, and a chunk meets its names in one row
    text = F.struct(F.array_join(gloss.words(F.col("head")), " ").alias("said"), F.lower(F.coalesce("head", F.lit(""))).alias("head"), F.lower(F.coalesce("body", F.lit(""))).alias("low"), F.coalesce("is_table", F.lit(False)).alias("is_table"))
    inside = lambda c, a: F.concat(F.lit(" "), c["said"], F.lit(" ")).contains(F.concat(F.lit(" "), a, F.lit(" ")))

    def judged(c: Column) -> Column:
        own = F.transform("names", lambda n: F.struct(n["name_id"].alias("name_id"), n["alias"].alias("alias"), inside(c, n["alias"]).alias("in_head"), F.instr(c["low"], n["alias"]).alias("at")))
        crowd = lambda ns: F.size(F.array_distinct(F.transform(F.filter(ns, lambda n: n["in_head"]), lambda n: n["name_id"])))
        return once(own, lambda ns: once(crowd(ns), lambda k: F.transform(ns, lambda n: once(around(c, n), lambda x: points(c, n, n["in_head"] & (k < CROWD), x)))))

    def around(c: Column, n: Column) -> Column:
        at = n["at"]
        return F.struct(F.substring(c["low"], at + F.length(n["alias"]), F.lit(AFTER)).alias("after"), F.substring(c["low"], F.greatest(at - BEFORE, F.lit(1)), F.least(at - 1, F.lit(BEFORE))).alias("before"))

    def points(c: Column, n: Column, own: Column, x: Column) -> Column:
        in_body = n["at"] > 0
        labelled = in_body & ~own & x["after"].rlike(LABELLED)
        found: list[tuple[Column, int, str]] = [
            (own, HEADING, "own heading"), (own & F.endswith(c["said"], n["alias"]), HEADING_END, "heading ends with it"), (labelled, LABEL, "label"), (in_body & ~own & ~labelled & x["before"].rlike(LISTED), ITEM, "list item"),
            (in_body & x["after"].rlike(verbs), VERB, "verb"), (c["is_table"], TABLE, "table"), (c["head"].rlike(changes), CHANGES, "changes"), (c["head"].rlike(intro), INTRO, "introduction"),
        ]
        why = F.filter(F.array(*(F.when(c, F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"))) for c, k, w in found)), lambda e: e.isNotNull())
        return once(why, lambda w: F.struct(n["name_id"].alias("name_id"), F.aggregate(w, F.lit(0), lambda s, e: s + e["k"]).alias("score"), F.transform(w, lambda e: e["w"]).alias("why")))

    j = chunks.join(held, "id").select("id", "ord", F.explode(once(text, judged)).alias("x")).select("x.name_id", "id", "ord", "x.score", "x.why")
    return j.groupBy("name_id", "id", "ord").agg(F.max(F.struct("score", "why")).alias("x")).select("name_id", "id", "ord", "x.score", "x.why")


def defining_chunks(chunks: DataFrame, names: DataFrame, verbs: str, changes: str, intro: str, least: int = LEAST) -> DataFrame:
    """(name_id, id, score): the chunk with most evidence, of equal ones the first by `ord`; a name that is only mentioned has null."""
    e = evidence(chunks, names, verbs, changes, intro).where(F.col("score") >= least)
    best = e.groupBy("name_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("ord"))).alias("x")).select("name_id", "x.id", "x.score")
    return names.select("name_id").distinct().join(best, "name_id", "left")
