"""Pieces of the rule overlay: terms, reasons, fingerprints, reply guards, term sheets, context blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval

#: Fixed value: attempts at a reply.
ATTEMPTS = 3


def substitute_terms(text: Column, terms: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(text with old terms replaced, the pairs used), in the table's order."""
    new = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), terms, text)
    # a pair is used if the text has it when its turn comes
    used, t = [], text
    for old, to in terms:
        used.append(F.when(t.contains(old), F.lit(f"{old}>{to}")))
        t = F.replace(t, F.lit(old), F.lit(to))
    return new, F.filter(F.array(*used), lambda x: x.isNotNull())


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the checks that fail, in their order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)), lambda x: x.isNotNull())


def fingerprint(*cols) -> Column:
    """Digest of fields, each followed by a separator, so that no shift of text between fields goes unseen."""
    return F.sha2(F.concat(*(x for c in cols for x in (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("\x1f")))), 256)


def attempts(replies: DataFrame, key: str, order: str, text: str, most: int = ATTEMPTS) -> DataFrame:
    """(key, order, cut_off, loops, attempt, taken): replies in turn up to the first that neither loops nor is cut off, or the last allowed."""
    t = F.regexp_replace(text, "^[ \n]+|[ \n]+$", "")
    w = Window.partitionBy(key).orderBy(order)
    f = replies.select(key, order, (~t.rlike("[.!?।]$")).alias("cut_off"), T.has_loop(t, longest=1).alias("loops")).withColumn("attempt", F.row_number().over(w))
    good = F.min(F.when(~F.col("cut_off") & ~F.col("loops"), F.col("attempt"))).over(Window.partitionBy(key))
    last = F.least(F.coalesce(good, F.lit(most)), F.lit(most), F.max("attempt").over(Window.partitionBy(key)))
    return f.withColumn("last", last).where("attempt <= last").withColumn("taken", F.col("attempt") == F.col("last")).drop("last")


def term_sheet(chunks: DataFrame, questions: DataFrame, terms: list[str], letters: str = "a-zA-Z") -> DataFrame:
    """(term, first_use, first_source, docs, uses, inflated, chats), terms without a use too.

    inflated: more than half of the uses are within longer words to the right. The texts are read once for all terms.
    """
    quoted = {t: "\\Q" + t + "\\E" for t in terms}
    one = lambda t: F.struct(F.lit(t).alias("term"), F.regexp_count("text", F.lit(quoted[t])).alias("n"), F.regexp_count("text", F.lit(f"{quoted[t]}(?![{letters}])")).alias("whole"))
    used = chunks.select("doc_id", "source", F.explode(F.array(*map(one, terms))).alias("x")).select("doc_id", "source", "x.*").where("n > 0")
    per = used.groupBy("term").agg(F.min("doc_id").alias("first_use"), F.min_by("source", "doc_id").alias("first_source"), F.count("*").alias("docs"), F.sum("n").cast("long").alias("uses"), (F.sum("n") > 2 * F.sum("whole")).alias("inflated"))
    asked = questions.agg(*(F.count_if(F.col("text").contains(t)).alias(f"n{i}") for i, t in enumerate(terms))).select(F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"n{i}").alias("chats")) for i, t in enumerate(terms)))).alias("x")).select("x.*")
    zero = F.lit(0)
    j = asked.join(per, "term", "left")
    return j.select("term", "first_use", "first_source", F.coalesce("docs", zero).alias("docs"), F.coalesce("uses", zero).alias("uses"), F.coalesce("inflated", F.lit(False)).alias("inflated"), "chats")


def context_blocks(chunks: DataFrame, key: str, order: str, label: str, text: str) -> DataFrame:
    """(key, block): a question's chunks in order, each under its number and label, blank lines between them."""
    line = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] ("), F.col(label), F.lit(")\n"), F.col(text))
    rows = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n\n").alias("block"))


def glossary(chunks: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, glossary): the glosses of the terms that a context has, a line each. The terms are a stated set."""
    met = retrieval.against(chunks.select(key, F.col(text).alias("context")), terms, F.col("context").contains(F.col("term")))
    lines = F.array_sort(F.collect_set(F.concat("term", F.lit(": "), "gloss")))
    return met.groupBy(key).agg(F.array_join(lines, "\n").alias("glossary"))
