"""Joins that aren't plain equality: patterns, topics, containment, prefixes, versions, nearest vectors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship
from . import retrieval


#: Shares that the chunks of a section are dealt over.
SHARES = 32


def pattern_tags(text: Column, patterns) -> Column:
    """Keys of the patterns found, in the registry's order; one pass over the text a pattern, no join."""
    return F.filter(F.array(*(F.when(text.rlike(rx), F.lit(k)) for k, rx in patterns)), lambda x: x.isNotNull())


def name_alternation(names: list[str]) -> str:
    """One case-insensitive pattern for names, longest first, blanks of any length."""
    parts = [r"\s+".join(re.escape(w) for w in n.split()) for n in sorted(set(names), key=lambda n: (-len(n), n)) if n.strip()]
    return "(?i)(?:" + "|".join(parts) + ")" if parts else "(?!)"


def topic(terms: str, text: Column, products: dict[str, str]) -> Column:
    """Semicolons separate terms of which one must hold; a+b|c needs a and one of b, c; product:key its pattern. No terms: never."""
    out = F.lit(False)
    for term in filter(None, (t.strip() for t in terms.split(";"))):
        hold = F.lit(True)
        for part in term.split("+"):
            any_ = F.lit(False)
            for alt in part.split("|"):
                any_ = any_ | (text.rlike(products[alt[8:]]) if alt.startswith("product:") else text.contains(alt))
            hold = hold & any_
        out = out | hold
    return out


def topic_column(terms: Column, text: Column) -> Column:
    """topic() where the terms are a column."""
    every = F.filter(F.split(terms, ";"), lambda t: F.trim(t) != "")
    return F.exists(every, lambda t: F.forall(F.split(t, "\\+"), lambda p: F.exists(F.split(p, "\\|"), lambda a: text.contains(F.trim(a)))))


def containment(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, label, first_exact): exact, normalised or absent, and the first document that holds the item as it is.

    Texts are sought by three of their first words in lower case among the documents' three-word runs, which
    are zipped from shifted words without a shuffle; only documents that share them are compared.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "\\s+", " ")
    i = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("it")).withColumn("w", F.filter(F.split(norm("it"), " "), lambda x: x != ""))
    # whole words between the item's ends, which may be parts of words
    i = i.withColumn("key", F.when(F.size("w") >= 5, F.array_join(F.slice("w", 2, 3), " ")))
    d = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("dt"))
    words = d.select("id", F.filter(F.split(norm("dt"), " "), lambda x: x != "").alias("w"))
    runs = F.arrays_zip(*(F.slice("w", k + 1, F.greatest(F.size("w") - 2, F.lit(1))).alias(f"w{k}") for k in range(3)))
    grams = words.where("size(w) >= 3").select("id", F.explode(F.array_distinct(F.transform(runs, lambda x: F.concat_ws(" ", x["w0"], x["w1"], x["w2"])))).alias("key"))
    keys = i.select("key").distinct()
    cand = grams.join(keys, "key", "left_semi").join(i.where("key is not null").select("item_id", "key", "it"), "key").select("item_id", "id", "it")
    short = i.where("key is null").select("item_id", "it")
    pairs = cand.join(d, "id")
    pairs = pairs.unionByName(retrieval.against(d, short, norm("dt").contains(norm("it"))).select("id", "item_id", "it", "dt"))
    exact, alike = F.col("dt").contains(F.col("it")), norm("dt").contains(norm("it"))
    found = pairs.groupBy("item_id").agg(F.min(F.when(exact, F.col("id"))).alias("first_exact"), F.max(alike.cast("int")).alias("alike"))
    label = F.when(F.col("first_exact").isNotNull(), "exact").when(F.col("alike") == 1, "normalised").otherwise("absent")
    return i.select("item_id").join(found, "item_id", "left").select("item_id", label.alias("label"), "first_exact")


def unique_prefix(queries: DataFrame, scope: str, names: DataFrame, name: str) -> DataFrame:
    """Each scope with the one name that it begins; null where none or several do. Names give out their prefixes, so the join is one of equality."""
    n = names.select(F.col(name).alias("_n")).distinct()
    heads = n.select("_n", F.explode(F.transform(F.sequence(F.lit(0), F.length("_n")), lambda k: F.substring(F.col("_n"), F.lit(1), k))).alias(scope))
    j = queries.join(heads, scope, "left")
    return j.groupBy(scope).agg(F.when(F.count("_n") == 1, F.min("_n")).alias("resolved"))


def drift(manifest: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, state): ok, drift, unknown (not in the manifest), orphan (not in the corpus)."""
    j = manifest.select("id", F.col("sha").alias("m")).join(corpus.select("id", F.col("sha").alias("c")), "id", "full_outer")
    return j.select("id", F.when(F.col("c").isNull(), "orphan").when(F.col("m").isNull(), "unknown").when(F.col("m") == F.col("c"), "ok").otherwise("drift").alias("state"))


def cache_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, state): reused, changed, added, removed; only changed and added rows are to be computed again."""
    j = old.select("id", F.col("sha").alias("o")).join(new.select("id", F.col("sha").alias("n")), "id", "full_outer")
    return j.select("id", F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(F.col("o") == F.col("n"), "reused").otherwise("changed").alias("state"))


def nearest(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score): the point of greatest dot product. Each task keeps one best row a query."""
    return retrieval.dense_top(points, queries, 1).select("qid", "id", F.round("score", 6).alias("score"))


def align_lines(ref: DataFrame, hyp: DataFrame, least: float) -> DataFrame:
    """(page, ref, hyp): lines matched one to one, best similarity first, none under ``least``."""

    def one(page, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        pairs = sorted(((SequenceMatcher(None, a.line, b.line).ratio(), a.k, b.k) for a in left.itertuples() for b in right.itertuples()), key=lambda x: (-x[0], x[1], x[2]))
        a_used, b_used, out = set(), set(), []
        for s, a, b in pairs:
            if s >= least and a not in a_used and b not in b_used:
                a_used.add(a)
                b_used.add(b)
                out.append((page[0], a, b))
        return pd.DataFrame(out, columns=["page", "ref", "hyp"])

    ship(ref.sparkSession)
    return ref.groupBy("page").cogroup(hyp.groupBy("page")).applyInPandas(one, "page int, ref int, hyp int")


def swallowed(vocabulary: DataFrame, col: str) -> DataFrame:
    """(term, n): terms that n longer ones contain, by an equality join on substrings of the lengths that terms have."""
    v = vocabulary.select(F.col(col).alias("w"))
    sizes = v.select(F.length("w").alias("n")).distinct()
    subs = v.join(F.broadcast(sizes), F.col("n") < F.length("w"))  # as many rows as there are lengths
    parts = subs.select("w", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.substring(F.col("w"), i, F.col("n"))))).alias("term"))
    return parts.join(v.select(F.col("w").alias("term")), "term").groupBy("term").agg(F.count("*").alias("n"))


def leaks(written: DataFrame, key: str, excluded: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, column, what): what must not be in a written table: excluded ids, and withheld spans in any text column.

    excluded: ``key``. spans, a stated set: span. An empty result is a pass; ``sinks.gate`` stops on any other.
    """
    texts = [f.name for f in written.schema.fields if f.dataType.simpleString() == "string"]
    ids = written.join(excluded.select(key).distinct(), key, "left_semi").select(key, F.lit(key).alias("column"), F.lit("excluded id").alias("what"))
    long = written.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("said")) for c in texts))).alias("x")).select(key, "x.*")
    held = retrieval.against(long, spans.select("span"), F.col("said").contains(F.col("span")))
    return ids.unionByName(held.select(key, "column", F.concat(F.lit("span: "), "span").alias("what")))


def near_miss(chunks: DataFrame, gold: DataFrame, key: str, family: str, path: str) -> DataFrame:
    """(qid, key): chunks of the gold clause's family with any heading that begins with the clause. gold, a stated set: qid, clause, family."""
    g = gold.select("qid", "clause", F.col("family").alias("gold_family"))
    on = F.startswith(F.col(family), F.col("gold_family")) & F.exists(path, lambda x: F.startswith(x, F.col("clause")))
    return retrieval.against(chunks.select(key, family, path), g, on).select("qid", key).distinct()


def section(clause: Column, depth: int = 2) -> Column:
    """The first numbers of a dotted clause."""
    return F.array_join(F.slice(F.split(clause, "\\."), 1, depth), ".")


def related(chunks: DataFrame, products: DataFrame) -> DataFrame:
    """Chunks (clause, scope, others) with the products (product, clause, scope) of their section whose scope covers them.

    Sections are few and their pairs many, so each section is dealt over SHARES shares of its chunks, every one of which
    gets all its products; the number of partitions is given, since small inputs with a large result would be merged into one.
    """
    tasks = SHARES * products.sparkSession.sparkContext.defaultParallelism
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    p = products.select("product", section(F.col("clause")).alias("section"), F.col("scope").alias("product_scope"), shares.alias("share"))
    c = chunks.withColumn("section", section(F.col("clause"))).withColumn("share", F.pmod(F.xxhash64(*chunks.columns), F.lit(SHARES)).cast("int"))
    dealt = c.repartition(tasks, "section", "share").join(p.repartition(tasks, "section", "share").hint("shuffle_hash"), ["section", "share"])
    return dealt.where((F.col("product_scope") == "both") | F.startswith("scope", "product_scope")).drop("share")


def scoped_manuals(questions: DataFrame, manuals: DataFrame, wide: tuple[str, ...] = ("any", "both", "ambiguous")) -> DataFrame:
    """(qid, manual_id): the manuals that a question's scopes mean, a prefix of either by the other; all of them for a wide scope,
    none, or one that fits nothing. questions: qid, scopes. manuals, a small stated table: manual_id."""
    known = questions.crossJoin(F.broadcast(manuals.agg(F.array_sort(F.collect_set("manual_id")).alias("known"))))  # one row
    fits = F.filter("known", lambda m: F.exists("scopes", lambda s: F.startswith(m, s) | F.startswith(s, m)))
    every = F.col("scopes").isNull() | F.arrays_overlap("scopes", F.array(*map(F.lit, wide))) | (F.size(fits) == 0)
    return known.select("qid", F.explode(F.when(every, F.col("known")).otherwise(fits)).alias("manual_id"))


def search_filter(chunks: DataFrame, excluded: DataFrame, key: str, manual: Column | None = None, pattern: str | None = None, tag: tuple[str, str] | None = None) -> DataFrame:
    """Chunks a search may give: not excluded, of the manual, whose text has the pattern, and whose tags hold the value or are empty."""
    out = chunks.join(excluded.select(key).distinct(), key, "left_anti")
    if manual is not None:
        out = out.where(manual)
    if pattern is not None:
        out = out.where(F.col("text").rlike(pattern))
    if tag is not None:
        out = out.where((F.size(tag[0]) == 0) | F.array_contains(tag[0], tag[1]))
    return out
