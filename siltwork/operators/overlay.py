"""Rule overlay from its tables: which rules a question falls under, which names it uses, and what the answer becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, retrieval, rules

#: Verdicts that make a rule's clause out of date, letters of a word that says something, most names that a short
#: name may fit before it is ambiguous, and the number of chunks beyond which a word is an ordinary one.
STALE = ("changed", "retired", "not_confirmed")
MIN_WORD, MAX_SHORT, ORDINARY = 4, 3, 20


def long_words(text: Column) -> Column:
    """Distinct words of at least MIN_WORD letters."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: F.length(w) >= MIN_WORD))


def term_hits(terms: Column, text: Column) -> Column:
    """How many of the terms, separated by semicolons, hold in the text; see ``joins.topic_column`` for one of them."""
    every = F.filter(F.split(terms, ";"), lambda t: F.trim(t) != "")
    return F.size(F.filter(every, lambda t: joins.topic_column(t, text)))


def in_scope(scope: Column, manuals: Column) -> Column:
    """Whether a rule's scope covers the manuals in hand: both, none known, or one that begins with it."""
    return (scope == "both") | (F.size(manuals) == 0) | F.exists(manuals, lambda m: F.startswith(m, scope))


def stale_rules(asks: DataFrame, table: DataFrame, verdicts: tuple[str, ...] = STALE) -> DataFrame:
    """(qid, rule_id, hits, fit): rules that make a retrieved clause out of date and are about the question.

    asks: qid, question, clauses, manuals. table: rule_id, manual, clause (several by semicolons), verdict,
    topic_terms, rule_summary, current_rule. The clauses meet by equality. fit counts the long words that
    question and rule share.
    """
    r = table.where(F.col("verdict").isin(*verdicts)).withColumn("clause", F.explode(F.split("clause", ";")))
    a = asks.withColumn("clause", F.explode("clauses"))
    on = in_scope(F.col("manual"), F.col("manuals")) & joins.topic_column(F.col("topic_terms"), F.col("question"))
    shared = F.size(F.array_intersect(long_words(F.col("question")), long_words(F.concat_ws(" ", "rule_summary", "current_rule"))))
    return a.join(r, "clause").where(on).select("qid", "rule_id", term_hits(F.col("topic_terms"), F.col("question")).alias("hits"), shared.alias("fit"), "current_rule").distinct()


def named(asks: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, name_id): names that a question gives in full. The names are a stated set and go out in blocks."""
    return retrieval.against(asks.select("qid", "question"), names.select("name_id", "name"), F.col("question").contains(F.col("name"))).select("qid", "name_id")


def withheld(asks: DataFrame, table: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, item, why, hits, says): what is not given out and the question falls under.

    table: item, manual, clause, topic_terms, says, reason. Three ways in, all behind topic and scope: a
    retrieved clause; else a name that question and item share together with a long word of what is said;
    else, for items without clause and questions that name nothing, a term of several words. Items on a
    shared clause defer to the one with the most term hits; ties stay.
    """
    about = in_scope(F.col("manual"), F.col("manuals")) & joins.topic_column(F.col("topic_terms"), F.col("question"))
    met = retrieval.against(asks, table, about).withColumn("hits", term_hits(F.col("topic_terms"), F.col("question")))
    listed = F.filter(F.split("clause", ";"), lambda c: c != "")
    met = met.withColumn("shared", F.array_intersect("clauses", listed)).withColumn("by", F.size("shared") > 0)
    given = named(asks, names).join(names.select("name_id", "name"), "name_id").groupBy("qid").agg(F.collect_set("name").alias("given"))
    rest = met.where("not by").join(given, "qid", "left")
    subject = F.concat_ws(" ", "reason", "says")
    same = F.exists(F.coalesce("given", F.array().cast("array<string>")), lambda n: subject.contains(n)) & F.arrays_overlap(long_words(F.col("question")), long_words(F.col("says")))
    several = F.exists(F.filter(F.split("topic_terms", ";"), lambda t: t.contains("+")), lambda t: joins.topic_column(t, F.col("question")))
    general = (F.size(listed) == 0) & F.col("given").isNull() & several
    rest = rest.withColumn("why", F.when(same, "subject").when(general, "general")).where("why is not null").select("qid", "item", "why", "hits", "says")
    w = Window.partitionBy("qid", "one")
    ranked = met.where("by").withColumn("one", F.explode("shared")).withColumn("best", F.max("hits").over(w))
    first = ranked.groupBy("qid", "item", "hits", "says").agg(F.bool_and(F.col("hits") == F.col("best")).alias("stays")).where("stays")
    return first.select("qid", "item", F.lit("clause").alias("why"), "hits", "says").unionByName(rest)


def phrases(asks: DataFrame, heads: tuple[str, ...], stops: tuple[str, ...], window: int = 3) -> DataFrame:
    """(qid, head, words): for each head noun of a question the describing words before it, back to a stop word."""
    t = asks.select("qid", F.split("question", " ").alias("t")).select("qid", "t", F.posexplode("t").alias("spot", "head"))
    back = F.when(F.col("spot") > 0, F.reverse(F.slice("t", F.greatest(F.col("spot") - window + 1, F.lit(1)), F.least(F.col("spot"), F.lit(window)))))
    stop = F.array_position(F.transform(back, lambda w: w.isin(*stops, *heads)), F.lit(True)).cast("int")
    words = F.when(stop > 0, F.slice(back, 1, stop - 1)).otherwise(back)
    return t.where(F.col("head").isin(*heads)).select("qid", "spot", "head", F.array_distinct(words).alias("words")).where("size(words) > 0")


def short_names(found: DataFrame, names: DataFrame, generic: tuple[str, ...], most: int = MAX_SHORT) -> DataFrame:
    """(qid, spot, name_id, fit, ambiguous): names of the head noun's kind that share most of a phrase's words; ties stay.

    Generic words count only where a phrase has no others. More than ``most`` best fits are ambiguous. Words
    meet by equality of stems, see ``names``: name_id, kind, words.
    """
    own = F.filter("words", lambda w: ~w.isin(*generic))
    use = F.when(F.size(own) > 0, own).otherwise(F.col("words"))
    p = found.select("qid", "spot", F.col("head").alias("kind"), F.explode(use).alias("w"))
    n = names.select("name_id", "kind", F.explode(F.array_distinct("words")).alias("w"))
    fit = p.join(n, ["kind", "w"]).groupBy("qid", "spot", "name_id").agg(F.count("*").cast("int").alias("fit"))
    best = fit.withColumn("r", F.rank().over(Window.partitionBy("qid", "spot").orderBy(F.desc("fit")))).where("r = 1").drop("r")
    return best.withColumn("ambiguous", F.count("*").over(Window.partitionBy("qid", "spot")) > most)


def unknown_names(found: DataFrame, fits: DataFrame, frequency: DataFrame, ordinary: int = ORDINARY) -> DataFrame:
    """(qid, spot, words): phrases that no name fits and that have a word in at most ``ordinary`` chunks; frequency: term, df."""
    lone = found.join(fits.select("qid", "spot").distinct(), ["qid", "spot"], "left_anti").select("qid", "spot", F.explode("words").alias("term"))
    rare = lone.join(frequency, "term", "left").where(F.coalesce("df", F.lit(0)) <= ordinary)
    return rare.groupBy("qid", "spot").agg(F.array_sort(F.collect_list("term")).alias("words"))


def overlay(asks: DataFrame, stale: DataFrame, kept_back: DataFrame, names: DataFrame, full: DataFrame, ambiguous: DataFrame, unknown: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """(qid, fired, answer): what the rules make of a draft answer, in their order of precedence.

    An unknown name answers alone unless something is withheld. Withheld items by clause give way to a stale
    rule that fits better by (term hits, shared words); those that stay answer alone. Then an ambiguous name; then
    the status lines of names in full before the answer, which stale rules of the best fit replace. Old terms
    are substituted in what was put together.
    """
    best = stale.groupBy("qid").agg(F.max(F.struct("hits", "fit")).alias("best"), F.max("fit").alias("top"))
    lines = stale.join(best, "qid").where("fit = top").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "current_rule"))), lambda x: x["current_rule"]).alias("lines"))
    w = kept_back.join(asks.select("qid", "question"), "qid").withColumn("own", F.struct("hits", F.size(F.array_intersect(long_words(F.col("question")), long_words(F.col("says")))).alias("fit")))
    w = w.join(best, "qid", "left").withColumn("stays", (F.col("why") != "clause") | F.col("best").isNull() | (F.col("own") >= F.col("best")))
    says = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("item", "says")))), lambda x: x["says"]))
    w = w.groupBy("qid").agg(says.alias("says"))
    status = full.join(names.select("name_id", "status_line"), "name_id").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("name_id", "status_line"))), lambda x: x["status_line"]).alias("status"))
    d = asks.join(w, "qid", "left").join(lines, "qid", "left").join(status, "qid", "left")
    d = d.join(ambiguous.select("qid").distinct().withColumn("unclear", F.lit(True)), "qid", "left").join(unknown.select("qid").distinct().withColumn("no_name", F.lit(True)), "qid", "left")
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce("status", none), F.coalesce("lines", F.array("answer")))
    no_name = F.col("no_name").isNotNull() & F.col("says").isNull()
    kept = F.size(F.coalesce("says", none)) > 0
    changed, used = rules.substitute_terms(F.array_join(F.when(kept, F.col("says")).otherwise(parts), " "), terms)
    text = F.when(no_name, "no such name").when(~kept & F.col("unclear").isNotNull(), "which one?").otherwise(changed)
    term = F.when(F.size(used) > 0, "3:term_updates")
    tail = F.array(F.when(F.col("status").isNotNull(), "1:product_status"), F.when(F.col("lines").isNotNull(), "2:rule_updates"), term)
    fired = F.when(no_name, F.array(F.lit("6:unknown_product"))).when(kept, F.array(F.lit("4:not_available"), term)).when(F.col("unclear").isNotNull(), F.array(F.lit("1:ambiguous_product"))).otherwise(tail)
    return d.select("qid", F.array_join(F.filter(fired, lambda x: x.isNotNull()), ";").alias("fired"), text.alias("answer"))


def violations(answers: DataFrame, literals: Column, figures: Column, roles: Column, allowed: Column, found: Column) -> DataFrame:
    """answers with ``violations``: literal:, clause_figure: and clause_role: entries.

    ``found`` are the answer's figures with units; a bare number is never compared. A role that the allowed
    text names is no violation, nor is one inside a longer role that is.
    """
    a = F.col("answer")
    hit = F.filter(roles, lambda r: a.contains(r) & ~allowed.contains(r))
    roles_hit = F.filter(hit, lambda r: ~F.exists(hit, lambda o: (o != r) & o.contains(r)))
    mark = lambda xs, kind: F.transform(xs, lambda x: F.concat(F.lit(kind + ":"), x))
    return answers.withColumn("violations", F.concat(mark(F.filter(literals, lambda w: a.contains(w)), "literal"), mark(F.array_intersect(found, figures), "clause_figure"), mark(roles_hit, "clause_role")))


def post_filter(answers: DataFrame, instead: str) -> DataFrame:
    """Answers with violations are replaced; what was replaced is kept in ``original``."""
    bad = F.size("violations") > 0
    return answers.withColumn("original", F.when(bad, F.col("answer"))).withColumn("answer", F.when(bad, F.lit(instead)).otherwise(F.col("answer")))


def omitted_labels(answers: DataFrame, headings: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, label): labels that a cited heading names and the answer doesn't. answers: qid, answer; headings: qid, heading."""
    named = retrieval.against(headings, labels, F.col("heading").contains(F.col("label"))).select("qid", "label").distinct()
    return named.join(answers, "qid").where(~F.col("answer").contains(F.col("label"))).select("qid", "label")
