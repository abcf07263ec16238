"""Whether a reply is in its question's language: evidence by sentence, quotations apart, decided by weight, or left open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reply quotes or cites says nothing about its language.
MASKED = "\\[[^\\]\\n]*\\]|\"[^\"\\n]*\"|«[^»\\n]*»|“[^”\\n]*”"
#: A language written in a script of its own: the script decides.
SCRIPTS = {"bn": "[ঀ-৿]"}
#: Function words of languages that share the Latin script.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was"),
    "fr": ("le", "la", "les", "de", "et", "des", "un", "une", "que", "est"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "ist", "nicht", "mit"),
    "es": ("el", "la", "los", "de", "y", "que", "en", "un", "las", "es"),
}


def sentences(text: Column) -> Column:
    """Sentences and lines of a text without what it quotes or cites."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), MASKED, " ")
    return F.split(F.regexp_replace(bare, "([.!?।])\\s+", "$1\n"), "\n")


def votes(text: Column, words: dict[str, tuple[str, ...]] = FUNCTION_WORDS, scripts: dict[str, str] = SCRIPTS) -> Column:
    """Structs (lang, weight) of the sentences: the language whose script has most of the letters, else the one with most function
    words; null where none has any or two have as many. Weight is the number of words."""

    def one(s: Column) -> Column:
        low = F.lower(s)
        own = {k: F.regexp_count(s, F.lit(rx)) for k, rx in scripts.items()}
        latin = F.regexp_extract_all(low, F.lit("[a-zß-öø-ÿ]+"), F.lit(0))
        foreign = sum(own.values(), F.lit(0))

        def of(ws: Column) -> Column:
            scored = F.array(*(F.struct(F.size(F.filter(ws, lambda w: w.isin(*said))).alias("n"), F.lit(k).alias("lang")) for k, said in words.items()))
            best = F.array_max(F.transform(scored, lambda x: x["n"]))
            top = F.filter(scored, lambda x: x["n"] == best)
            lang = F.when((best > 0) & (F.size(top) == 1), F.element_at(top, 1)["lang"])
            for k, n in own.items():
                lang = F.when(n * 2 > F.length(F.array_join(ws, "")) + foreign, F.lit(k)).otherwise(lang)
            return F.struct(lang.alias("lang"), F.when(foreign > 0, F.size(F.filter(F.split(F.trim(s), "\\s+"), lambda w: w != ""))).otherwise(F.size(ws)).alias("weight"))

        return F.element_at(F.transform(F.array(latin), of), 1)

    return F.transform(sentences(text), one)


def majority(votes_: Column, langs: list[str]) -> Column:
    """The language with more than half of the decided weight, `mixed` without one, null where no sentence is decided."""

    def of(v: Column) -> Column:
        weigh = lambda keep: F.aggregate(F.filter(v, keep), F.lit(0), lambda s, x: s + x["weight"])
        total, out = weigh(lambda x: x["lang"].isNotNull()), F.lit("mixed")
        for k in langs:
            out = F.when(weigh(lambda x: x["lang"] == k) * 2 > total, F.lit(k)).otherwise(out)  # noqa: B023
        return F.when(total > 0, out)

    return F.element_at(F.transform(F.array(votes_), of), 1)


def language_match(pairs: DataFrame, question: str, reply: str, words: dict[str, tuple[str, ...]] = FUNCTION_WORDS, scripts: dict[str, str] = SCRIPTS) -> DataFrame:
    """pairs with asked, said (languages, `mixed` or null), share (of the reply's decided weight in the asked language) and ok.

    ok is null where either language is open: such a reply is in neither number of a rate. A question of mixed
    languages holds its reply to nothing either.
    """
    langs = [*words, *scripts]
    v = pairs.withColumn("_asked", votes(F.col(question), words, scripts)).withColumn("_said", votes(F.col(reply), words, scripts))
    v = v.withColumn("asked", majority(F.col("_asked"), langs)).withColumn("said", majority(F.col("_said"), langs))
    weigh = lambda keep: F.aggregate(F.filter("_said", keep), F.lit(0), lambda s, x: s + x["weight"])
    share = weigh(lambda x: x["lang"] == F.col("asked")) / F.nullif(weigh(lambda x: x["lang"].isNotNull()), F.lit(0))
    ok = F.when((F.col("asked") != "mixed") & F.col("said").isNotNull(), F.col("asked") == F.col("said"))
    return v.withColumn("share", share).withColumn("ok", ok).drop("_asked", "_said")
