"""Checks of a question bank: reasons against a question, drops, distractors, audits, review states, gold lints, translations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .rules import fingerprint, reasons

#: Fixed value: a distractor is at most so many times the answer, or the answer so many times it.
MAX_RATIO = 10
_DIGITS = "[0-9০-৯]"
# Signs between the ends of a range, and characters on either side of a figure that they are looked for in.
BESIDE = 14
RANGE = "-|–|—|থেকে|হতে|পর্যন্ত| to "


def number_of(span: Column) -> Column:
    """The number that a figure begins with, without group signs; null without one."""
    return F.regexp_replace(F.regexp_extract(T.fold_digits(span), "[0-9][0-9,]*(?:\\.[0-9]+)?", 0), ",", "").try_cast("double")


def unit_of(span: Column) -> Column:
    """What stands after the number."""
    return F.trim(F.regexp_replace(span, f"^{_DIGITS}[0-9০-৯,.]*", ""))


def range_end(span: Column, segment: Column, units: str = T.UNITS) -> Column:
    """Whether some use of the figure in the segment is one end of a range.

    A sign of a range stands beside it, and with it after the figure a number with its unit, or before the figure any
    number. All places of the figure count, overlapping ones too; an empty figure has none.
    """
    n = F.length(span)
    places = F.sequence(F.lit(1), F.greatest(F.length(segment) - n + 1, F.lit(1)))

    def end(i: Column) -> Column:
        before, after = F.substring(segment, F.greatest(i - BESIDE, F.lit(1)), F.least(i - 1, F.lit(BESIDE))), F.substring(segment, i + n, F.lit(BESIDE))
        low = after.rlike(RANGE) & after.rlike(f"{_DIGITS}[0-9০-৯,.]*\\s*(?:{units})")
        return (F.substring(segment, i, n) == span) & (low | (before.rlike(RANGE) & before.rlike(_DIGITS)))

    return (n > 0) & segment.contains(span) & F.exists(places, end)


def zero(span: Column) -> Column:
    """A placeholder: digits, and all of them 0."""
    digits = F.regexp_replace(T.fold_digits(span), "[^0-9]", "")
    return digits.rlike("^0+$")


def leaks(question: Column, correct: Column, kind: Column) -> Column:
    """Whether the question hands over its answer: a figure's number of two or more signs, or all longer words of a role."""
    numbers = F.filter(F.regexp_extract_all(correct, F.lit(f"({_DIGITS}[0-9০-৯,.]*)")), lambda n: F.length(n) >= 2)
    words = F.filter(F.split(correct, " "), lambda w: F.length(w) >= 3)
    return F.when(kind == "figure", F.exists(numbers, lambda n: question.contains(n))).otherwise((F.size(words) > 0) & F.forall(words, lambda w: question.contains(w)))


#: Endings that mark a name as acted upon.
OBJECT_ENDINGS = ("কে", "দের", "কেই", "র", "এর", "ের", "-র", "’র")


def is_agent(name: Column, segment: Column, endings: tuple[str, ...] = OBJECT_ENDINGS) -> Column:
    """Whether no use of the name in the segment has an ending of an object, nor stands in a group by slashes."""
    marked = F.lit(False)
    for e in endings:
        marked = marked | segment.contains(F.concat(name, F.lit(e)))
    return ~marked & ~segment.contains(F.concat(F.lit("/"), name)) & ~segment.contains(F.concat(name, F.lit("/")))


def answer_rejects(bank: DataFrame, units: str) -> DataFrame:
    """bank with ``rejects``: range, zero, leak, and rivals:n of the same unit in the explanation."""
    q, c, seg = (F.col(x) for x in ("question", "correct", "explanation"))
    figure = F.col("kind") == "figure"
    rivals = F.size(F.filter(F.array_distinct(spans(seg, units)), lambda s: (s != c) & (unit_of(s) == unit_of(c))))
    r = reasons((figure & range_end(c, seg, units), "range"), (figure & zero(c), "zero"), (leaks(q, c, F.col("kind")), "leak"))
    return bank.withColumn("rejects", F.when(figure & (rivals > 0), F.concat(r, F.array(F.concat(F.lit("rivals:"), rivals.cast("string"))))).otherwise(r))


def approved(rows: DataFrame, reviews: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows with an approval whose fingerprint is that of their present fields. reviews: key, status, fingerprint."""
    yes = reviews.where("status = 'approved'").select(key, "fingerprint")
    return rows.join(yes, key).where(fingerprint(*(F.col(f).cast("string") for f in fields)) == F.col("fingerprint")).drop("fingerprint")


def spans(text: Column, units: str) -> Column:
    """Figures with a unit, as they stand."""
    return F.regexp_extract_all(text, F.lit(f"({_DIGITS}[0-9০-৯,.]* (?:{units}))"))


def validate(bank: DataFrame, units: str) -> DataFrame:
    """bank with ``reasons``, empty where a question may be written.

    bank: kind, question, correct, options, explanation, chunk_text, excluded. For figures also: no end of a
    range, no zero, and no other figure of the same unit in the explanation.
    """
    q, c, o, seg = (F.col(x) for x in ("question", "correct", "options", "explanation"))
    wrong = F.filter(o, lambda x: x != c)
    figure = F.col("kind") == "figure"
    rivals = F.size(F.filter(F.array_distinct(spans(seg, units)), lambda s: (s != c) & (unit_of(s) == unit_of(c))))
    r = reasons(
        (~F.col("chunk_text").contains(c), "answer not in chunk"),
        (F.exists(wrong, lambda d: F.col("chunk_text").contains(d)), "distractor in chunk"),
        (F.size(F.array_distinct(F.transform(o, lambda x: F.lower(F.trim(x))))) != 4, "options not distinct"),
        (F.size(o) != 4, "not four options"),
        (F.col("excluded"), "chunk withheld"),
        (F.trim(q) == "", "no question"),
        (leaks(q, c, F.col("kind")), "question has answer"),
        (~seg.contains(c), "answer not in explanation"),
        (figure & range_end(c, seg, units), "end of a range"),
        (figure & zero(c), "zero"),
        (figure & (rivals > 0), "rivals of the same unit"),
    )
    return bank.withColumn("reasons", r)


def recheck_kind(bank: DataFrame, pool: DataFrame, roles: DataFrame, units: str) -> DataFrame:
    """(id, reasons) of the rules of a question's kind, on built questions.

    Figures: answer and distractors are figures of the pool (span). Roles: the explanation names the answer
    and no other role (role); a role table is small and stated.
    """
    named = F.array_sort(F.collect_set("role"))
    r = bank.where("kind = 'role'").crossJoin(F.broadcast(roles.agg(named.alias("roles"))))  # one row
    inside = F.filter("roles", lambda x: F.col("explanation").contains(x))
    whole = F.filter(inside, lambda x: ~F.exists(inside, lambda y: (y != x) & y.contains(x)))
    role = r.select("id", reasons((~F.array_contains(inside, F.col("correct")), "role not in segment"), (F.size(whole) > 1, "segment names more roles")).alias("reasons"))
    f = bank.where("kind = 'figure'")
    stray = f.select("id", F.explode("options").alias("span"), "correct").join(pool.select("span").distinct(), "span", "left_anti").where("span <> correct")
    stray = stray.groupBy("id").agg(F.concat(F.lit("no figure: "), F.array_join(F.array_sort(F.collect_set("span")), ",")).alias("stray"))
    figure = f.join(stray, "id", "left").select("id", reasons((~F.array_contains(spans(F.col("chunk_text"), units), F.col("correct")), "answer no figure")).alias("r"), "stray")
    return role.unionByName(figure.select("id", F.when(F.col("stray").isNull(), F.col("r")).otherwise(F.concat("r", F.array("stray"))).alias("reasons")))


def drops(bank: DataFrame, stale: DataFrame, suspended: DataFrame, old_terms: list[tuple[str, str]], truths: DataFrame) -> DataFrame:
    """(id, step, detail): 1a under a stale rule, 1b names a suspended product, 1c an option uses an old term, 1d a distractor that a
    rule now makes right while the keyed answer isn't in it.

    stale: id, rule_id. suspended: id, name_id. truths: id, rule_id, statement.
    """
    out = stale.select("id", F.lit("1a").alias("step"), F.col("rule_id").alias("detail")).unionByName(suspended.select("id", F.lit("1b").alias("step"), F.col("name_id").alias("detail")))
    option = bank.select("id", "correct", F.explode("options").alias("option"))
    for old, _ in old_terms:
        out = out.unionByName(option.where(F.col("option").contains(old)).select("id", F.lit("1c").alias("step"), F.concat("option", F.lit(": " + old)).alias("detail")))
    said = option.where("option <> correct").join(truths, "id").where(F.col("statement").contains(F.col("option")) & ~F.col("statement").contains(F.col("correct")))
    return out.unionByName(said.select("id", F.lit("1d").alias("step"), F.concat("option", F.lit(": "), "rule_id").alias("detail"))).distinct()


def distractors(bank: DataFrame, pool: DataFrame, ratio: float = MAX_RATIO) -> DataFrame:
    """(id, span): figures that may stand beside a question's answer.

    bank: id, chunk_id, clause, products, correct, unit, value, chunk_text, options. pool: span, chunk_id, clause,
    products, unit, value, one row a use. Questions and figures meet by unit, within the ratio; a figure goes out
    by any use in the answer's chunk, clause or with one of its products, as part of the chunk's text, or by
    the value of the answer. One aggregation replaces an anti join for each of these.
    """
    p = pool.select("span", F.col("chunk_id").alias("p_chunk"), F.col("clause").alias("p_clause"), F.col("products").alias("p_products"), "unit", F.col("value").alias("p_value"))
    near = (F.col("p_value") <= ratio * F.col("value")) & (F.col("value") <= ratio * F.col("p_value")) & (F.col("p_value") != F.col("value"))
    bad = (F.col("p_chunk") == F.col("chunk_id")) | (F.col("p_clause") == F.col("clause")) | F.arrays_overlap("p_products", "products") | F.col("chunk_text").contains(F.col("span"))
    met = bank.join(p, "unit").where(near).groupBy("id", "span").agg(F.bool_or(bad).alias("bad"))
    return met.where("not bad").select("id", "span")


def audits(bank: DataFrame, posts: dict[str, str], checked: str, examples: str, letters: str, endings: str) -> DataFrame:
    """bank with audit_4a .. audit_4e; reports, never changes.

    4a options that name one post; 4b the role stands as the thing checked; 4c a figure from a worked example;
    4d a role only inside a longer word, but for its endings; 4e the answer is the longest option by half again.
    """
    post = F.create_map(*(F.lit(x) for kv in posts.items() for x in kv))
    keys = F.filter(F.transform("options", lambda o: F.element_at(post, o)), lambda k: k.isNotNull())
    c, seg, role = F.col("correct"), F.col("explanation"), F.col("kind") == "role"
    quoted = F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    alone = F.rlike(seg, F.concat(F.lit(f"(?<![{letters}])"), quoted, F.lit(f"(?:{endings})?(?![{letters}])")))
    longest = F.array_max(F.transform(F.filter("options", lambda o: o != c), lambda o: F.length(o)))
    return bank.withColumns({
        "audit_4a": F.size(F.array_distinct(keys)) < F.size(keys),
        "audit_4b": role & F.rlike(seg, F.concat(quoted, F.lit(f"(?:{endings})? (?:{checked})"))),
        "audit_4c": (F.col("kind") == "figure") & F.concat_ws(" ", seg, F.col("heading")).rlike(f"{examples}|=|×|[0-9]\\s*[xX]\\s*[0-9(]"),
        "audit_4d": role & seg.contains(c) & ~alone,
        "audit_4e": F.length(c) > 1.5 * longest,
    })


def review_status(bank: DataFrame, reviewed: DataFrame, checked: DataFrame, hashes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, status): reviewed; reviewed, changed since; checked; checked, changed since; no check recorded.

    A fingerprint covers the fields, options in their order, and the cited chunk's hash. A review outranks a
    check, even a stale one a fresh check. reviewed, checked: id, fingerprint; hashes: chunk_id, sha256.
    """
    now = bank.join(hashes, "chunk_id", "left").withColumn("now", fingerprint(*(F.col(f).cast("string") for f in fields), F.col("sha256")))
    j = now.join(reviewed.select("id", F.col("fingerprint").alias("r")), "id", "left").join(checked.select("id", F.col("fingerprint").alias("c")), "id", "left")
    s = F.when(F.col("r") == F.col("now"), "reviewed").when(F.col("r").isNotNull(), "reviewed, changed since").when(F.col("c") == F.col("now"), "checked").when(F.col("c").isNotNull(), "checked, changed since").otherwise("no check recorded")
    return j.select("id", s.alias("status"))


def gold_lints(gold: DataFrame, manuals: DataFrame) -> DataFrame:
    """(id, lints): unknown manual:, scope names one manual and cites others, scope names none and cites exactly one without
    any-of, unarmed (nothing forbidden although answerable).

    gold: id, scope, mode, cites (manual ids), armed, answerable. manuals: manual_id. A scope means the only manual that begins with it.
    """
    known = manuals.agg(F.collect_set("manual_id").alias("known"))
    g = gold.crossJoin(F.broadcast(known))  # one row
    c = F.array_distinct("cites")
    unknown = F.array_sort(F.array_except(c, "known"))
    multi = F.col("scope").isin("any", "both", "ambiguous")
    fits = F.filter("known", lambda k: F.startswith(k, F.col("scope")))
    want = F.when(F.array_contains("known", F.col("scope")), F.col("scope")).when(F.size(fits) == 1, F.element_at(F.array_sort(fits), 1))
    r = reasons(
        (multi & (F.size(c) == 1) & (F.col("mode") != "any"), "one citation for any manual"),
        (~multi & (F.size(c) > 0) & want.isNotNull() & ~F.array_contains(c, want), "scope not cited"),
        (F.col("answerable") & (F.col("armed") == 0), "unarmed"),
    )
    return g.select("id", F.concat(F.transform(unknown, lambda m: F.concat(F.lit("unknown manual: "), m)), r).alias("lints"))


def bag_difference(a: Column, b: Column) -> Column:
    """Elements of a that b lacks, each as often as it is missing, sorted."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.array_sort(F.flatten(F.transform(F.array_distinct(a), lambda v: F.array_repeat(v, F.greatest(count(a, v) - count(b, v), F.lit(0))))))


def translation_checks(pairs: DataFrame, terms: list[tuple[str, str, str]], insurers: list[str], glosses: list[tuple[str, str]]) -> DataFrame:
    """pairs (id, bn, en) with only_bn, only_en, term_misses, misnamed, gloss_missing.

    Numbers compare as bags. terms: (source term, agreed wording, wording that it replaced). An insurer's name
    without its ending, with another company ending, is misnamed. A glossed name's first mention has its gloss.
    """
    bn, en, low = F.col("bn"), F.col("en"), F.lower("en")
    a, b = T.numbers_in("bn"), T.numbers_in("en")
    misses = [x for src, now, old in terms for x in (F.when(low.contains(old.lower()), F.lit(f"{old} was replaced by {now}")), F.when(bn.contains(src) & ~low.contains(now.lower()), F.lit(f"{src} needs {now}")))]
    said = lambda stem: F.regexp_extract_all(en, F.lit(f"(\\Q{stem}\\E(?: (?:Life|Insurance|Company))* (?:Limited|Ltd|PLC))"))
    wrong = [F.array_except(said(re.split(" (?:Life|Insurance|PLC)", name)[0]), F.array(F.lit(name))) for name in insurers]
    lost = [F.when(en.contains(n) & ~F.startswith(F.substring(en, F.instr(en, F.lit(n)) + len(n), F.lit(10_000)), F.lit(f" ({g}")), F.lit(n)) for n, g in glosses]
    kept = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return pairs.select("id", bag_difference(a, b).alias("only_bn"), bag_difference(b, a).alias("only_en"), kept(misses).alias("term_misses"), F.flatten(F.array(*wrong)).alias("misnamed"), kept(lost).alias("gloss_missing"))
