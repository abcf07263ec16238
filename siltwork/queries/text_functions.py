"""Normalisers, tokens, numbers and scripts: literal rows in the corpus language, and whole tables."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from ..functions import figures as N
from ..functions import scan
from ..functions import sequences as Q
from ..functions import text as T
from ..operators import gloss as G
from .base import Registry, table, values

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

BN = values(
    "id s",
    (1, "ঋণের পরিমাণ ১,৫০,০০০ টাকা এবং 40,000 টাকা"),
    (2, "ধাপ ১,২,৩ ও 1,2,3 অনুসরণ"),
    (3, "আয় আয় বাড়ি বাড়ি"),
    (4, "দাবি‌র  তালিকা \tশেষ৷ "),
    (5, "ধারা ২.৩৫ অনুযায়ী সুদ ৯.৫% এবং ৩ মাস"),
    (6, "Plain English, 12 items. No digits folded"),
    (7, ""),
    (8, None),
    (9, "৫০ হাজার টাকা, ৭.১ শতাংশ, ২ বছর"),
)
FOLD = "translate(coalesce(s, ''), '০১২৩৪৫৬৭৮৯', '0123456789')"
NFC = "nfc_normalize(coalesce(s, ''))"
# RE2 has no lookaround: a comma's left digit is consumed, so the rule is applied twice
GROUPS = "regexp_replace(regexp_replace({0}, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g')"
CANON = GROUPS.format(f"translate({NFC}, '০১২৩৪৫৬৭৮৯', '0123456789')")
DISPLAY = "regexp_replace(regexp_replace(translate(regexp_replace(nfc_normalize(coalesce(s, '')), '[​‌‍﻿­]', '', 'g'), '৷', '।'), '[ \t ]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _bn(spark, **cols):
    return spark.sql(BN).select("id", *(c.alias(k) for k, c in cols.items()))


def _doc_sql(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS out FROM (SELECT doc_id, text AS s FROM documents)"


@R.add("str01_fold_digits", f"SELECT id, {FOLD} AS out FROM ({BN})")
def _(spark, sf):
    return _bn(spark, out=T.fold_digits("s"))


@R.add("str02_strip_groups", f"SELECT id, {GROUPS.format(FOLD)} AS out FROM ({BN})")
def _(spark, sf):
    return _bn(spark, out=T.strip_groups(T.fold_digits("s")))


@R.add(
    "str03_strip_thousands",
    f"SELECT id, regexp_replace(regexp_replace(coalesce(s, ''), '([০-৯0-9]),([০-৯0-9]{{2,3}})([^০-৯0-9]|$)', '\\1\\2\\3', 'g'), '([০-৯0-9]),([০-৯0-9]{{2,3}})([^০-৯0-9]|$)', '\\1\\2\\3', 'g') AS out FROM ({BN})",
)
def _(spark, sf):
    return _bn(spark, out=T.strip_thousands("s"))


@R.add("str04_nfc", f"SELECT id, {NFC} AS out FROM ({BN})")
def _(spark, sf):
    return _bn(spark, out=T.nfc("s"))


@R.add("str04_nfc_documents", "SELECT doc_id, md5(nfc_normalize(coalesce(text, ''))) AS out FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.nfc("text").cast("binary")).alias("out"))


#: Letters with one accent, and the same taken apart with a second accent that belongs before the first.
APART = {chr(c): unicodedata.normalize("NFD", chr(c)) + "\u0323" for c in range(0xC0, 0x100) if unicodedata.decomposition(chr(c))}


def _nested(sql: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


@R.add("str04_nfc_apart", f"SELECT doc_id, md5(nfc_normalize(apart)) AS out, nfc_normalize(apart) <> apart AS changed FROM (SELECT doc_id, {_nested('text', APART)} AS apart FROM documents)")
def _(spark, sf):
    """Every accent taken apart and out of order: composition orders the marks and takes up what it can."""
    apart = table(spark, sf, "documents").select("doc_id", F.expr(_nested("text", APART)).alias("apart")).withColumn("whole", T.nfc("apart"))
    return apart.select("doc_id", F.md5(F.col("whole").cast("binary")).alias("out"), (F.col("whole") != F.col("apart")).alias("changed"))


@R.add("str05_canon", f"SELECT id, {CANON} AS out FROM ({BN})")
def _(spark, sf):
    return _bn(spark, out=T.canon("s"))


@R.add("str05_canon_documents", _doc_sql("md5(" + GROUPS.format("coalesce(s, '')") + ")"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.canon("text").cast("binary")).alias("out"))


@R.add("str06_canon_pattern", "SELECT * FROM (VALUES (1, '[0-9]{0,4}'), (2, 'ধারা 12')) t(id, out)")
def _(spark, sf):
    return spark.createDataFrame([(1, T.canon_pattern("[০-৯]{০,৪}")), (2, T.canon_pattern("ধারা ১২"))], "id int, out string")


@R.add("str07_literal_pattern", "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, true), (5, false)) t(id, out)")
def _(spark, sf):
    """Either spelling, zero-width joints, wide blanks and folded digits are found; a near miss and an empty literal are not."""
    rows = [(1, "বাড়ি", "বাড়ি"), (2, "দাবি ঋণ", "দা‌বি   ঋণ"), (3, "দাবি", "দাব"), (4, "৪০,০০০ টাকা", "40000 টাকা"), (5, "", "কিছু")]
    return spark.createDataFrame([(i, text, T.literal_pattern(lit)) for i, lit, text in rows], "id int, s string, rx string").selectExpr("id", "s rlike rx AS out")


@R.add("str08_display_norm", f"SELECT id, {DISPLAY} AS out FROM ({BN})")
def _(spark, sf):
    return _bn(spark, out=T.display_norm("s"))


BODY_SQL = "regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@R.add("str09_norm_body", f"SELECT id, {BODY_SQL.format(CANON.replace(NFC, NFC))} AS out FROM (SELECT id, replace(s, ' ', ' ') AS s FROM ({BN}))")
def _(spark, sf):
    return spark.sql(BN).select("id", T.norm_body(F.replace("s", F.lit(" "), F.lit(" "))).alias("out"))


@R.add("str10_peel_heading", "SELECT page_id, substr(t, length(h) + 2) AS out FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS h, regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || url AS t FROM pages)")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("h"))
    return p.select("page_id", T.peel_heading(F.concat("h", F.lit("\n"), "url"), F.col("h")).alias("out"))


@R.add("str11_tokenize", "SELECT doc_id, len(regexp_extract_all(text, '[০-৯0-9]+(?:[.,][০-৯0-9]+)*|[ঀ-৿]+|[A-Za-z]+')) AS n, md5(array_to_string(regexp_extract_all(text, '[০-৯0-9]+(?:[.,][০-৯0-9]+)*|[ঀ-৿]+|[A-Za-z]+'), ' ')) AS out FROM documents")
def _(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("out"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TOKENS_SQL = f"list_filter(list_transform(regexp_extract_all({{0}}, '[০-৯0-9]+(?:[.,][০-৯0-9]+)*|[ঀ-৿]+|[A-Za-z]+'), lambda x: lower(x)), lambda x: NOT list_contains({STOP}, x))"


@R.add("str12_index_tokens", f"SELECT id, array_to_string({TOKENS_SQL.format('s')} || list_transform(list_filter({TOKENS_SQL.format('s')}, lambda x: contains(x, ',')), lambda x: {GROUPS.format('x')}), ' ') AS out FROM (SELECT * FROM (VALUES (1, 'The loan is 150,000 taka and No fee'), (2, 'Who may apply, and how'), (3, '')) t(id, s))")
def _(spark, sf):
    return spark.sql(values("id s", (1, "The loan is 150,000 taka and No fee"), (2, "Who may apply, and how"), (3, ""))).select("id", F.array_join(T.index_tokens("s"), " ").alias("out"))


@R.add("str13_index_and_query_text", f"SELECT id, CASE WHEN f = b THEN b ELSE b || chr(10) || f END AS index_text, CASE WHEN f = b THEN b ELSE b || ' ' || f END AS query_text FROM (SELECT id, {DISPLAY} AS b, translate({DISPLAY}, '০১২৩৪৫৬৭৮৯', '0123456789') AS f FROM ({BN}))")
def _(spark, sf):
    return _bn(spark, index_text=T.with_twin("s", "\n"), query_text=T.with_twin("s", " "))


NUMS_SQL = "list_transform(regexp_extract_all({0}, '[0-9০-৯][0-9০-৯,.]*'), lambda x: replace(regexp_replace(translate(x, '০১২৩৪৫৬৭৮৯', '0123456789'), '[.]+$', ''), ',', ''))"


@R.add("str14_numbers_in", f"SELECT id, array_to_string({NUMS_SQL.format(chr(99) + 'oalesce(s, chr(32))')}, ';') AS out FROM ({BN})")
def _(spark, sf):
    return _bn(spark, out=F.array_join(T.numbers_in("s"), ";"))


@R.add("str14_unit_numbers_in", f"SELECT id, array_to_string(list_transform(regexp_extract_all(coalesce(s, ''), '[0-9০-৯][0-9০-৯,.]*\\s*(?:{T.UNITS})'), lambda x: replace(translate(regexp_extract(x, '^[0-9০-৯][0-9০-৯,.]*'), '০১২৩৪৫৬৭৮৯', '0123456789'), ',', '') || ' ' || regexp_extract(x, '(?:{T.UNITS})$')), ';') AS out FROM ({BN})")
def _(spark, sf):
    return _bn(spark, out=F.array_join(T.unit_numbers_in("s"), ";"))


@R.add("str14_numbers_documents", f"SELECT doc_id, len(regexp_extract_all(text, '[0-9০-৯][0-9০-৯,.]*')) AS n, array_to_string({NUMS_SQL.format('text')}, ';') AS out FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.numbers_in("text").alias("x")).select("doc_id", F.size("x").alias("n"), F.array_join("x", ";").alias("out"))


@R.add("str15_is_figure_query", "SELECT conv_id, turn, regexp_matches(text, '[০-৯0-9]') AS out FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_figure_query("text").alias("out"))


@R.add("str16_char_classes", "SELECT doc_id, len(regexp_extract_all(text, '[ঀ-৿]')) AS bengali, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[¡-ÿ]')) AS high, length(text) - length(replace(text, 'v', '')) AS vs FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.bengali_count("text").alias("bengali"), T.count_class("text", "[A-Za-z]").alias("letters"), T.count_class("text", "[¡-ÿ]").alias("high"), T.count_class("text", "v").alias("vs"))


MARKERS = ("Av", "wK", "cÖ", "†", "‡", "©")


LEGACY = values(
    "id s",
    (1, "short"),
    (2, "Avwg evsjvq Mvb MvB Avwg Avgvi Avwgv‡K wPiw`b evsjvq cÖ Lyu‡R cvB vvvv"),
    (3, "ঋণের পরিমাণ ঋণের পরিমাণ ঋণের পরিমাণ ঋণের পরিমাণ ঋণের"),
    (4, "plain English prose that has no legacy letters in it at all, just words"),
)
HITS = " + ".join(f"CAST(contains(s, '{m}') AS INT)" for m in MARKERS)
PROFILE_SQL = f"""
SELECT *, round(bn / greatest(n, 1), 4) AS bengali_ratio, round(la / greatest(n, 1), 4) AS ascii_ratio, round(hi / greatest(n, 1), 4) AS high_ratio, round(vs / greatest(la, 1), 4) AS v_rate FROM (
  SELECT id, length(regexp_replace(s, '\\s', '', 'g')) AS n, len(regexp_extract_all(s, '[ঀ-৿]')) AS bn, len(regexp_extract_all(s, '[A-Za-z]')) AS la,
    len(regexp_extract_all(s, '[¡-ÿ]')) AS hi, len(regexp_extract_all(s, 'v')) AS vs, {HITS} AS hits FROM ({{0}}))
"""
SCORE_SQL = "CASE WHEN n < 40 OR bengali_ratio > 0.15 THEN 0.0 ELSE round(least((CASE WHEN ascii_ratio > 0.45 THEN 0.3 ELSE 0 END) + (CASE WHEN high_ratio > 0.02 THEN 0.25 ELSE 0 END) + 0.25 * least(hits / 8, 1) + (CASE WHEN v_rate > 0.09 THEN 0.2 ELSE 0 END), 1), 3) END"


@R.add("str17_legacy_score", f"SELECT id, {SCORE_SQL} AS out FROM ({PROFILE_SQL.format(LEGACY)})")
def _(spark, sf):
    return spark.sql(LEGACY).select("id", T.legacy_score(T.text_profile("s", MARKERS)).alias("out"))


@R.add("str17_legacy_score_documents", f"SELECT id AS doc_id, {SCORE_SQL} AS out FROM ({PROFILE_SQL.format('SELECT doc_id AS id, text AS s FROM documents')})")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.legacy_score(T.text_profile("text", MARKERS)).alias("out"))


DAMAGE = values("id s", (1, "াক কাি"), (2, "ক্া ্ক অা"), (3, "ক্্ক"), (4, "ললোন"), (5, "ঠিক আছে"), (6, "১\n২"))


@R.add("str18_malformed_clusters", "SELECT * FROM (VALUES (1, 'matra_word_initial:1 double_matra:1'), (2, 'hasant_then_matra:1 vowel_with_matra:1 hasant_word_initial:1'), (3, 'double_hasant:1'), (4, ''), (5, ''), (6, '')) t(id, out)")
def _(spark, sf):
    counted = spark.sql(DAMAGE).select("id", F.array(*(F.struct(F.lit(n).alias("n"), F.regexp_count("s", F.lit(rx)).alias("c")) for n, rx in T.MALFORMED)).alias("x"))
    return counted.select("id", F.array_join(F.transform(F.filter("x", lambda e: e["c"] > 0), lambda e: F.concat_ws(":", e["n"], e["c"].cast("string"))), " ").alias("out"))


@R.add("str18_legal_damage", "SELECT * FROM (VALUES (4, 'doubled_consonant_before_o'), (6, 'digit_run_split_by_newline')) t(id, out)")
def _(spark, sf):
    return spark.sql(DAMAGE).select("id", F.explode(T.legal_damage("s")).alias("h")).select("id", F.col("h.rule").alias("out"))


@R.add("str19_validity_rate_grade", "SELECT * FROM (VALUES (1, 400.0, 'UNUSABLE'), (5, 0.0, 'CLEAN')) t(id, rate, grade)")
def _(spark, sf):
    r = spark.sql(DAMAGE).where("id in (1, 5)").select("id", T.validity_rate("s").alias("rate"))
    return r.select("id", F.round("rate", 6).alias("rate"), T.grade(F.col("rate")).alias("grade"))


_rng = random.Random(7)
CLUSTERS = values("id s", *((i, "".join(_rng.choice(("ক", "ল", "া", "ি", "্", "অ", "ং", " ")) for _ in range(_rng.randint(1, 14)))) for i in range(400)))
_PAIR = "substr(' ' || s, i, 2)"
CLUSTER_SQL = f"""
WITH c AS ({CLUSTERS}), p AS (SELECT id, s, unnest(range(1, length(s) + 1)) AS i FROM c), k AS (SELECT id, i, s, CASE WHEN regexp_matches({_PAIR}, '^ [ািৌ্]') THEN 'orphan_dependent' WHEN regexp_matches({_PAIR}, '^[াি][াি]') THEN 'double_matra' WHEN regexp_matches({_PAIR}, '^্[াি]') THEN 'hasant_matra'
WHEN regexp_matches({_PAIR}, '^অ[াি]') THEN 'vowel_matra' WHEN regexp_matches({_PAIR}, '^ং[াি]') THEN 'sign_matra' WHEN substr(s, i, 2) = '্ ' THEN 'dangling_hasant' END AS state FROM p)
SELECT id, i AS "at", state, substr(s, greatest(i - 12, 1), 24) AS context FROM k WHERE state IS NOT NULL
"""


@R.add("str20_cluster_states", CLUSTER_SQL)
def _(spark, sf):
    """Each violation with its place, those next to each other too."""
    return spark.sql(CLUSTERS).select("id", F.explode(T.cluster_states("s")).alias("x")).select("id", F.col("x.at").cast("long").alias("at"), "x.state", "x.context")


@R.add("str17_legacy_paragraph_score", f"SELECT doc_id, CASE WHEN n < 6 THEN 0.0 ELSE round(least((CASE WHEN la / greatest(n, 1) > 0.5 THEN 0.45 ELSE 0 END) + 0.3 * least(hits / 5, 1) + (CASE WHEN vs / greatest(la, 1) > 0.08 THEN 0.25 ELSE 0 END), 1), 2) END AS score FROM (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z\\x{{80}}-\\x{{ff}}\\x{{2018}}-\\x{{2030}}]', '', 'g')) AS la, length(text) - length(replace(text, 'v', '')) AS vs, {HITS.replace('contains(s,', 'contains(text,')} AS hits FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scan.legacy_paragraph_score(F.col("text"), MARKERS).alias("score"))


@R.add("str25_word_error_rate", "WITH p AS (SELECT a.item_id, string_split(a.text, ' ') AS x, string_split(a.text[1:60] || ' ' || b.text[20:80], ' ') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), k AS (SELECT *, list_distinct(x || y) AS w FROM p), d AS (SELECT item_id, len(x) AS n, levenshtein(array_to_string(list_transform(x, lambda t: chr(CAST(32 + list_position(w, t) AS INT))), ''), array_to_string(list_transform(y, lambda t: chr(CAST(32 + list_position(w, t) AS INT))), '')) AS edits, len(w) AS kinds FROM k) SELECT item_id, edits, round(edits / n, 4) AS wer FROM d WHERE kinds <= 90")
def _(spark, sf):
    """Word edits between an item and one put together from it and the next; up to 90 distinct words, which SQL has signs of one byte for."""
    b = table(spark, sf, "benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.substring("text", 20, 61).alias("next"))
    x, y = F.split("text", " "), F.split(F.concat(F.substring("text", 1, 60), F.lit(" "), F.col("next")), " ")
    d = b.join(n, "item_id").where(F.size(F.array_distinct(F.concat(x, y))) <= 90).select("item_id", T.token_distance(x, y).cast("long").alias("edits"), F.size(x).alias("n"))
    return d.select("item_id", "edits", F.round(F.col("edits") / F.col("n"), 4).alias("wer"))


@R.add("str21_normalisation_statistics", f"SELECT id, length(s) - length(replace(replace(s, '‌', ''), '‍', '')) AS joiners, length(s) - length(replace(s, '।', '')) AS dandas, regexp_matches(s, '[০-৯]') AND regexp_matches(s, '[0-9]') AS mixed_digits, nfc_normalize(s) <> s AS nfc_changes FROM ({BN}) WHERE s IS NOT NULL")
def _(spark, sf):
    s = spark.sql(BN).where("s is not null")
    gone = lambda rx: F.regexp_count("s", F.lit(rx))
    return s.select("id", gone("[‌‍]").alias("joiners"), gone("।").alias("dandas"), (F.col("s").rlike("[০-৯]") & F.col("s").rlike("[0-9]")).alias("mixed_digits"), (T.nfc("s") != F.col("s")).alias("nfc_changes"))


PATHS = values("id h", (1, "অধ্যায় ২ > ২.১ ঋণ > ২.১.১ সীমা"), (2, "পরিশিষ্ট"), (3, "1.2 Scope > ১.৩ Rules"), (4, ""))


@R.add("str22_clause_pair", f"SELECT id, coalesce(list_last(regexp_extract_all(translate(h, '০১২৩৪৫৬৭৮৯', '0123456789'), '[0-9]+(?:[.][0-9]+)+')), '') AS clause, coalesce(list_last(regexp_extract_all(h, '[0-9০-৯]+(?:[.][0-9০-৯]+)+')), '') AS clause_display FROM ({PATHS})")
def _(spark, sf):
    return spark.sql(PATHS).select("id", T.clause("h").alias("clause"), T.clause_display("h").alias("clause_display"))


@R.add("str23_script_of", f"SELECT id, CASE WHEN bn + la = 0 THEN 'none' WHEN bn / (bn + la) >= 0.85 THEN 'bengali' WHEN bn / (bn + la) <= 0.15 THEN 'latin' ELSE 'mixed' END AS out FROM (SELECT id, len(regexp_extract_all(t, '[ঀ-৿]')) AS bn, len(regexp_extract_all(t, '[A-Za-z]')) AS la FROM (SELECT id, regexp_replace(coalesce(s, ''), '§|[A-Za-z0-9_]*[_0-9][A-Za-z0-9_.]*', ' ', 'g') AS t FROM ({BN})))")
def _(spark, sf):
    return _bn(spark, out=T.script_of("s"))


@R.add("str24_wrong_script_identifiers", "SELECT * FROM (VALUES (1, 'ম্যানুয়াল_ক;১.২.৩'), (2, ''), (3, '§ ২.১')) t(id, out)")
def _(spark, sf):
    s = spark.sql(values("id s", (1, "দেখুন ম্যানুয়াল_ক ধারা ১.২.৩ এবং ১.২.৩"), (2, "সুদ ২.৩৫"), (3, "§ ২.১ দেখুন")))
    ids = F.filter(F.regexp_extract_all("s", F.lit("[A-Za-z0-9_ঀ-৿]+"), F.lit(0)), lambda t: t.contains("_") & t.rlike("[ঀ-৿]"))
    clauses = F.regexp_extract_all("s", F.lit("§\\s*[০-৯]+(?:\\.[০-৯]+)*|[০-৯]+\\.[০-৯]+\\.[০-৯]+(?:\\.[০-৯]+)*"), F.lit(0))
    return s.select("id", F.array_join(F.array_distinct(F.concat(ids, clauses)), ";").alias("out"))


@R.add("str25_edit_distance", "SELECT a.item_id, levenshtein(a.text, b.text) AS edits, round(levenshtein(a.text, b.text) / length(a.text), 6) AS cer FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE NOT regexp_matches(a.text || b.text, '[^ -~\n]')")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    d = F.levenshtein("text", "other")
    return b.join(n, "item_id").where(~F.concat("text", "other").rlike("[^ -~\n]")).select("item_id", d.alias("edits"), F.round(d / F.length("text"), 6).alias("cer"))


@R.add("str26_similarity_ratio", "SELECT a.item_id, round(1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)), 6) AS ratio FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE NOT regexp_matches(a.text || b.text, '[^ -~\n]')")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(n, "item_id").where(~F.concat("text", "other").rlike("[^ -~\n]")).select("item_id", F.round(1 - F.levenshtein("text", "other") / F.greatest(F.length("text"), F.length("other")), 6).alias("ratio"))


NEIGHBOURS = "SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


def neighbours(spark, sf):
    """Each item with the next one."""
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.col("text").alias("x")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y")), "item_id")


# a row of the table of common subsequences at a time: the greatest so far of what the row above has, one more where characters agree
LCS_SQL = f"""WITH RECURSIVE p AS ({NEIGHBOURS}), cells AS (
  SELECT item_id, 0 AS i, unnest(range(0, length(y) + 1)) AS j, 0 AS v FROM p
  UNION ALL SELECT item_id, i, j, max(v) OVER (PARTITION BY item_id ORDER BY j) FROM (
    SELECT c.item_id, c.i + 1 AS i, c.j, CASE WHEN c.j > 0 AND substr(p.x, c.i::INT + 1, 1) = substr(p.y, c.j::INT, 1) THEN lag(c.v) OVER (PARTITION BY c.item_id ORDER BY c.j) + 1 ELSE c.v END AS v
    FROM cells c JOIN p USING (item_id) WHERE c.i < length(p.x)))
SELECT item_id, max(v)::INTEGER AS lcs, round(2.0 * max(v) / (any_value(length(x)) + any_value(length(y))), 6) AS ratio FROM cells JOIN p USING (item_id) GROUP BY item_id"""


@R.add("str26_subsequence_ratio", LCS_SQL)
def _(spark, sf):
    """Characters in common, in order, of each item and the next."""
    return neighbours(spark, sf).select("item_id", Q.lcs_length(F.col("x"), F.col("y")).alias("lcs"), F.round(Q.subsequence_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


# runs of equal characters along each diagonal; then, range by range, the longest one that fits, first in x, then in y
BLOCKS_SQL = """, same AS (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, j - i ORDER BY i) AS island
    FROM (SELECT id, x, y, unnest(range(0, length(x))) AS i FROM p) a JOIN (SELECT id AS of, unnest(range(0, length(y))) AS j, string_split(y, '') AS ys FROM p) b ON a.id = b.of AND substr(a.x, a.i::INT + 1, 1) = b.ys[b.j + 1]),
runs AS (SELECT id, i, j, max(i) OVER (PARTITION BY id, j - i, island) + 1 - i AS n FROM same),
ranges AS (
  SELECT id, 0::BIGINT AS alo, length(x) AS ahi, 0::BIGINT AS blo, length(y) AS bhi, false AS block FROM p
  UNION ALL SELECT id, u.alo, u.ahi, u.blo, u.bhi, u.block FROM (
    SELECT id, unnest([{'alo': alo, 'ahi': -k.i, 'blo': blo, 'bhi': -k.j, 'block': false}, {'alo': k.n - k.i, 'ahi': ahi, 'blo': k.n - k.j, 'bhi': bhi, 'block': false}, {'alo': -k.i, 'ahi': k.n - k.i, 'blo': -k.j, 'bhi': k.n - k.j, 'block': true}]) AS u FROM (
      SELECT r.id, r.alo, r.ahi, r.blo, r.bhi, max({'n': least(m.n, r.ahi - m.i, r.bhi - m.j), 'i': -m.i, 'j': -m.j}) AS k
      FROM ranges r JOIN runs m ON m.id = r.id AND m.i >= r.alo AND m.i < r.ahi AND m.j >= r.blo AND m.j < r.bhi WHERE NOT r.block GROUP BY ALL)))"""


@R.add("str26_block_ratio", f"WITH RECURSIVE p AS (SELECT item_id AS id, x, y FROM ({NEIGHBOURS})){BLOCKS_SQL} SELECT id AS item_id, count(*) FILTER (block)::INTEGER AS blocks, round(2.0 * coalesce(sum(ahi - alo) FILTER (block), 0) / any_value(t.total), 6) AS ratio FROM ranges JOIN (SELECT id, length(x) + length(y) AS total FROM p) t USING (id) GROUP BY id")
def _(spark, sf):
    """Matching blocks of each item and the next."""
    found = neighbours(spark, sf).withColumn("m", Q.matching_blocks(F.col("x"), F.col("y")))
    total = F.length("x") + F.length("y")
    return found.select("item_id", F.size("m").alias("blocks"), F.round(2.0 * F.aggregate("m", F.lit(0), lambda s, x: s + x["n"]) / total, 6).alias("ratio"))


SENTENCES = "list_filter(string_split(y, '. '), lambda t: trim(t) <> '')"


@R.add("str26_closest_sentence", f"WITH RECURSIVE l AS (SELECT item_id, substr(x, 1, 60) AS y, unnest({SENTENCES}) AS x FROM ({NEIGHBOURS})), p AS (SELECT row_number() OVER () AS id, * FROM l){BLOCKS_SQL}, r AS (SELECT p.id, p.item_id, p.x AS line, 2.0 * coalesce(sum(ahi - alo) FILTER (block), 0) / any_value(length(p.x) + length(p.y)) AS ratio FROM ranges JOIN p USING (id) GROUP BY ALL), k AS (SELECT item_id, max({{'ratio': ratio, 'line': line}}) AS k FROM r WHERE ratio >= 0.3 GROUP BY item_id) SELECT item_id, round(k.ratio, 6) AS ratio, k.line AS line FROM benchmark a LEFT JOIN k USING (item_id) WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = a.item_id + 1)")
def _(spark, sf):
    """The sentence of the next item that is most like an item's beginning, if one comes close."""
    k = neighbours(spark, sf).select("item_id", Q.closest(F.substring("x", 1, 60), F.split("y", "\\. ")).alias("k"))
    return k.select("item_id", F.round("k.ratio", 6).alias("ratio"), "k.line")


@R.add("str27_strip_markdown", "SELECT * FROM (VALUES (1, 'Title' || chr(10) || 'one two' || chr(10) || 'item'), (2, 'a b')) t(id, out)")
def _(spark, sf):
    return spark.sql(values("id s", (1, "## Title\n**one** _two_\n- item"), (2, "| a | b |\n|---|---|"))).select("id", T.strip_markdown("s").alias("out"))


@R.add("str28_sentences", "SELECT doc_id, len(list_filter(string_split_regex(text, '[.]\\s+'), lambda x: x <> '')) AS n FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(F.filter(F.split("text", "(?<=[।.])\\s+"), lambda x: ~x.rlike("^\\.?$"))).alias("n"))


@R.add("str28_segments", "SELECT doc_id, len(list_filter(string_split_regex(text, '[\\n•]+'), lambda x: trim(x, ' ') <> '')) AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", "[\n•]+"), lambda x: F.trim(x) != "")).alias("n"))


@R.add("str29_broken_digit_run", "SELECT doc_id, regexp_matches(text, '[0-9]\\s*\\n\\s*[0-9]') AS out FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike("[0-9]\\s*\n\\s*[0-9]").alias("out"))


RANGES = values("id s", (1, "৫০০-১০০০০০ টাকা"), (2, "900-100"), (3, "10-20 and 30-400"), (4, "none"))


@R.add("str30_figure_ranges", "SELECT * FROM (VALUES (1, '500', '100000', true, false), (2, '900', '100', false, true), (3, '10', '20', false, false), (3, '30', '400', false, false)) t(id, lo, hi, digits_apart, inverted)")
def _(spark, sf):
    rx = F.lit("([0-9,]+)\\s*[-–]\\s*([0-9,]+)")
    f = T.fold_digits("s")
    pair = F.zip_with(F.regexp_extract_all(f, rx, F.lit(1)), F.regexp_extract_all(f, rx, F.lit(2)), lambda a, b: F.struct(F.replace(a, F.lit(","), F.lit("")).alias("lo"), F.replace(b, F.lit(","), F.lit("")).alias("hi")))
    r = spark.sql(RANGES).select("id", F.explode(pair).alias("p")).select("id", "p.lo", "p.hi")
    return r.select("id", "lo", "hi", (F.abs(F.length("hi") - F.length("lo")) >= 2).alias("digits_apart"), (F.expr("try_cast(lo as bigint)") > F.expr("try_cast(hi as bigint)")).alias("inverted"))


MONEY = values("id n u", (1, "5", "হাজার"), (2, "2", "লক্ষ"), (3, "1.5", "কোটি"), (4, "40000", "টাকা"), (5, "x", "টাকা"), (6, "3", "মাস"))


@R.add("str32_span_value", f"SELECT id, TRY_CAST(n AS DOUBLE) * CASE u WHEN 'হাজার' THEN 1000 WHEN 'লক্ষ' THEN 100000 WHEN 'কোটি' THEN 10000000 WHEN 'টাকা' THEN 1 END AS out, CASE WHEN u IN ('হাজার', 'লক্ষ', 'কোটি', 'টাকা') THEN 'money' WHEN u IN ('মাস', 'বছর', 'দিন') THEN 'time' ELSE 'share' END AS cls FROM ({MONEY})")
def _(spark, sf):
    scale = F.create_map(*(F.lit(x) for x in ("হাজার", 1e3, "লক্ষ", 1e5, "কোটি", 1e7, "টাকা", 1.0)))
    cls = F.when(F.col("u").isin("হাজার", "লক্ষ", "কোটি", "টাকা"), "money").when(F.col("u").isin("মাস", "বছর", "দিন"), "time").otherwise("share")
    return spark.sql(MONEY).select("id", (F.expr("try_cast(n as double)") * F.try_element_at(scale, F.col("u"))).alias("out"), cls.alias("cls"))


@R.add("str31_value_multiset", "SELECT * FROM (VALUES (1, '12;500;500'), (2, '5000'), (3, '')) t(id, out)")
def _(spark, sf):
    s = spark.sql(values("id s", (1, "500 of 12 and 500"), (2, "5 হাজার"), (3, "no figures")))
    rx = F.lit("([0-9০-৯][0-9০-৯,.]*)\\s*(হাজার|লক্ষ|কোটি)?")
    scale = F.create_map(*(F.lit(x) for x in ("হাজার", 1000, "লক্ষ", 100000, "কোটি", 10000000, "", 1)))
    v = F.zip_with(F.regexp_extract_all("s", rx, F.lit(1)), F.regexp_extract_all("s", rx, F.lit(2)), lambda n, u: (F.replace(T.fold_digits(n), F.lit(","), F.lit("")).cast("double") * F.element_at(scale, F.coalesce(u, F.lit("")))).cast("long"))
    return s.select("id", F.array_join(F.transform(F.array_sort(v), lambda x: x.cast("string")), ";").alias("out"))


_PLAIN_VALUE = "coalesce(regexp_replace((TRY_CAST({0} AS DECIMAL(28, 4)) * {1})::DECIMAL(38, 4)::VARCHAR, '[.]?0+$', ''), {0})"
VALUES_SQL = f"""WITH t AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS t FROM documents),
c AS (SELECT doc_id, regexp_extract_all(t, '[0-9]+(?:[.][0-9]+){{{{2,}}}}') AS clauses, {GROUPS.format("regexp_replace(t, '[0-9]+(?:[.][0-9]+){{2,}}', ' ', 'g')")} AS t FROM t),
m AS (SELECT doc_id, clauses, unnest(regexp_extract_all(t, '[0-9]+(?:[.][0-9]+)?(?:(?:st|nd|rd|th)\\b)?(?:\\s*(?:thousand|lakh|crore))?')) AS m FROM c),
v AS (SELECT doc_id, regexp_extract(m, '^[0-9]+(?:[.][0-9]+)?') AS n, CASE WHEN m LIKE '%thousand' THEN 1000 WHEN m LIKE '%lakh' THEN 100000 WHEN m LIKE '%crore' THEN 10000000 ELSE 1 END AS k, regexp_matches(m, '[0-9](?:st|nd|rd|th)') AS o FROM m),
f AS (SELECT doc_id, {_PLAIN_VALUE.format('n', 'k')} AS value, CASE WHEN k > 1 THEN 'scaled' WHEN o THEN 'ordinal' ELSE 'number' END AS kind FROM v UNION ALL SELECT doc_id, unnest(clauses), 'clause' FROM c)
SELECT doc_id, kind, count(*) AS n, md5(string_agg(value, ';' ORDER BY value)) AS out FROM f GROUP BY doc_id, kind""".replace("{{2,}}", "{2,}")


@R.add("str31_values_documents", VALUES_SQL)
def _(spark, sf):
    """Typed figures of every document, by kind, as sorted multisets."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(N.figures("text", "en")).alias("f")).groupBy("doc_id", "f.kind").agg(F.array_sort(F.collect_list("f.value")).alias("v"))
    return found.select("doc_id", "kind", F.size("v").cast("long").alias("n"), F.md5(F.array_join("v", ";").cast("binary")).alias("out"))


_LOOK = "SELECT doc_id, replace(replace(replace(text, 'th', '3%'), 'er', '12-'), 'on', '5 - 4000 ') AS s FROM documents"
AUDIT_SQL = f"""WITH d AS ({_LOOK}), r AS (SELECT doc_id, unnest(regexp_extract_all(s, '[0-9][0-9,]*\\s*[-–—]\\s*[0-9][0-9,]*')) AS m FROM d),
e AS (SELECT doc_id, m, replace(regexp_extract(m, '^[0-9,]+'), ',', '') AS lo, replace(regexp_extract(m, '[0-9,]+$'), ',', '') AS hi FROM r),
a AS (SELECT doc_id, unnest(regexp_extract_all(s, '[0-9][0-9,]*\\s*%')) AS m FROM d),
i AS (SELECT doc_id, m, CASE WHEN abs(length(lo) - length(hi)) >= 2 THEN 'range_digit_count_mismatch' WHEN lpad(lo, 1000, '0') > lpad(hi, 1000, '0') THEN 'range_inverted' END AS issue FROM e
  UNION ALL SELECT doc_id, m, CASE WHEN coalesce(TRY_CAST(replace(regexp_extract(m, '^[0-9,]+'), ',', '') AS DECIMAL(38, 0)), 101) > 100 THEN 'magnitude_implausible' END FROM a)
SELECT doc_id, issue, count(*) AS n, min(m) AS fragment FROM i WHERE issue IS NOT NULL GROUP BY doc_id, issue"""


@R.add("str30_figure_audit_documents", AUDIT_SQL)
def _(spark, sf):
    """Ranges and shares of every document, syllables turned into figures so that there are many."""
    d = table(spark, sf, "documents").selectExpr("doc_id", "replace(replace(replace(text, 'th', '3%'), 'er', '12-'), 'on', '5 - 4000 ') AS s")
    found = d.select("doc_id", F.explode(N.audit("s")).alias("a"))
    return found.groupBy("doc_id", "a.issue").agg(F.count("*").alias("n"), F.min("a.fragment").alias("fragment"))


@R.add("str34_loop_detector", "SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(id, out)")
def _(spark, sf):
    return spark.sql(values("id s", (1, "start " + "go on " * 8), (2, "one two three " * 7), (3, "x - " * 9))).select("id", T.has_loop("s").alias("out"))


_RUN = "contains(array_to_string(list_transform(range(1, len(w) - {0} + 1), lambda i: CASE WHEN w[i] = w[i + {0}] THEN '1' ELSE '0' END), ''), repeat('1', 7 * {0}))"


@R.add("str34_loop_documents", "WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')) AS w FROM documents) SELECT doc_id, " + " OR ".join(_RUN.format(k) for k in (1, 2, 3, 4)) + " AS out FROM t")
def _(spark, sf):
    """In SQL: 7 k words in a row that are each the word k places on."""
    return table(spark, sf, "documents").select("doc_id", T.has_loop("text").alias("out"))


@R.add("str35_citation_lines", "SELECT * FROM (VALUES (1, 'Answer.', 'a §1.2|b §3'), (2, 'No source.', ''), (3, 'Plain', '')) t(id, prose, cites)")
def _(spark, sf):
    s = spark.sql(values("id s", (1, "Answer.\nCITATIONS: a §1.2; b §3"), (2, "No source.\ncitations: none"), (3, "Plain")))
    c = T.citation_lines("s")
    return s.select("id", c["prose"].alias("prose"), F.array_join(c["citations"], "|").alias("cites"))


@R.add("str36_citation_render", "SELECT 1 AS id, 'Loan manual §২.১' AS out")
def _(spark, sf):
    c = spark.sql(values("id manual clause", (1, "m1", "2.1")))
    m = spark.sql(values("manual title", ("m1", "Loan manual")))
    return c.join(F.broadcast(m), "manual", "left").select("id", F.concat_ws(" §", F.coalesce("title", "manual"), F.translate("clause", T.ASCII_DIGITS, T.BN_DIGITS)).alias("out"))


@R.add("str37_stems", "SELECT * FROM (VALUES (1, 'ঋণের;ঋণ;ঋণে'), (2, 'কর'), (3, 'loans;loan')) t(id, out)")
def _(spark, sf):
    return spark.sql(values("id w", (1, "ঋণের"), (2, "কর"), (3, "loans"))).select("id", F.array_join(T.stems(F.col("w"), ("ের", "কে", "s", "র")), ";").alias("out"))


@R.add("str38_word_boundary", "SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(id, out)")
def _(spark, sf):
    rx = "(?<![ঀ-৿])ঋণ(?:ের|টি)?(?![ঀ-৿])"
    return spark.sql(values("id s", (1, "এই ঋণের সীমা"), (2, "অঋণ নয়"), (3, "ঋণ"))).select("id", F.col("s").rlike(rx).alias("out"))


@R.add("str39_content_words", f"SELECT conv_id, turn, array_to_string(list_distinct_sorted, ' ') AS out FROM (SELECT conv_id, turn, list_sort(list_distinct({TOKENS_SQL.format('text')})) AS list_distinct_sorted FROM conversations)")
def _(spark, sf):
    words = F.filter(F.transform(T.tokenize("text"), F.lower), lambda t: ~t.isin(*T.STOP_WORDS))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("out"))


@R.add("str40_page_spec", "SELECT * FROM (VALUES (1, '1,2,3,7'), (2, '5'), (3, '2,3,4')) t(id, out)")
def _(spark, sf):
    return spark.sql(values("id s", (1, "1-3,7"), (2, "5"), (3, "3-4, 2-3"))).select("id", F.array_join(F.transform(T.page_spec("s"), lambda x: x.cast("string")), ",").alias("out"))


@R.add("str42_duration", "SELECT * FROM (VALUES (1, 172.8), (2, 420.0), (3, 0.25), (4, 3601.0)) t(id, out)")
def _(spark, sf):
    return spark.sql(values("id s", (1, "2m52.8s"), (2, "7m"), (3, "250ms"), (4, "1h1s"))).select("id", F.round(T.duration_seconds("s"), 6).alias("out"))


ENDINGS = ("tion", "en", "er", "es", "e")
_WORDS = "list_transform(regexp_extract_all(coalesce({0}, ''), '[^\\s.,;:!?()\"]+'), lambda x: lower(x))"
GLOSS_SQL = f"""WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS q, {_WORDS.format("text")} AS w FROM conversations),
raw AS (SELECT unnest({_WORDS.format("text")}) AS phrase FROM benchmark UNION ALL SELECT array_to_string(w[3:3 + q % 4], ' ') FROM c WHERE q % 3 = 0 AND len(w) > 8),
gloss AS (SELECT DISTINCT phrase, '<' || phrase || '>' AS gloss FROM raw WHERE length(phrase) > 3),
i AS (SELECT q, w, unnest(range(1, len(w) + 1)) AS place FROM c),
runs AS (SELECT q, false AS stem, -n AS first, place AS then_, place, n, array_to_string(w[place:place + n - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3), (4)) s(n) WHERE place + n - 1 <= len(w)
  UNION ALL SELECT q, true, place, k, place, 1, left(w[place], length(w[place]) - length(e)) FROM i, (VALUES {", ".join(f"({k}, '{e}')" for k, e in enumerate(ENDINGS))}) t(k, e) WHERE w[place] LIKE '%' || e AND length(w[place]) > length(e) + 1),
hits AS (SELECT q, place, n, gloss, row_number() OVER (PARTITION BY q ORDER BY stem, first, then_) AS r FROM runs JOIN gloss USING (phrase)),
walk AS (SELECT DISTINCT q, 0::BIGINT AS r, []::BIGINT[] AS used, []::VARCHAR[] AS said FROM hits
  UNION ALL SELECT k.q, h.r, CASE WHEN list_has_any(used, range(place, place + n)) THEN used ELSE used || range(place, place + n) END, CASE WHEN list_has_any(used, range(place, place + n)) THEN said ELSE said || [gloss] END FROM walk k JOIN hits h ON h.q = k.q AND h.r = k.r + 1),
last AS (SELECT q, max_by(said, r) AS said FROM walk GROUP BY q)
SELECT conv_id, turn, md5(text || CASE WHEN len(said) > 0 THEN ' ' || array_to_string(said, ' ') ELSE '' END) AS out, coalesce(len(said), 0) AS n FROM conversations LEFT JOIN last ON q = conv_id * 1000 + turn"""


@R.add("str33_gloss_conversations", GLOSS_SQL)
def _(spark, sf):
    """Turns against a table of the words of `benchmark` and of phrases of one to four words from every third turn."""
    c = table(spark, sf, "conversations").withColumn("q", F.col("conv_id") * 1000 + F.col("turn"))
    own = c.select("q", G.words(F.col("text")).alias("w")).where("q % 3 = 0 AND size(w) > 8").select(F.array_join(F.slice("w", F.lit(3), (F.col("q") % 4 + 1).cast("int")), " ").alias("phrase"))
    raw = table(spark, sf, "benchmark").select(F.explode(G.words(F.col("text"))).alias("phrase")).unionByName(own)
    gloss = raw.where("length(phrase) > 3").distinct().select("phrase", F.concat(F.lit("<"), "phrase", F.lit(">")).alias("gloss"))
    done = G.expand(c.select("q", "conv_id", "turn", "text"), "q", "text", gloss, ENDINGS)
    return done.select("conv_id", "turn", F.md5(F.col("expanded").cast("binary")).alias("out"), F.col("n_glosses").alias("n"))
