"""Rule overlay, guards and question-bank checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import overlay, quiz, retrieval, rules
from . import fixtures as fx
from .aggregates import INDEX
from .base import Registry, literal, table, values

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def _list(xs) -> str:
    return "(" + ", ".join(literal(x) for x in xs) + ")"


def _holds(terms: str, text: str) -> str:
    """SQL: the terms, a list, of which one needs all its parts and of each part one alternative."""
    return f"list_filter({terms}, lambda t: t <> '' AND len(list_filter(string_split(t, '+'), lambda p: len(list_filter(string_split(p, '|'), lambda a: contains({text}, a))) = 0)) = 0)"


def _long(text: str) -> str:
    return f"list_distinct(list_filter(string_split({text}, ' '), lambda w: length(w) >= 4))"


HITS = f"len({_holds('string_split(topic_terms, chr(59))', 'question')})"
SCOPE = "(r.manual = 'both' OR starts_with(a.manual, r.manual))"
TABLES = f"WITH asks AS ({fx.ASKS}), rules AS ({fx.RULES}), held AS ({fx.HELD}), names AS ({fx.NAMES}), freq AS ({fx.FREQUENCY}), "
STALE_SQL = f"""
sr AS (SELECT *, unnest(string_split(clause, ';')) AS one FROM rules WHERE verdict <> 'confirmed'), sa AS (SELECT qid, question, manual, unnest(string_split(clauses, ';')) AS one FROM asks),
stale AS (SELECT DISTINCT qid, rule_id, {HITS} AS hits, len(list_intersect({_long('question')}, {_long("rule_summary || ' ' || current_rule")})) AS fit, current_rule FROM sa a JOIN sr r USING (one) WHERE {SCOPE} AND {HITS} > 0),
"""
WITHHELD_SQL = f"""
met AS (SELECT qid, question, item, says, reason, topic_terms, r.clause AS own, {HITS} AS hits, list_intersect(string_split(clauses, ';'), list_filter(string_split(r.clause, ';'), lambda c: c <> '')) AS shared FROM asks a JOIN held r ON {SCOPE} WHERE {HITS} > 0),
beaten AS (SELECT DISTINCT x.qid, x.item FROM met x JOIN met o ON o.qid = x.qid AND o.hits > x.hits AND len(list_intersect(o.shared, x.shared)) > 0),
given AS (SELECT qid, name FROM asks JOIN names ON contains(question, name)),
subj AS (SELECT DISTINCT m.qid, m.item FROM met m JOIN given g ON g.qid = m.qid AND contains(concat_ws(' ', reason, says), g.name) WHERE len(list_intersect({_long('question')}, {_long('says')})) > 0),
wh AS (SELECT qid, item, 'clause' AS why, hits, says FROM met WHERE len(shared) > 0 AND (qid, item) NOT IN (SELECT (qid, item) FROM beaten)
  UNION ALL SELECT qid, item, CASE WHEN (qid, item) IN (SELECT (qid, item) FROM subj) THEN 'subject' ELSE 'general' END, hits, says FROM met WHERE len(shared) = 0 AND ((qid, item) IN (SELECT (qid, item) FROM subj)
    OR (own = '' AND qid NOT IN (SELECT qid FROM given) AND len({_holds("list_filter(string_split(topic_terms, ';'), lambda z: contains(z, '+'))", 'question')}) > 0))),
"""
PHRASE_SQL = f"""
tok AS (SELECT qid, string_split(question, ' ') AS t FROM asks), pos AS (SELECT qid, t, unnest(range(1, len(t) + 1)) AS i FROM tok),
bk AS (SELECT qid, i - 1 AS spot, t[i] AS head, list_reverse(t[greatest(i - 3, 1):i - 1]) AS back FROM pos WHERE t[i] IN {_list(fx.HEADS)} AND i > 1),
bs AS (SELECT *, list_position(list_transform(back, lambda w: w IN {_list(fx.STOPS + fx.HEADS)}), true) AS stop FROM bk),
phrase AS (SELECT qid, spot, head, list_distinct(CASE WHEN stop > 0 THEN back[1:stop - 1] ELSE back END) AS ws FROM bs WHERE coalesce(stop, 0) <> 1),
pw AS (SELECT qid, spot, head, unnest(CASE WHEN len(list_filter(ws, lambda w: w <> 'new')) > 0 THEN list_filter(ws, lambda w: w <> 'new') ELSE ws END) AS w FROM phrase),
nw AS (SELECT DISTINCT name_id, kind, unnest(string_split(words, ';')) AS w FROM names),
sc AS (SELECT qid, spot, name_id, CAST(count(*) AS INT) AS fit FROM pw JOIN nw ON pw.w = nw.w AND head = kind GROUP BY ALL),
fits AS (SELECT qid, spot, name_id, fit, count(*) OVER (PARTITION BY qid, spot) > 3 AS ambiguous FROM (SELECT *, max(fit) OVER (PARTITION BY qid, spot) AS most FROM sc) WHERE fit = most),
lost AS (SELECT qid, spot, array_to_string(list_sort(list(w)), ';') AS words FROM (SELECT qid, spot, unnest(ws) AS w FROM phrase WHERE (qid, spot) NOT IN (SELECT (qid, spot) FROM fits)) LEFT JOIN freq ON w = term WHERE coalesce(df, 0) <= 20 GROUP BY qid, spot)
"""


def asks(spark):
    return spark.sql(fx.ASKS).withColumns({"clauses": F.split("clauses", ";"), "manuals": F.array("manual")}).drop("manual")


def names(spark):
    return spark.sql(fx.NAMES).withColumn("words", F.split("words", ";"))


def bank(spark):
    return spark.sql(fx.BANK).withColumns({"options": F.split("options", ";"), "products": F.split("products", ";")})


def phrases(spark):
    found = overlay.phrases(asks(spark), fx.HEADS, fx.STOPS)
    return found, overlay.short_names(found, names(spark), fx.GENERIC)


OVERLAY_SQL = f""",
best AS (SELECT qid, max(hits * 1000 + fit) AS best, max(fit) AS top FROM stale GROUP BY qid),
lines AS (SELECT s.qid, string_agg(current_rule, ' ' ORDER BY rule_id) AS line FROM stale s JOIN best b ON s.qid = b.qid AND s.fit = b.top GROUP BY s.qid),
wf AS (SELECT w.*, hits * 1000 + len(list_intersect({_long('question')}, {_long('says')})) AS own FROM wh w JOIN asks USING (qid)),
ws AS (SELECT qid, string_agg(says, ' ' ORDER BY item) AS said, true AS any_kept FROM (SELECT wf.qid, says, min(item) AS item FROM wf LEFT JOIN best USING (qid) WHERE why <> 'clause' OR best IS NULL OR own >= best GROUP BY 1, 2) GROUP BY qid),
wq AS (SELECT DISTINCT qid FROM wh), st AS (SELECT g.qid, string_agg(status_line, ' ' ORDER BY name_id) AS status FROM given g JOIN names n ON n.name = g.name GROUP BY g.qid),
d AS (SELECT a.qid, said, line, status, a.qid IN (SELECT qid FROM wq) AS listed, a.qid IN (SELECT qid FROM lost) AS no_name, a.qid IN (SELECT qid FROM fits WHERE ambiguous) AS unclear, coalesce(said, concat_ws(' ', status, coalesce(line, answer))) AS x FROM asks a LEFT JOIN ws USING (qid) LEFT JOIN lines USING (qid) LEFT JOIN st USING (qid)),
e AS (SELECT *, replace(x, 'old charge', 'service charge') AS x1, contains(x, 'old charge') AS u1 FROM d), f AS (SELECT *, replace(x1, 'papers list', 'document list') AS x2, u1 OR contains(x1, 'papers list') AS used FROM e)
SELECT qid, CASE WHEN no_name AND NOT listed THEN '6:unknown_product' WHEN said IS NOT NULL THEN '4:not_available' || CASE WHEN used THEN ';3:term_updates' ELSE '' END WHEN unclear THEN '1:ambiguous_product'
  ELSE concat_ws(';', CASE WHEN status IS NOT NULL THEN '1:product_status' END, CASE WHEN line IS NOT NULL THEN '2:rule_updates' END, CASE WHEN used THEN '3:term_updates' END) END AS fired,
  CASE WHEN no_name AND NOT listed THEN 'no such name' WHEN said IS NULL AND unclear THEN 'which one?' ELSE x2 END AS answer FROM f
"""


@R.add("jn10_stale_rules", TABLES + STALE_SQL.rstrip().rstrip(",") + " SELECT qid, rule_id, hits, fit FROM stale")
def _(spark, sf):
    return overlay.stale_rules(asks(spark), spark.sql(fx.RULES)).select("qid", "rule_id", "hits", "fit")


@R.add("jn11_withheld", TABLES + WITHHELD_SQL.rstrip().rstrip(",") + " SELECT qid, item, why, hits FROM wh")
def _(spark, sf):
    """By clause, by subject, or by a general question; on shared clauses the most term hits, ties too."""
    return overlay.withheld(asks(spark), spark.sql(fx.HELD), names(spark)).select("qid", "item", "why", "hits")


@R.add("rul01_precedence", TABLES + STALE_SQL + WITHHELD_SQL + PHRASE_SQL + OVERLAY_SQL)
def _(spark, sf):
    """All flags come from the tables: stale and withheld rules, names in full, short and unknown ones, old terms."""
    a, n = asks(spark), names(spark)
    found, fits = phrases(spark)
    lost = overlay.unknown_names(found, fits, spark.sql(fx.FREQUENCY))
    return overlay.overlay(a, overlay.stale_rules(a, spark.sql(fx.RULES)), overlay.withheld(a, spark.sql(fx.HELD), n), n, overlay.named(a, n), fits.where("ambiguous"), lost, list(fx.TERMS))


@R.add("rul02_short_names", TABLES + PHRASE_SQL + "SELECT * FROM fits")
def _(spark, sf):
    return phrases(spark)[1]


@R.add("rul03_unknown_names", TABLES + PHRASE_SQL + "SELECT * FROM lost")
def _(spark, sf):
    return overlay.unknown_names(*phrases(spark), spark.sql(fx.FREQUENCY)).withColumn("words", F.array_join("words", ";"))


@R.add("rul03_unknown_words", f"WITH c AS MATERIALIZED (SELECT doc_id, {INDEX} AS toks FROM documents), v AS (SELECT w, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(toks)) AS w FROM c) GROUP BY w), q AS (SELECT DISTINCT conv_id, unnest({INDEX}) AS w FROM conversations WHERE role = 'user') SELECT conv_id, count(*) AS unknown FROM q LEFT JOIN v USING (w) WHERE coalesce(df, 0) <= 20 GROUP BY conv_id")
def _(spark, sf):
    """Words of a conversation's questions that are in at most 20 documents."""
    df = retrieval.document_frequency(retrieval.query_terms(table(spark, sf, "documents"), "doc_id", F.col("text")))
    q = retrieval.query_terms(table(spark, sf, "conversations").where("role = 'user'"), "conv_id", F.col("text")).distinct()
    return q.join(df, "term", "left").where(F.coalesce("df", F.lit(0)) <= overlay.ORDINARY).groupBy(F.col("qid").alias("conv_id")).agg(F.count("*").alias("unknown"))


@R.add("rul04_term_substitution", f"WITH asks AS ({fx.ASKS}) SELECT qid, replace(replace(answer, 'old charge', 'service charge'), 'papers list', 'document list') AS out, concat_ws(';', CASE WHEN contains(answer, 'old charge') THEN 'old charge>service charge' END, CASE WHEN contains(answer, 'papers list') THEN 'papers list>document list' END) AS used FROM asks")
def _(spark, sf):
    t, used = rules.substitute_terms(F.col("answer"), list(fx.TERMS))
    return spark.sql(fx.ASKS).select("qid", t.alias("out"), F.array_join(used, ";").alias("used"))


ANSWERS_SQL = f"""
WITH b AS ({fx.BANK}), v AS (SELECT id, chunk_text AS answer, list_filter(['another text', 'sub'], lambda w: contains(chunk_text, w)) AS lits,
list_intersect(list_distinct(list_transform(regexp_extract_all(chunk_text, '[0-9][0-9,.]* ?(?:month|percent|taka)'), lambda x: regexp_replace(x, '([0-9]) ?([a-z])', '\\1 \\2'))), ['5 month', '700 taka', '12 percent']) AS figs,
list_filter({list(fx.ROLES)!r}, lambda r: contains(chunk_text, r) AND NOT contains(question, r)) AS hit FROM b),
w AS (SELECT id, answer, list_transform(lits, lambda x: 'literal:' || x) || list_transform(figs, lambda x: 'clause_figure:' || x) || list_transform(list_filter(hit, lambda r: len(list_filter(hit, lambda o: o <> r AND contains(o, r))) = 0), lambda x: 'clause_role:' || x) AS found FROM v)
"""


def judged(spark):
    """Answers of the bank against literals, armed figures and roles; a role in the question is allowed."""
    b = spark.sql(fx.BANK).select("id", "question", F.col("chunk_text").alias("answer"))
    array = lambda xs: F.array(*(F.lit(x) for x in xs))
    return overlay.violations(b, array(("another text", "sub")), array(("5 month", "700 taka", "12 percent")), array(fx.ROLES), F.col("question"), T.unit_numbers_in("answer", "|".join(fx.UNITS)))


@R.add("rul05_answer_violations", ANSWERS_SQL + "SELECT id, array_to_string(list_sort(found), ';') AS violations FROM w")
def _(spark, sf):
    """Figures count with their unit only: a bare number is never compared."""
    return judged(spark).select("id", F.array_join(F.array_sort("violations"), ";").alias("violations"))


@R.add("rul06_post_filter", ANSWERS_SQL + "SELECT id, CASE WHEN len(found) > 0 THEN 'not given out' ELSE answer END AS answer, CASE WHEN len(found) > 0 THEN answer END AS original FROM w")
def _(spark, sf):
    return overlay.post_filter(judged(spark), "not given out").select("id", "answer", "original")


@R.add("rul07_score_floor", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS qid, max(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS top FROM q JOIN embeddings e ON q.vec_id <> e.vec_id GROUP BY 1) SELECT qid, top < 0.4044 AS abstains FROM s")
def _(spark, sf):
    from .aggregates import nearest

    return nearest(spark, sf, 1).select("qid", F.col("score").alias("top")).select("qid", (F.coalesce("top", F.lit(0.0)) < retrieval.SCORE_FLOOR).alias("abstains"))


@R.add("rul08_label_omitted", f"WITH b AS ({fx.BANK}), l AS (SELECT * FROM (VALUES ('area manager'), ('branch officer'), ('programme head'), ('taka')) t(label)) SELECT DISTINCT id, label FROM b JOIN l ON contains(chunk_text, label) WHERE NOT contains(explanation, label)")
def _(spark, sf):
    """Labels of the cited text that the answer leaves out."""
    b, labels = spark.sql(fx.BANK), spark.sql(values("label", ("area manager",), ("branch officer",), ("programme head",), ("taka",)))
    return overlay.omitted_labels(b.select(F.col("id").alias("qid"), F.col("explanation").alias("answer")), b.select(F.col("id").alias("qid"), F.col("chunk_text").alias("heading")), labels).withColumnRenamed("qid", "id")


@R.add("rul09_reply_guards", """
WITH t AS (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS x FROM conversations WHERE role = 'assistant'), w AS (SELECT *, list_filter(string_split_regex(x, '\\s+'), lambda z: z <> '') AS ws FROM t),
f AS (SELECT conv_id, turn, NOT regexp_matches(x, '[.!?।]$') AS cut_off, len(ws) >= 8 AND len(list_filter(range(1, len(ws) - 6), lambda i: ws[i] = ws[i + 1] AND ws[i] = ws[i + 2] AND ws[i] = ws[i + 3] AND ws[i] = ws[i + 4] AND ws[i] = ws[i + 5] AND ws[i] = ws[i + 6] AND ws[i] = ws[i + 7])) > 0 AS loops FROM w),
g AS (SELECT conv_id, turn, cut_off, loops, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt FROM f), h AS (SELECT conv_id, min(CASE WHEN NOT cut_off AND NOT loops THEN attempt END) AS good, max(attempt) AS n FROM g GROUP BY conv_id)
SELECT conv_id, turn, cut_off, loops, CAST(attempt AS INT) AS attempt, attempt = least(coalesce(good, 3), 3, n) AS taken FROM g JOIN h USING (conv_id) WHERE attempt <= least(coalesce(good, 3), 3, n)
""")
def _(spark, sf):
    """A conversation's replies in turn stand for attempts: the first that neither loops nor is cut off is taken, the third in any case."""
    return rules.attempts(table(spark, sf, "conversations").where("role = 'assistant'"), "conv_id", "turn", "text")


SPANS = "regexp_extract_all(explanation, '[0-9][0-9,.]* (?:month|percent|taka)')"
_UNIT = "trim(regexp_replace({}, '^[0-9][0-9,.]*', ''))"
_SIDE = "(regexp_matches({0}, '-| to ') AND regexp_matches({0}, '[0-9]'))"
# every place of the figure: a sign of a range with a number before it, or with a number and its unit after it
_RANGE_END = f"""correct <> '' AND len(list_filter(range(1, greatest(length(explanation) - length(correct) + 2, 1)), lambda i: substr(explanation, i, length(correct)) = correct AND (
  {_SIDE.format("substr(explanation, greatest(i - 14, 1), least(i - 1, 14))")} OR {_SIDE.format("substr(explanation, i + length(correct), 14)")} AND regexp_matches(substr(explanation, i + length(correct), 14), '[0-9][0-9,.]*\\s*(?:{'|'.join(fx.UNITS)})')))) > 0"""
_AT = "instr(explanation, correct)"
VALIDATE_SQL = f"""
WITH b AS (SELECT * REPLACE (string_split(options, ';') AS options) FROM ({fx.BANK})) SELECT id, concat_ws(';', CASE WHEN NOT contains(chunk_text, correct) THEN 'answer not in chunk' END,
CASE WHEN len(list_filter(options, lambda o: o <> correct AND contains(chunk_text, o))) > 0 THEN 'distractor in chunk' END, CASE WHEN len(list_distinct(list_transform(options, lambda o: lower(o)))) <> 4 THEN 'options not distinct' END,
CASE WHEN len(options) <> 4 THEN 'not four options' END, CASE WHEN excluded THEN 'chunk withheld' END, CASE WHEN question = '' THEN 'no question' END,
CASE WHEN (kind = 'figure' AND length(split_part(correct, ' ', 1)) > 1 AND contains(question, split_part(correct, ' ', 1))) OR (kind = 'role' AND len(list_filter(string_split(correct, ' '), lambda w: length(w) >= 3 AND NOT contains(question, w))) = 0) THEN 'question has answer' END,
CASE WHEN NOT contains(explanation, correct) THEN 'answer not in explanation' END,
CASE WHEN kind = 'figure' AND {_RANGE_END} THEN 'end of a range' END,
CASE WHEN kind = 'figure' AND starts_with(correct, '0 ') THEN 'zero' END,
CASE WHEN kind = 'figure' AND len(list_filter({SPANS}, lambda s: s <> correct AND {_UNIT.format('s')} = {_UNIT.format('correct')})) > 0 THEN 'rivals of the same unit' END) AS reasons FROM b
"""


@R.add("rul10_quiz_validate", VALIDATE_SQL)
def _(spark, sf):
    return quiz.validate(bank(spark), "|".join(fx.UNITS)).select("id", F.array_join("reasons", ";").alias("reasons"))


RECHECK_SQL = f"""
WITH b AS (SELECT * REPLACE (string_split(options, ';') AS options) FROM ({fx.BANK})), r AS (SELECT id, correct, list_filter({list(fx.ROLES)!r}, lambda x: contains(explanation, x)) AS ins FROM b WHERE kind = 'role'), pl AS (SELECT list(DISTINCT span) AS spans FROM ({fx.POOL})),
s AS (SELECT id, list_sort(list_distinct(list_filter(options, lambda o: o <> correct AND NOT list_contains(spans, o)))) AS stray, list_contains(regexp_extract_all(chunk_text, '[0-9][0-9,.]* (?:month|percent|taka)'), correct) AS fine FROM b, pl WHERE kind = 'figure')
SELECT id, concat_ws(';', CASE WHEN NOT list_contains(ins, correct) THEN 'role not in segment' END, CASE WHEN len(list_filter(ins, lambda x: len(list_filter(ins, lambda y: y <> x AND contains(y, x))) = 0)) > 1 THEN 'segment names more roles' END) AS reasons FROM r
UNION ALL SELECT id, concat_ws(';', CASE WHEN NOT fine THEN 'answer no figure' END, CASE WHEN len(stray) > 0 THEN 'no figure: ' || array_to_string(stray, ',') END) FROM s
"""


@R.add("rul10_recheck_kind", RECHECK_SQL)
def _(spark, sf):
    roles = spark.createDataFrame([(r,) for r in fx.ROLES], "role string")
    return quiz.recheck_kind(bank(spark), spark.sql(fx.POOL), roles, "|".join(fx.UNITS)).select("id", F.array_join("reasons", ";").alias("reasons"))


DROPS_SQL = f"""
WITH b AS ({fx.BANK}), o AS (SELECT id, question, clause, correct, unnest(string_split(options, ';')) AS opt FROM b), r AS (SELECT rule_id, unnest(string_split(clause, ';')) AS clause FROM ({fx.RULES}) WHERE verdict <> 'confirmed')
SELECT DISTINCT id, '1a' AS step, rule_id AS detail FROM b JOIN r USING (clause) UNION SELECT id, '1b', name_id FROM b JOIN (SELECT * FROM ({fx.NAMES}) WHERE status = 'suspended') n ON contains(heading, n.kind) OR contains(explanation, split_part(n.words, ';', 1))
UNION SELECT id, '1c', opt || ': ' || old FROM o, (VALUES ('AM'), ('team lead')) t(old) WHERE contains(opt, old) UNION SELECT o.id, '1d', opt || ': ' || rule_id FROM o JOIN ({fx.TRUTHS}) s ON o.id = s.id WHERE opt <> correct AND contains(statement, opt) AND NOT contains(statement, correct)
"""


@R.add("rul11_recheck_drops", DROPS_SQL)
def _(spark, sf):
    b = bank(spark)
    rule = spark.sql(fx.RULES).where(F.col("verdict").isin(*overlay.STALE)).select("rule_id", F.explode(F.split("clause", ";")).alias("clause"))
    off = spark.sql(fx.NAMES).where("status = 'suspended'").withColumn("first", F.split("words", ";")[0])
    suspended = retrieval.against(b, off.select("name_id", F.col("kind").alias("name_kind"), "first"), F.col("heading").contains(F.col("name_kind")) | F.col("explanation").contains(F.col("first"))).select("id", "name_id")
    return quiz.drops(b, b.join(rule, "clause").select("id", "rule_id"), suspended, [("AM", "area manager"), ("team lead", "head")], spark.sql(fx.TRUTHS))


DISTRACTOR_SQL = f"""
WITH b AS (SELECT id, chunk_id, clause, string_split(products, ';') AS products, chunk_text, split_part(correct, ' ', 2) AS unit, CAST(split_part(correct, ' ', 1) AS DOUBLE) AS value FROM ({fx.BANK}) WHERE kind = 'figure'),
p AS (SELECT span, chunk_id, clause, string_split(products, ';') AS products, split_part(span, ' ', 2) AS unit, CAST(split_part(span, ' ', 1) AS DOUBLE) AS value FROM ({fx.POOL})), s AS (SELECT DISTINCT span, unit, value FROM p)
SELECT id, span FROM b JOIN s USING (unit) WHERE s.value <> b.value AND s.value <= 10 * b.value AND b.value <= 10 * s.value AND NOT contains(chunk_text, span)
AND NOT EXISTS (SELECT 1 FROM p WHERE p.span = s.span AND p.chunk_id = b.chunk_id) AND NOT EXISTS (SELECT 1 FROM p WHERE p.span = s.span AND p.clause = b.clause) AND NOT EXISTS (SELECT 1 FROM p WHERE p.span = s.span AND list_has_any(p.products, b.products))
"""


@R.add("rul12_distractors", DISTRACTOR_SQL)
def _(spark, sf):
    split = lambda df, c: df.withColumns({"unit": quiz.unit_of(F.col(c)), "value": quiz.number_of(F.col(c))})
    pool = spark.sql(fx.POOL).withColumn("products", F.split("products", ";"))
    return quiz.distractors(split(bank(spark).where("kind = 'figure'"), "correct"), split(pool, "span"))


AUDIT_SQL = f"""
WITH b AS (SELECT * REPLACE (string_split(options, ';') AS options) FROM ({fx.BANK})), p AS (SELECT id, unnest(options) AS o FROM b), k AS (SELECT id, count(*) > count(DISTINCT post) AS twice FROM p JOIN (VALUES {', '.join(str(kv) for kv in fx.POSTS.items())}) t(o, post) USING (o) GROUP BY id)
SELECT id, coalesce(twice, false) AS a, kind = 'role' AND regexp_matches(explanation, regexp_escape(correct) || '(s)? (is checked|will be checked)') AS b, kind = 'figure' AND regexp_matches(explanation || ' ' || heading, 'example|=|[0-9]\\s*[xX]\\s*[0-9(]') AS c,
kind = 'role' AND contains(explanation, correct) AND NOT regexp_matches(explanation, '(^|[^a-z])' || regexp_escape(correct) || '(s)?($|[^a-z])') AS d, coalesce(length(correct) > 1.5 * list_max(list_transform(list_filter(options, lambda o: o <> correct), lambda o: length(o))), false) AS e FROM b LEFT JOIN k USING (id)
"""


@R.add("rul13_audits", AUDIT_SQL)
def _(spark, sf):
    a = quiz.audits(bank(spark), fx.POSTS, "is checked|will be checked", "example", "a-z", "s")
    return a.select("id", *(F.coalesce(f"audit_4{x}", F.lit(False)).alias(x) for x in "abcde"))


_FP = "sha256(concat({q}, chr(31), correct, chr(31), options, chr(31), sha256(chunk_text), chr(31)))"
STATUS_SQL = f"""
WITH b AS ({fx.BANK}), n AS (SELECT id, {_FP.format(q='question')} AS now, {_FP.format(q="question || '!'")} AS other FROM b)
SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'reviewed' ELSE 'reviewed, changed since' END WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'checked' ELSE 'checked, changed since' END ELSE 'no check recorded' END AS status, substr(now, 1, 8) AS now FROM n WHERE now <> other
"""


@R.add("rul14_review_status", STATUS_SQL)
def _(spark, sf):
    """Every fifth question has a review and every third a check; those of odd ids were made before the question was edited."""
    b = spark.sql(fx.BANK).join(spark.sql(fx.BANK).select("id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")), "id").drop("chunk_id").withColumnRenamed("key", "chunk_id")
    hashes = b.select("chunk_id", F.sha2("chunk_text", 256).alias("sha256"))
    seen = b.join(hashes, "chunk_id").withColumn("question", F.when(F.col("id") % 2 == 0, F.col("question")).otherwise(F.concat("question", F.lit("!"))))
    then = seen.select("id", rules.fingerprint("question", "correct", "options", "sha256").alias("fingerprint"))
    s = quiz.review_status(b, then.where("id % 5 = 0"), then.where("id % 3 = 0"), hashes, ("question", "correct", "options"))
    now = b.join(hashes, "chunk_id").select("id", F.substring(rules.fingerprint("question", "correct", "options", "sha256"), 1, 8).alias("now"))
    return s.join(now, "id")


LINT_SQL = f"""
WITH g AS (SELECT id, scope, mode, CASE WHEN cites = '' THEN [] ELSE list_distinct(string_split(cites, ';')) END AS c, armed, answerable FROM ({fx.GOLD})), k AS (SELECT ['ma_2025', 'mb_2025', 'mc_2024'] AS known),
w AS (SELECT *, scope IN ('any', 'both') AS multi, CASE WHEN list_contains(known, scope) THEN scope WHEN len(list_filter(known, lambda x: starts_with(x, scope))) = 1 THEN list_filter(known, lambda x: starts_with(x, scope))[1] END AS want FROM g, k)
SELECT id, concat_ws(';', CASE WHEN list_contains(c, 'md_2023') THEN 'unknown manual: md_2023' END, CASE WHEN multi AND len(c) = 1 AND mode <> 'any' THEN 'one citation for any manual' END, CASE WHEN NOT multi AND len(c) > 0 AND want IS NOT NULL AND NOT list_contains(c, want) THEN 'scope not cited' END, CASE WHEN answerable AND armed = 0 THEN 'unarmed' END) AS lints FROM w
"""


@R.add("rul15_gold_lints", LINT_SQL)
def _(spark, sf):
    g = spark.sql(fx.GOLD).withColumn("cites", F.filter(F.split("cites", ";"), lambda c: c != ""))
    return quiz.gold_lints(g, spark.createDataFrame([(m,) for m in fx.MANUALS], "manual_id string")).select("id", F.array_join("lints", ";").alias("lints"))


_NUM = "list_transform(regexp_extract_all(translate({}, '০১২৩৪৫৬৭৮৯', '0123456789'), '[0-9][0-9,.]*'), lambda x: x)"
TRANSLATION_SQL = f"""
WITH p AS (SELECT *, {_NUM.format('bn')} AS a, {_NUM.format('en')} AS b FROM ({fx.PAIRS})), ea AS (SELECT id, unnest(a) AS v, 1 AS k FROM p UNION ALL SELECT id, unnest(b), -1 FROM p), n AS (SELECT id, v, CAST(sum(k) AS INT) AS k FROM ea GROUP BY ALL),
d AS (SELECT id, string_agg(repeat(v || ' ', k), '' ORDER BY v) FILTER (WHERE k > 0) AS ob, string_agg(repeat(v || ' ', -k), '' ORDER BY v) FILTER (WHERE k < 0) AS oe FROM n GROUP BY id)
SELECT id, trim(coalesce(ob, '')) AS only_bn, trim(coalesce(oe, '')) AS only_en, concat_ws(';', CASE WHEN contains(en, 'installment') THEN 'installment was replaced by instalment' END, CASE WHEN contains(bn, 'কিস্তি') AND NOT contains(en, 'instalment') THEN 'কিস্তি needs instalment' END,
CASE WHEN contains(en, 'credit') THEN 'credit was replaced by loan' END, CASE WHEN contains(bn, 'ঋণ') AND NOT contains(lower(en), 'loan') THEN 'ঋণ needs loan' END) AS term_misses,
CASE WHEN contains(en, 'Guard Life Insurance Limited') THEN 'Guard Life Insurance Limited' WHEN contains(en, 'Delta Company Ltd') THEN 'Delta Company Ltd' ELSE '' END AS misnamed, CASE WHEN contains(en, 'Boro Loan here') THEN 'Boro Loan' ELSE '' END AS gloss_missing FROM p JOIN d USING (id)
"""


@R.add("rul16_translation_checks", TRANSLATION_SQL)
def _(spark, sf):
    c = quiz.translation_checks(spark.sql(fx.PAIRS), list(fx.AGREED), list(fx.INSURERS), list(fx.GLOSSES))
    return c.select("id", *(F.array_join(x, " ").alias(x) for x in ("only_bn", "only_en")), *(F.array_join(x, ";").alias(x) for x in ("term_misses", "misnamed", "gloss_missing")))


@R.add("rul17_term_sheet", """
WITH t AS (SELECT * FROM (VALUES ('heat'), ('keit'), ('ement'), ('zzqq')) t(term)), u AS (SELECT term, doc_id, source, (length(text) - length(replace(text, term, ''))) // length(term) AS n, len(regexp_extract_all(text, term || '($|[^a-zA-Z])')) AS whole FROM documents, t WHERE contains(text, term)),
c AS (SELECT term, count(*) AS chats FROM conversations, t WHERE contains(text, term) GROUP BY term)
SELECT term, min(doc_id) AS first_use, arg_min(source, doc_id) AS first_source, count(doc_id) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS uses, coalesce(sum(n) > 2 * sum(whole), false) AS inflated, coalesce(max(chats), 0) AS chats FROM t LEFT JOIN u USING (term) LEFT JOIN c USING (term) GROUP BY term
""")
def _(spark, sf):
    """First use with its place, uses with the share that only lies inside longer words, and how often the questions use the term."""
    return rules.term_sheet(table(spark, sf, "documents"), table(spark, sf, "conversations"), ["heat", "keit", "ement", "zzqq"])


@R.add("rul18_context_block", "SELECT conv_id, string_agg('[' || turn || '] (' || role || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return rules.context_blocks(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@R.add("rul18_glossary", "SELECT conv_id, array_to_string(list_sort(list(DISTINCT term || ': ' || gloss)), chr(10)) AS glossary FROM conversations, (VALUES ('heat', 'warmth'), ('keit', 'ending'), ('und', 'and')) g(term, gloss) WHERE contains(text, term) GROUP BY conv_id")
def _(spark, sf):
    """Only terms that the context has."""
    g = spark.sql(values("term gloss", ("heat", "warmth"), ("keit", "ending"), ("und", "and")))
    return rules.glossary(table(spark, sf, "conversations"), "conv_id", "text", g)
