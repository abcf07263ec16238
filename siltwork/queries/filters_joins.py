"""Predicates and joins over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment, dedup, joins, quiz, rules, structure
from ..sources import sinks
from . import fixtures as fx
from .base import Registry, table, values

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
PATTERNS = (("onto", "(^|[^a-z])on[a-z]*"), ("heat", "heat"), ("ement", "ement"), ("und", "(^|[^a-z])und([^a-z]|$)"))


def docs(spark, sf):
    return table(spark, sf, "documents")


_TAGS = "list_filter([CASE WHEN regexp_matches(text, '(^|[^a-z])und([^a-z]|$)') THEN 'und' END, CASE WHEN contains(text, 'tion') THEN 'tion' END], lambda x: x IS NOT NULL)"


@R.add("flt01_search_filter", f"SELECT doc_id FROM (SELECT *, {_TAGS} AS tags FROM documents) WHERE source IN ('src1', 'src2') AND regexp_matches(text, 'he|en') AND (tags = [] OR list_contains(tags, 'tion')) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    """Exclusion, manual, pattern and tags at once; a chunk without tags is open to every tag."""
    out = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    tagged = docs(spark, sf).withColumn("tags", joins.pattern_tags(F.col("text"), (("und", "(^|[^a-z])und([^a-z]|$)"), ("tion", "tion"))))
    return joins.search_filter(tagged, out, "doc_id", F.col("source").isin("src1", "src2"), "he|en", ("tags", "tion")).select("doc_id")


@R.add("flt02_permissive_retention", "SELECT source, count(*) FILTER (WHERE regexp_matches(text, 'heat')) AS strict, count(*) FILTER (WHERE regexp_matches(text, 'heat') OR NOT regexp_matches(text, 'heat|ement')) AS permissive, count(*) AS total FROM documents GROUP BY source")
def _(spark, sf):
    named = F.col("text").rlike("heat")
    return docs(spark, sf).groupBy("source").agg(F.count_if(named).alias("strict"), F.count_if(named | ~F.col("text").rlike("heat|ement")).alias("permissive"), F.count("*").alias("total"))


@R.add("flt03_pattern_tags", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{rx}') THEN '{k}' END" for k, rx in PATTERNS) + "], lambda x: x IS NOT NULL), ';') AS tags FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(joins.pattern_tags(F.lower("text"), PATTERNS), ";").alias("tags"))


@R.add("flt04_name_alternation", "SELECT p_partkey, regexp_matches(lower(p_name), 'large +red|steel|tin') AS named FROM part")
def _(spark, sf):
    rx = joins.name_alternation(["tin", "large red", "steel"])
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").rlike(rx).alias("named"))


@R.add("flt05_topic_predicate", "SELECT conv_id, turn, (contains(text, 'the') AND (contains(text, 'heat') OR contains(text, 'tion'))) OR contains(text, 'ement') AS out FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", joins.topic("the+heat|tion;ement", F.col("text"), {}).alias("out"))


@R.add("flt05_topic_without_terms", "SELECT count(*) FILTER (WHERE false) AS fired FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").agg(F.count_if(joins.topic("", F.col("text"), {})).alias("fired"))


@R.add("flt06_scrub_split", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS excluded FROM documents")
def _(spark, sf):
    out = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    d = docs(spark, sf).select("doc_id")
    return d.join(out, "doc_id", "left_semi").withColumn("excluded", F.lit(True)).unionByName(d.join(out, "doc_id", "left_anti").withColumn("excluded", F.lit(False)))


SPANS = values("span", ("heat",), ("zzqq",), ("en/1",))


@R.add("flt07_sink_assertion", f"WITH w AS (SELECT page_id, url, html FROM pages WHERE page_id % 10 <> 3), x AS (SELECT doc_id AS page_id FROM labels WHERE toxic = 1), t AS (SELECT page_id, 'url' AS c, url AS said FROM w UNION ALL SELECT page_id, 'html', html FROM w) SELECT page_id, 'page_id' AS \"column\", 'excluded id' AS what FROM w WHERE page_id IN (SELECT page_id FROM x) UNION ALL SELECT page_id, c, 'span: ' || span FROM t JOIN ({SPANS}) s ON contains(said, span)")
def _(spark, sf):
    """Leaks of a table that was written without its filter: excluded ids and withheld spans, column by column."""
    written = table(spark, sf, "pages").where("page_id % 10 <> 3")
    return joins.leaks(written, "page_id", table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")), spark.sql(SPANS))


@R.add("flt07_sink_clean", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND NOT contains(html, 'heat') AND NOT contains(url, 'heat') AND NOT contains(html, 'en/1') AND NOT contains(url, 'en/1') AND NOT contains(html, 'zzqq') AND NOT contains(url, 'zzqq')")
def _(spark, sf):
    """What is left when everything that leaks goes; the gate passes on it."""
    out, spans = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")), spark.sql(SPANS)
    pages = table(spark, sf, "pages")
    kept = pages.join(joins.leaks(pages, "page_id", out, spans).select("page_id").distinct(), "page_id", "left_anti")
    sinks.gate([("sink", lambda: joins.leaks(kept, "page_id", out, spans))])
    return kept.select("page_id")


@R.add(
    "flt08_containment_label",
    "SELECT b.item_id, CASE WHEN bool_or(contains(d.text, b.text)) THEN 'exact' WHEN bool_or(contains(regexp_replace(lower(d.text), '\\s+', ' ', 'g'), regexp_replace(lower(b.text), '\\s+', ' ', 'g'))) THEN 'normalised' ELSE 'absent' END AS label FROM benchmark b CROSS JOIN documents d GROUP BY b.item_id",
)
def _(spark, sf):
    """Items are a stated query set; a document is joined with an item only where it holds the item's opening words."""
    return joins.containment(docs(spark, sf), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text").select("item_id", "label")


FACTS = values("id fact answer", (1, "limit 40,000", "the limit 40000 applies"), (2, "rate 12 and 5", "5 percent, 12 months"), (3, "fee 7", "no fee"), (4, "same words", "the same  words"))


@R.add("flt09_fact_present", "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false)) t(id, present)")
def _(spark, sf):
    a, f = T.canon("answer"), T.canon("fact")
    nums = lambda c: F.regexp_extract_all(c, F.lit("[0-9][0-9.]*"), F.lit(0))
    return spark.sql(FACTS).select("id", (a.contains(f) | ((F.size(nums(f)) > 0) & (F.size(F.array_except(nums(f), nums(a))) == 0))).alias("present"))


CITES = values("id mode want got", (1, "all", "a §1.2;b §3", "A 1.2;b 3"), (2, "all", "a §1.2;b §3", "a 1.2"), (3, "any", "a §1.2;b §3", "b §3.1"), (4, "all", "", "a"))


@R.add("flt10_citation_match", "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, NULL)) t(id, ok)")
def _(spark, sf):
    c = spark.sql(CITES).select("id", "mode", *(F.filter(F.transform(F.split(k, ";"), lambda x: T.norm_citation(x)), lambda x: x != "").alias(k) for k in ("want", "got")))
    hit = lambda e: F.exists("got", lambda x: x.contains(e) | e.contains(x))
    return c.select("id", F.when(F.size("want") > 0, F.when(F.col("mode") == "any", F.exists("want", hit)).otherwise(F.forall("want", hit))).alias("ok"))


@R.add("flt11_prefix_scope", "WITH s AS (SELECT DISTINCT source FROM documents), q(scope) AS (VALUES ('src1'), ('src2'), ('src19'), ('nothing')) SELECT q.scope, CASE WHEN count(s.source) = 1 THEN min(s.source) END AS resolved FROM q LEFT JOIN s ON starts_with(s.source, q.scope) GROUP BY q.scope")
def _(spark, sf):
    s = docs(spark, sf).select("source").distinct()
    q = spark.sql(values("scope", ("src1",), ("src2",), ("src19",), ("nothing",)))
    return joins.unique_prefix(q, "scope", s, "source")


@R.add("flt12_abstain_marker", "SELECT conv_id, turn, regexp_matches(lower(text), 'do not know|cannot answer|ne sais pas') AS abstains FROM conversations WHERE role = 'assistant'")
def _(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.lower("text").rlike("do not know|cannot answer|ne sais pas").alias("abstains"))


@R.add("flt13_query_language", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[ঀ-৿]') THEN 'bn' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'none' END AS lang FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("text").rlike("[ঀ-৿]"), "bn").when(F.col("text").rlike("[A-Za-z]"), "en").otherwise("none").alias("lang"))


@R.add("flt11_scoped_manuals", f"WITH g AS (SELECT id AS qid, CASE WHEN id % 9 = 0 THEN 'zz' WHEN id % 7 = 0 THEN scope || '_2025_v2' ELSE scope END AS scope FROM ({fx.GOLD})), m AS (SELECT unnest({list(fx.MANUALS)!r}) AS manual_id), f AS (SELECT qid, manual_id FROM g, m WHERE scope NOT IN ('any', 'both') AND (starts_with(manual_id, scope) OR starts_with(scope, manual_id))) SELECT * FROM f UNION ALL SELECT qid, manual_id FROM g, m WHERE qid NOT IN (SELECT qid FROM f)")
def _(spark, sf):
    """Either side may be a prefix of the other; several manuals may fit, and all do where none does."""
    s = F.when(F.col("id") % 9 == 0, "zz").when(F.col("id") % 7 == 0, F.concat("scope", F.lit("_2025_v2"))).otherwise(F.col("scope"))
    g = spark.sql(fx.GOLD).select(F.col("id").alias("qid"), F.array(s).alias("scopes"))
    return joins.scoped_manuals(g, spark.createDataFrame([(m,) for m in fx.MANUALS], "manual_id string"))


_SEG = "regexp_extract_all(explanation, '[0-9][0-9,.]* (?:month|percent|taka)')"
_AT = "instr(explanation, correct)"
_NEAR = "(regexp_matches({0}, '-| to ') AND regexp_matches({0}, '[0-9]'))"
# every place of the figure: a sign of a range with a number before it, or with a number and its unit after it
_RANGE_END = f"""correct <> '' AND len(list_filter(range(1, greatest(length(explanation) - length(correct) + 2, 1)), lambda i: substr(explanation, i, length(correct)) = correct AND (
  {_NEAR.format("substr(explanation, greatest(i - 14, 1), least(i - 1, 14))")} OR {_NEAR.format("substr(explanation, i + length(correct), 14)")} AND regexp_matches(substr(explanation, i + length(correct), 14), '[0-9][0-9,.]*\\s*(?:{'|'.join(fx.UNITS)})')))) > 0"""
REJECT_SQL = f"""
WITH b AS (SELECT *, split_part(correct, ' ', 1) AS num, split_part(correct, ' ', 2) AS unit FROM ({fx.BANK})), r AS (SELECT *, len(list_filter(list_distinct({_SEG}), lambda x: x <> correct AND split_part(x, ' ', 2) = unit)) AS rivals FROM b)
SELECT id, concat_ws(';', CASE WHEN kind = 'figure' AND {_RANGE_END} THEN 'range' END, CASE WHEN kind = 'figure' AND num = '0' THEN 'zero' END,
CASE WHEN (kind = 'figure' AND length(num) > 1 AND contains(question, num)) OR (kind = 'role' AND len(list_filter(string_split(correct, ' '), lambda w: length(w) >= 3 AND NOT contains(question, w))) = 0) THEN 'leak' END, CASE WHEN kind = 'figure' AND rivals > 0 THEN 'rivals:' || rivals END) AS rejects FROM r
"""


@R.add("flt14_answer_rejects", REJECT_SQL)
def _(spark, sf):
    b = spark.sql(fx.BANK).withColumn("options", F.split("options", ";"))
    return quiz.answer_rejects(b, "|".join(fx.UNITS)).select("id", F.array_join("rejects", ";").alias("rejects"))


@R.add("flt15_agent_test", f"WITH b AS (SELECT id, correct AS n, explanation || CASE id % 4 WHEN 0 THEN ' / ' WHEN 1 THEN '/' || correct ELSE '' END AS s FROM ({fx.BANK}) WHERE kind = 'role') SELECT id, NOT contains(s, n || 's') AND NOT contains(s, n || ' is') AND NOT contains(s, '/' || n) AND NOT contains(s, n || '/') AS agent FROM b")
def _(spark, sf):
    """A role with an ending of an object, or in a group by slashes, is not the one who acts."""
    tail = F.when(F.col("id") % 4 == 0, " / ").when(F.col("id") % 4 == 1, F.concat(F.lit("/"), "correct")).otherwise("")
    b = spark.sql(fx.BANK).where("kind = 'role'").withColumn("s", F.concat("explanation", tail))
    return b.select("id", quiz.is_agent(F.col("correct"), F.col("s"), ("s", " is")).alias("agent"))


@R.add("flt16_fingerprint_filter", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0 AND NOT (turn % 2 = 1 AND contains(text, 'a'))")
def _(spark, sf):
    """Approved rows whose text is no longer what was read are out: here every odd turn has since had its letters a replaced."""
    c = table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    then = F.when(F.col("turn") % 2 == 1, F.replace("text", F.lit("a"), F.lit("e"))).otherwise(F.col("text"))
    reviews = c.withColumn("text", then).select("id", F.when(F.col("conv_id") % 3 == 0, "draft").otherwise("approved").alias("status"), rules.fingerprint("role", "text").alias("fingerprint")).distinct()
    return quiz.approved(c, reviews, "id", ("role", "text")).select("conv_id", "turn")


@R.add("flt17_orphan_gate", "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|p)[ >]')) AS tag, unnest(range(1, len(regexp_extract_all(html, '<(?:h1|p)[ >]')) + 1)) AS k FROM pages), h AS (SELECT page_id, k, tag, min(CASE WHEN starts_with(tag, '<h1') AND page_id % 40 <> 1 THEN k END) OVER (PARTITION BY page_id) AS first FROM t) SELECT count(*) AS lines, count(*) FILTER (WHERE first IS NULL OR k < first) AS orphans, round(avg(CASE WHEN first IS NULL OR k < first THEN 1.0 ELSE 0.0 END), 9) AS share, avg(CASE WHEN first IS NULL OR k < first THEN 1.0 ELSE 0.0 END) <= 0.02 AS passes FROM h WHERE starts_with(tag, '<p')")
def _(spark, sf):
    """Paragraphs of pages with the headings above them; on every fortieth page the headings count as lost."""
    tags = F.regexp_extract_all("html", F.lit("<(?:h1|p)[ >]"), F.lit(0))
    b = table(spark, sf, "pages").select("page_id", F.posexplode(tags).alias("seq", "tag"))
    level = F.when(F.startswith("tag", F.lit("<h1")) & (F.col("page_id") % 40 != 1), 1)
    s = structure.heading_stack(b, "page_id", "seq", level, "tag", 1).where(F.startswith("tag", F.lit("<p")))
    return structure.orphan_share(s, "path").withColumn("share", F.round("share", 9))


@R.add("jn01_enrich_by_id", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@R.add("jn02_query_time_status", "SELECT o_orderkey, array_to_string(list_sort(list(k || '=' || coalesce(status, 'unknown'))), ';') AS statuses FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_suppkey, CAST(l_suppkey AS VARCHAR) AS k FROM lineitem) LEFT JOIN (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status FROM supplier WHERE s_nationkey < 13) ON l_suppkey = s_suppkey GROUP BY o_orderkey")
def _(spark, sf):
    """Status lives in its own table and is joined at query time; a key without a row is unknown."""
    status = table(spark, sf, "supplier").where("s_nationkey < 13").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") < 0, "suspended").otherwise("active").alias("status"))
    keys = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    one = F.concat_ws("=", F.col("l_suppkey").cast("string"), F.coalesce("status", F.lit("unknown")))
    return keys.join(status, "l_suppkey", "left").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("statuses"))


SH_SQL = """
WITH t AS (SELECT doc_id AS id, list_filter(string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' '), lambda x: x <> '') AS w
           FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g') AS text FROM documents)),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS sh FROM t),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY 1, 2),
j AS (SELECT a, b, inter, x.n AS na, y.n AS nb, inter / (x.n + y.n - inter) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b)
"""


REP_SQL = SH_SQL + """, c AS (SELECT id, min(id) OVER (PARTITION BY CASE WHEN w = [] THEN 'blank ' || id ELSE array_to_string(w, ' ') END) AS class_id FROM t),
z AS (SELECT class_id, count(*) AS size FROM c GROUP BY class_id), k AS (SELECT j.*, x.size AS size_a, y.size AS size_b FROM j JOIN z x ON x.class_id = a JOIN z y ON y.class_id = b WHERE jaccard >= 0.75)
"""


def near_classes(spark, sf, threshold=0.75):
    return dedup.near_classes(docs(spark, sf), "doc_id", threshold)


@R.add("jn03_shingle_jaccard_pairs", REP_SQL + "SELECT a, b, inter, na, nb, round(jaccard, 6) AS jaccard, size_a, size_b FROM k")
def _(spark, sf):
    """Pairs between the least chunks of each body; jn03_shingle_classes says who belongs to them."""
    return near_classes(spark, sf)[1].withColumn("jaccard", F.round("jaccard", 6))


@R.add("jn03_shingle_classes", REP_SQL + "SELECT c.id, class_id, coalesce(n, 0) AS links FROM c LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT a AS id FROM j WHERE jaccard >= 0.75 UNION ALL SELECT b FROM j WHERE jaccard >= 0.75) GROUP BY id) l ON l.id = c.id")
def _(spark, sf):
    """Every chunk with its class and the number of its links."""
    return dedup.twins(*near_classes(spark, sf))


FIG = "list_sort(list_distinct(regexp_extract_all({0}, '[0-9]+')))"


@R.add("jn04_divergent_pairs", REP_SQL + f", f AS (SELECT doc_id, {FIG.format('text')} AS nums FROM documents) SELECT a, b, array_to_string(list_filter(x.nums, lambda v: NOT list_contains(y.nums, v)), ';') AS only_a, array_to_string(list_filter(y.nums, lambda v: NOT list_contains(x.nums, v)), ';') AS only_b FROM k JOIN f x ON x.doc_id = a JOIN f y ON y.doc_id = b WHERE x.nums <> y.nums")
def _(spark, sf):
    nums = docs(spark, sf).select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).alias("nums"))
    p = near_classes(spark, sf)[1].select("a", "b")
    j = p.join(nums.select(F.col("doc_id").alias("a"), F.col("nums").alias("x")), "a").join(nums.select(F.col("doc_id").alias("b"), F.col("nums").alias("y")), "b")
    return j.where("x <> y").select("a", "b", F.array_join(F.array_except("x", "y"), ";").alias("only_a"), F.array_join(F.array_except("y", "x"), ";").alias("only_b"))


@R.add("jn05_pattern_scan", "SELECT k.key, count(*) AS n FROM documents d JOIN (VALUES " + ", ".join(f"('{k}', '{rx}')" for k, rx in PATTERNS) + ") k(key, rx) ON regexp_matches(lower(d.text), k.rx) GROUP BY k.key")
def _(spark, sf):
    tags = docs(spark, sf).select(F.explode(joins.pattern_tags(F.lower("text"), PATTERNS)).alias("key"))
    return tags.groupBy("key").agg(F.count("*").alias("n"))


@R.add("jn06_first_occurrence", "SELECT b.item_id, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def _(spark, sf):
    return joins.containment(docs(spark, sf), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text").where("first_exact is not null").select("item_id", F.col("first_exact").alias("first_doc"))


@R.add("jn07_gold_with_twins", "WITH g AS (SELECT md5(text) AS h, list(doc_id) AS m, count(*) FILTER (WHERE source = 'src0') AS n FROM documents GROUP BY 1) SELECT l.doc_id AS ref, len(g.m) AS twins, g.n > 0 AS in_context FROM labels l JOIN documents d USING (doc_id) JOIN g ON md5(d.text) = g.h WHERE quality = 1")
def _(spark, sf):
    """A reference is met by itself or by any declared twin that the context holds (here one source's)."""
    d = docs(spark, sf).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    g = d.groupBy("h").agg(F.count("*").cast("int").alias("twins"), (F.count_if(F.col("source") == "src0") > 0).alias("in_context"))
    return table(spark, sf, "labels").where("quality = 1").join(d, "doc_id").join(g, "h").select(F.col("doc_id").alias("ref"), "twins", "in_context")


BODY = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
VERSIONS_SQL = f"""
WITH o AS (SELECT doc_id AS id, md5(text) AS sha FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
n AS (SELECT doc_id AS id, md5({BODY}) AS sha FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
"""


def versions(spark, sf):
    """Two versions of the corpus: the stored texts less those of poor quality, and texts with single blanks less toxic ones."""
    d, lab = docs(spark, sf), table(spark, sf, "labels")
    sha = lambda t: F.md5(t.cast("binary"))
    old = d.join(lab.where("quality = 0"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), sha(F.col("text")).alias("sha"))
    new = d.join(lab.where("toxic = 1"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), sha(T.strip(F.regexp_replace("text", "\\s+", " "))).alias("sha"))
    return old, new


@R.add("jn08_manifest_drift", VERSIONS_SQL + "SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'orphan' WHEN o.id IS NULL THEN 'unknown' WHEN o.sha = n.sha THEN 'ok' ELSE 'drift' END AS state FROM o FULL JOIN n ON o.id = n.id")
def _(spark, sf):
    return joins.drift(*versions(spark, sf))


@R.add("jn09_cache_diff", VERSIONS_SQL + "SELECT state, count(*) AS n FROM (SELECT CASE WHEN n.id IS NULL THEN 'removed' WHEN o.id IS NULL THEN 'added' WHEN o.sha = n.sha THEN 'reused' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.id = n.id) GROUP BY state")
def _(spark, sf):
    return joins.cache_diff(*versions(spark, sf)).groupBy("state").agg(F.count("*").alias("n"))


@R.add("jn12_exact_or_children", "SELECT q.want, p.p_brand, count(*) AS n FROM (VALUES ('Brand#1'), ('Brand#11'), ('Brand#5')) q(want) JOIN part p ON p.p_brand = q.want OR (starts_with(p.p_brand, q.want) AND NOT EXISTS (SELECT 1 FROM part x WHERE x.p_brand = q.want)) GROUP BY 1, 2")
def _(spark, sf):
    want = spark.sql(values("want", ("Brand#1",), ("Brand#11",), ("Brand#5",)))
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    j = brands.join(F.broadcast(want), F.startswith("p_brand", "want"))
    w = Window.partitionBy("want")
    return j.withColumn("same", F.max((F.col("p_brand") == F.col("want")).cast("int")).over(w)).where((F.col("same") == 0) | (F.col("p_brand") == F.col("want"))).select("want", "p_brand", "n")


HEADINGS = "list_filter(list_transform(regexp_extract_all(html, '<(?:h1|p|title)[^>]*>([^<]*)', 1), lambda x: trim(x)), lambda x: x <> '')"


@R.add("jn13_near_miss", f"WITH p AS (SELECT page_id, split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS host, {HEADINGS} AS path FROM pages), g AS (SELECT DISTINCT page_id % 7 AS qid, split_part(path[1], ' ', 1) AS clause, regexp_extract(host, '^[a-z]+') AS family FROM p WHERE page_id % 25 = 0 AND len(path) > 0) SELECT DISTINCT g.qid, p.page_id FROM g JOIN p ON starts_with(p.host, g.family) AND len(list_filter(p.path, lambda x: starts_with(x, g.clause))) > 0")
def _(spark, sf):
    """Pages of the family with any heading that begins with a gold clause: near misses of a question."""
    found = F.regexp_extract_all("html", F.lit("<(?:h1|p|title)[^>]*>([^<]*)"), F.lit(1))
    path = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")
    host = F.split(F.replace(F.replace("url", F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), "/")[0]
    p = table(spark, sf, "pages").select("page_id", host.alias("host"), path.alias("path"))
    gold = p.where("page_id % 25 = 0 and size(path) > 0").select((F.col("page_id") % 7).alias("qid"), F.split(F.col("path")[0], " ")[0].alias("clause"), F.regexp_extract("host", "^[a-z]+", 0).alias("family")).distinct()
    return joins.near_miss(p, gold, "page_id", "host", "path")


@R.add("jn14_citation_orphans", "SELECT * FROM (VALUES (1, 'a §1.2', 'c1'), (1, 'z §9', NULL), (2, 'b §3.1', 'c2')) t(id, cite, chunk_id)")
def _(spark, sf):
    cites = spark.sql(values("id cite", (1, "a §1.2"), (1, "z §9"), (2, "b §3.1")))
    chunks = spark.sql(values("chunk_id label", ("c1", "A 1.2"), ("c2", "b 3")))
    a, b = T.norm_citation("cite"), T.norm_citation("label")
    return cites.join(F.broadcast(chunks), a.contains(b) | b.contains(a), "left").select("id", "cite", "chunk_id")


@R.add("jn15_nearest_question", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT * FROM embeddings), s AS (SELECT q.vec_id AS qid, p.vec_id AS id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM q, p WHERE q.vec_id <> p.vec_id) SELECT qid, arg_max(id, score) AS id, round(max(score), 6) AS score FROM s GROUP BY qid")
def _(spark, sf):
    """The query vectors are a stated set, searched against all others."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return joins.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), q)


@R.add("jn16_line_alignment", "SELECT * FROM (VALUES (1, 0, 1), (1, 1, 0), (2, 0, 0)) t(page, ref, hyp)")
def _(spark, sf):
    ref = spark.sql(values("page k line", (1, 0, "alpha beta gamma"), (1, 1, "second line here"), (1, 2, "nothing alike"), (2, 0, "one")))
    hyp = spark.sql(values("page k line", (1, 0, "second line hare"), (1, 1, "alpha bata gamma"), (2, 0, "one")))
    return joins.align_lines(ref, hyp, 0.72)


# every letter outside ASCII that these tables hold as a control character, since SQL's distance counts bytes
_LETTERS = "óéèñüöäßêíçÉÈÑÊÇÄÖÜÓÍ"
_AS_BYTES = f"translate({{0}}, '{_LETTERS}', concat(" + ", ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)]) + "))"
_LINES = "SELECT doc_id AS page, unnest(range(0, len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS line FROM documents"
_DAMAGE = "CASE k % 4 WHEN 0 THEN replace(line, 'en', 'n') WHEN 1 THEN substr(line, 6) WHEN 2 THEN line ELSE replace(replace(line, 'a', 'o'), ', ', ' ') END"
JN16_SQL = f"""WITH RECURSIVE l AS ({_LINES}), a AS (SELECT * FROM l WHERE length(line) >= 20), b AS (SELECT page, k + 1 - 2 * (k % 2) AS k, {_DAMAGE} AS line FROM l WHERE length({_DAMAGE}) >= 20),
pairs AS (
  SELECT a.page, a.k AS ref, b.k AS hyp, greatest(length(a.line), length(b.line)) AS n, CASE WHEN a.line = b.line THEN 0 ELSE levenshtein({_AS_BYTES.format("a.line")}, {_AS_BYTES.format("b.line")}) END AS d
  FROM a JOIN b ON a.page = b.page AND abs(length(a.line) - length(b.line)) <= 0.28 * greatest(length(a.line), length(b.line))),
alike AS (SELECT page, ref, hyp, round(1 - d / n, 9) AS ratio FROM pairs WHERE 1 - d / n >= 0.72 - 1e-12),
turns AS (SELECT page, ref, row_number() OVER (PARTITION BY page ORDER BY ref) AS i FROM (SELECT DISTINCT page, ref FROM alike)),
walk AS (
  SELECT page, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS ref, NULL::STRUCT(ratio DOUBLE, hyp BIGINT) AS m FROM (SELECT DISTINCT page FROM turns)
  UNION ALL SELECT page, i, CASE WHEN m IS NULL THEN used ELSE used || [-m.hyp] END, ref, m FROM (
    SELECT w.page, t.i, t.ref, w.used, max({{'ratio': c.ratio, 'hyp': -c.hyp}}) FILTER (NOT list_contains(w.used, c.hyp)) AS m
    FROM walk w JOIN turns t ON t.page = w.page AND t.i = w.i + 1 JOIN alike c ON c.page = t.page AND c.ref = t.ref GROUP BY ALL))
SELECT page, ref, -m.hyp AS hyp, m.ratio AS ratio FROM walk WHERE m IS NOT NULL"""


@R.add("jn16_alignment_in_order", JN16_SQL)
def _(spark, sf):
    """Lines of every document against a damaged copy in another order."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("k", F.col("k").cast("long"))
    k, line = F.col("k"), F.col("line")
    damage = F.when(k % 4 == 0, F.replace(line, F.lit("en"), F.lit("n"))).when(k % 4 == 1, F.substring(line, F.lit(6), F.length(line))).when(k % 4 == 2, line)
    damage = damage.otherwise(F.replace(F.replace(line, F.lit("a"), F.lit("o")), F.lit(", "), F.lit(" ")))
    return alignment.align_in_order(lines, lines.select("page", (k + 1 - 2 * (k % 2)).alias("k"), damage.alias("line")))


@R.add("jn17_reconcile", "SELECT CAST(p_partkey AS BIGINT) AS id, 'unused' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT DISTINCT l_partkey, 'unlisted' FROM lineitem WHERE l_quantity > 45 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def _(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).distinct()
    part = table(spark, sf, "part")
    listed, small = part.select(F.col("p_partkey").alias("id")), part.where("p_size < 25").select(F.col("p_partkey").alias("id"))
    return listed.join(used, "id", "left_anti").withColumn("side", F.lit("unused")).unionByName(used.join(small, "id", "left_anti").withColumn("side", F.lit("unlisted")))


@R.add("jn18_swallowed_by", "WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT p_name FROM part) SELECT a.w AS term, count(*) AS n FROM v a JOIN v b ON a.w <> b.w AND contains(b.w, a.w) GROUP BY a.w")
def _(spark, sf):
    """A term is swallowed by any longer one that contains it: longer terms give out the substrings that the vocabulary may hold."""
    names = table(spark, sf, "part").select("p_name").distinct()
    v = names.select(F.explode(F.split("p_name", " ")).alias("w")).union(names).distinct()
    return joins.swallowed(v, "w")


SECTIONS = "WITH c AS (SELECT p_partkey AS id, p_size % 5 || '.' || p_partkey % 4 || '.' || p_size AS clause, p_brand AS scope FROM part), p AS (SELECT s_suppkey AS product, s_nationkey % 5 || '.' || s_suppkey % 4 || '.1' AS clause, CASE WHEN s_suppkey % 3 = 0 THEN 'both' ELSE 'Brand#' || (s_suppkey % 5 + 1) END AS scope FROM supplier) "


@R.add("jn19_related_sections", SECTIONS + "SELECT id, product FROM c JOIN p ON split_part(c.clause, '.', 1) = split_part(p.clause, '.', 1) AND split_part(c.clause, '.', 2) = split_part(p.clause, '.', 2) WHERE p.scope = 'both' OR starts_with(c.scope, p.scope)")
def _(spark, sf):
    """Products whose first two clause numbers are the chunk's and whose scope covers it."""
    dotted = lambda *c: F.concat_ws(".", *(x.cast("string") for x in c))
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), dotted(F.col("p_size") % 5, F.col("p_partkey") % 4, F.col("p_size")).alias("clause"), F.col("p_brand").alias("scope"))
    n = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select(n.alias("product"), dotted(F.col("s_nationkey") % 5, n % 4, F.lit(1)).alias("clause"), F.when(n % 3 == 0, "both").otherwise(F.concat(F.lit("Brand#"), (n % 5 + 1).cast("string"))).alias("scope"))
    return joins.related(c, p).select("id", "product")


@R.add("jn20_twin_headings", "WITH d AS (SELECT doc_id, source, md5(text) AS g FROM documents), t AS (SELECT g, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources FROM d GROUP BY g HAVING count(*) > 1) SELECT d.doc_id, t.sources FROM d JOIN t USING (g)")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("g"))
    t = d.groupBy("g").agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(t, "g").select("doc_id", "sources")
