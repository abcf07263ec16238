"""Text functions over Arrow against their namesakes in the JVM, and rankings that shuffle no pairs."""

import pytest
from pyspark.sql import functions as F

from siltwork.functions import scan
from siltwork.functions import text as T
from siltwork.operators import dedup, retrieval
from siltwork.queries import aggregates, text_functions, windows_topk

SF = "/root/testdata/sf0.001"
QUERIES = aggregates.QUERIES | text_functions.QUERIES | windows_topk.QUERIES
ODD = [
    None, "", " ", "\t\n\x0b\x0c\r a   b \n", "The 1,000 and 12,34,567.50 or 1,2 of", "১,০০০ টাকা ২.৫", "été বড়া ক৷ক‌ক", "KK straße ÄÖÜ ﬁ",
    "cÖ†‡ Av wK © vvvv vvv", "‘v’‰‱‗ \u007f\u0080ÿĀ", "\U0001f600 a,b 1,a a,1 ৯,৯", "\x1c\x1fa\x85b ", "v" * 5, "ঀ৿ॿ਀", "한 각",
]


def test_scans_give_what_the_jvm_gives(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, s string")
    for r in df.select("s", T.index_tokens("s").alias("toks"), T.norm_body("s").alias("body")).collect():
        assert scan.index_tokens(r.s or "") == r.toks, r.s
        assert scan.norm_body(r.s or "").decode() == r.body, r.s
    for r in df.select("s", T.legacy_paragraph_score("s", ("Av", "cÖ")).alias("a"), scan.legacy_paragraph_score(F.col("s"), ("Av", "cÖ")).alias("b"), F.length(T.norm_body("s")).alias("n"), scan.body_digest(F.col("s")).alias("x")).collect():
        assert r.a == r.b and r.n == r.x.n and (r.x.digest is None) == (r.n == 0), r.s


@pytest.mark.parametrize("name", ["top06_model_grid", "top04_filtered_top_k", "top03_hybrid", "top01_bm25"])
def test_no_row_is_a_pair_of_query_and_chunk(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan and "regexp_extract_all" not in plan.lower()


@pytest.mark.parametrize("name", ["str17_legacy_paragraph_score", "agg01_annotated", "agg04_document_frequency"])
def test_no_text_goes_through_patterns_of_the_jvm(spark, name):
    assert "regexp" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("often", [0.0, 2.0])
@pytest.mark.parametrize("limit", [0, 200_000])
def test_bm25_in_blocks_gives_what_the_join_gives(spark, monkeypatch, often, limit):
    """Cells one by one or as a matrix, kept terms or all, small steps, ids in several rows."""
    monkeypatch.setattr(retrieval, "OFTEN", often)
    monkeypatch.setattr(retrieval, "TERM_LIMIT", limit)
    monkeypatch.setattr(retrieval, "CELLS", 7)
    monkeypatch.setattr(retrieval, "CHUNK_STEP", 3)
    words = ["loan", "fee", "grace", "term", "rate"]
    docs = spark.createDataFrame([(i % 17, " ".join(words[j % 5] for j in range(i % 4, i % 9 + i % 3))) for i in range(40) if i not in (20, 37)], "id long, text string")
    terms = spark.createDataFrame([(1, "loan"), (1, "fee"), (2, "rate"), (3, "nowhere"), (4, "term"), (4, "grace"), (4, "loan")], "qid long, term string")
    post = retrieval.postings(docs, "id", F.col("text"))
    df = {r.term: r.df for r in retrieval.document_frequency(post).collect()}
    sizes = [len(r.text.split()) for r in docs.collect()]
    n, avg, want = len(sizes), sum(sizes) / len(sizes), {}
    for r in post.join(terms, "term").collect():
        idf = __import__("math").log(1 + (n - df[r.term] + 0.5) / (df[r.term] + 0.5))
        want[r.qid, r.id] = want.get((r.qid, r.id), 0) + idf * r.tf * 2.5 / (r.tf + 1.5 * (0.25 + 0.75 * r.dl / avg))
    best = {q: sorted(((-round(s, 9), i) for (p, i), s in want.items() if p == q))[:4] for q in {q for q, _ in want}}
    got: dict = {}
    for r in sorted(retrieval.bm25_top(docs, "id", F.col("text"), terms, 4).collect(), key=lambda r: (r.qid, r.rnk)):
        got.setdefault(r.qid, []).append((-round(r.score, 9), r.id))
    assert got == best


def test_copies_are_annotated_from_one_digest(spark):
    docs = spark.createDataFrame([(3, "a  b", "x"), (1, "a b ", "y"), (2, "", "x"), (4, None, "x"), (5, "c", "x")], "doc_id long, text string, source string")
    got = {r.id: (r.dup_group is not None, r.dup_primary, r.dup_size) for r in dedup.annotate(docs, F.col("doc_id"), "source", F.lit(0)).collect()}
    assert got == {1: (True, True, 2), 3: (True, False, 2), 2: (False, True, 1), 4: (False, True, 1), 5: (False, True, 1)}


def test_near_pairs_leave_no_shingles_in_the_shared_folder(spark):
    """Pairs of near copies as all-pairs finds them, with less written than the texts; copies and short texts included."""
    import random
    from pathlib import Path

    from pyspark.sql import functions as F

    from siltwork.operators import dedup

    rng, rows = random.Random(5), []
    for i in range(300):
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice((1, 2, 3, 40, 300)))]
        for k in range(rng.choice((1, 1, 2, 3))):
            rows.append((len(rows), " ".join(w if rng.random() > 0.02 * k else "x" for w in words)))
    rows += [(len(rows), None), (len(rows) + 1, " ")]
    sets = {}
    for i, s in rows:
        w = (s or "").split()
        sets[i] = set(zip(w, w[1:], w[2:])) if len(w) >= 3 else set(w)
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "id long, text string")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: sum(f.stat().st_size for f in shared.rglob("*.parquet"))
    before = held()
    assert {(r.a, r.b) for r in dedup.near_texts(df, df.select("id"), 0.75).collect()} == want and len(want) > 100
    assert held() - before < sum(len(s or "") for _, s in rows) / 4
    before = held()
    members, pairs = dedup.near_classes(df.where(F.col("id") < 200), "id", 0.75)
    assert pairs.count() > 10 and held() - before < sum(len(s or "") for i, s in rows if i < 200) / 2
