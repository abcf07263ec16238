"""Numbered headings and their signals; encoders and judges that fail in part."""

import numpy as np
from pyspark.sql import functions as F

from siltwork.operators import plugins as P
from siltwork.operators import spine as S


def test_levels(spark):
    rows = [("2.10 Scope", [2, 10]), ("২.৩) সীমা", [2, 3]), ("7. Fees", [7]), ("12", None), ("1 " + "x" * 100, None), ("see 2.1", None), (None, None), ("1." * 50_000 + " x", None), ("123456789 x", None)]
    got = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string").select("i", S.levels(F.col("s")).alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: w for i, (_, w) in enumerate(rows)}


def test_falls_and_signals(spark):
    said = ["1. One", "1.9 a", "1.10 b", "text", "2. Two", "2.1 c", "2. Two again", "1. Back", "3. Three", "1. More", "1. Most"]
    lines = spark.createDataFrame([("d", i // 4 + 1, i, t) for i, t in enumerate(said)] + [("e", 1, 0, "plain")], "doc string, page int, seq int, text string")
    assert sorted(r.text for r in S.headings(lines).where("falls").collect()) == ["1. Back", "1. More", "1. Most", "2. Two again"]
    got = {r.doc: r for r in S.signals(lines, "chapter").collect()}
    assert (got["d"].depth1, got["d"].resets, got["d"].repeated, got["d"].fails) == (7, 4, 6, ["resets", "per page"])
    assert (got["e"].headings, got["e"].fails) == (0, [])
    assert S.contents_pages(lines, least=3).count() == 3


def letters(texts):
    if any("bad" in t for t in texts):
        raise RuntimeError("no")
    return np.array([[t.count("a"), t.count("b")] for t in texts], float)


def test_one_bad_text_spoils_no_other(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aab", "bad", None, "", "bb"] * 20)], "i int, t string")
    got = {r.i: r for r in P.encode(df, "t", letters, batch=16).collect()}
    for i in range(100):
        r = got[i]
        if i % 5 == 1:
            assert r.embedding is None and r.embedding_failure == "RuntimeError: no"
        elif i % 5 == 2:
            assert r.embedding is None and r.embedding_failure is None
        else:
            assert np.allclose(r.embedding, {0: [2 / 5**0.5, 1 / 5**0.5], 3: [0, 0], 4: [0, 1]}[i % 5]) and r.embedding_failure is None
    short = P.judge(df.withColumn("f", F.lit("b")), "f", "t", lambda xs: [a in b for a, b in xs][: len(xs) - (len(xs) > 1)]).collect()
    assert {(r.t, r.holds) for r in short} == {("aab", True), ("bad", True), (None, None), ("", False), ("bb", True)}
    assert P.encode(df.where("false"), "t", letters).count() == 0
