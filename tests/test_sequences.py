"""Subsequences against the plain table, matching blocks against the standard library's matcher."""

import random
from difflib import SequenceMatcher, get_close_matches

from pyspark.sql import functions as F

from siltwork.functions import sequences as S


def pairs():
    rng = random.Random(8)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    out = [(say("abc", 14), say("abc", 14)) for _ in range(150)] + [(say("aé😀 ", 90), say("aé😀 ", 90)) for _ in range(20)] + [(say("abcdefgh ", 150), say("abcdefgh ", 150)) for _ in range(10)]
    return [*out, ("", ""), ("", "a"), ("a", ""), ("x" * 200, "x" * 190), ("ab" * 62, "ba" * 62)]


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_subsequences_and_blocks(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs())]
    df = spark.createDataFrame([*rows, (-1, None, "a")], "i int, a string, b string")
    got = {r.i: r for r in df.select("i", S.lcs_length(F.col("a"), F.col("b")).alias("lcs"), S.matching_blocks(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got[-1].lcs is None and got[-1].m is None
    for i, a, b in rows:
        assert got[i].lcs == table(a, b), (a, b)
        want = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]
        assert [tuple(x) for x in got[i].m] == [tuple(x) for x in want], (a, b)


def test_closest_line(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(12)), ["".join(rng.choice("abcdxyz ") for _ in range(rng.randrange(1, 15))) for _ in range(6)]) for i in range(60)]
    rows += [(100, "abc", ["xyz", "  ", ""]), (101, "abc", [])]
    got = {r.i: r.k for r in spark.createDataFrame(rows, "i int, s string, lines array<string>").select("i", S.closest(F.col("s"), F.col("lines")).alias("k")).collect()}
    for i, s, lines in rows:
        want = get_close_matches(s, [x for x in lines if x.strip()], n=1, cutoff=0.3)
        assert (got[i].line if got[i] else None) == (want[0] if want else None)
