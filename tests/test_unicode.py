"""Canonical composition against Python's own, over every script, and long runs through every pattern with repetition."""

import random
import re
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.functions import unicode as N
from siltwork.operators import retrieval


def test_nfc_of_any_script(spark):
    apart, classes, pairs, no, _ = N._tables()
    rng = random.Random(5)
    pool = [*list(apart)[::7], *list(classes)[::9], *(x for p in list(pairs)[::11] for x in p), *"abceinou ক\n각가각ᄒ", *(chr(c) for c in sorted(no)[::9])]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(600)] + [(i + 600, "".join(rng.choice("aẹ̣́̂oো়ড়각ᆨᅡ") for _ in range(rng.randrange(9)))) for i in range(600)]
    got = {r.i: r.o for r in spark.createDataFrame([*rows, (-1, None), (-2, "")], "i int, s string").select("i", N.nfc(F.col("s")).alias("o")).collect()}
    assert got[-1] is None and got[-2] == ""
    assert [(i, s) for i, s in rows if got[i] != unicodedata.normalize("NFC", s)] == []


def test_every_character_that_changes(spark):
    apart, *_ = N._tables()
    rows = [(c, c + "x") for c in apart]
    got = spark.createDataFrame(rows, "c string, s string").select("s", N.nfc(F.col("s")).alias("o")).collect()
    assert [r.s for r in got if r.o != unicodedata.normalize("NFC", r.s)] == []


@pytest.mark.parametrize("unit", ["1,", "1.", "ab-", "a", "é", "১.২", "a/b_"])
def test_long_runs_do_not_overflow(spark, unit):
    df = spark.createDataFrame([(1, "x " + unit * 1_000_000 + " y")], "id int, s string")
    r = df.select(F.size(T.tokenize("s")).alias("n"), F.length(T.clause("s")).alias("c"), F.length(T.clause_display("s")).alias("d"), F.length(T.canon("s")).alias("e"), T.has_loop("s").alias("l")).first()
    assert r.n >= 1
    assert retrieval.postings(df, "id", F.col("s")).count() >= 1


def test_no_pattern_of_the_library_repeats_a_group_by_recursion():
    """A group repeated without a bound and not possessively: `)*`, `)+`, `){2,}` at the end of a JVM pattern's group."""
    root = Path(T.__file__).parents[1]
    found = []
    for p in [*root.glob("functions/*.py"), *root.glob("operators/*.py")]:
        for n, line in enumerate(p.read_text().splitlines(), 1):
            found += [f"{p.name}:{n}" for m in re.finditer(r"\(\?:[^()\"]*\)(?:[*+]|\{\d+,\})(?![+?])", line)]
    assert found == []
