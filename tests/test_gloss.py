"""Gloss expansion against going through the words one by one."""

import random
import re

from pyspark.sql import functions as F

from siltwork.operators import gloss as G


def plain(text, table, endings):
    ws = [w.lower() for w in re.findall(r"[^\s.,;:!?()\"]+", text or "")]
    used, out = [False] * len(ws), []
    for n in (4, 3, 2, 1):
        for i in range(len(ws) - n + 1):
            p = " ".join(ws[i : i + n])
            if not any(used[i : i + n]) and p in table:
                out.append(table[p])
                used[i : i + n] = [True] * n
    for i, w in enumerate(ws):
        if not used[i]:
            for e in endings:
                if len(w) > len(e) + 1 and w.endswith(e) and w[: -len(e)] in table:
                    out.append(table[w[: -len(e)]])
                    break
    return " ".join([text or ""] + out) if out else text


def test_gloss_against_plain(spark):
    rng, ends = random.Random(4), ("tir", "er", "r", "e")
    vocabulary = ["goti", "loan", "loaner", "big", "bige", "tirer", "ab", "aber", "x", "xr"]
    phrases = {" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5))) for _ in range(60)}
    table = {p: f"<{p}>" for p in phrases}
    rows = [(i, " ".join(rng.choice(vocabulary).title() for _ in range(rng.randrange(0, 14))) + rng.choice(["", "?", " ?"])) for i in range(250)] + [(999, None), (1000, "")]
    t = spark.createDataFrame([*table.items(), ("ab", "zz")], "phrase string, gloss string")
    got = {r.i: r.expanded for r in G.expand(spark.createDataFrame(rows, "i int, s string"), "i", "s", t, ends).collect()}
    for i, s in rows:
        assert (got[i] or "") == (plain(s, table, ends) or ""), s
    assert G.glosses(spark.createDataFrame(rows, "i int, s string"), "i", F.col("s"), t.where("false"), ends).count() == 0


def test_only_runs_of_the_table_are_written(spark):
    """What leaves a task are the runs that the table may hold, and a long text's hits are gone through once each."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(400)) + " big loan") for i in range(40)] + [(40, "big loan, " * 20_000)]
    texts = spark.createDataFrame(rows, "i int, s string")
    t = spark.createDataFrame([("big loan", "<1>"), ("loan", "<2>")], "phrase string, gloss string")
    said = G.phrases_said(texts.where("i < 40"), "i", [G.words(F.col("s"))], t, ("s",))
    assert sorted((r.phrase, r.rank, r.at, r.n) for r in said.collect()) == [("big loan", -2, 401, 2)] * 40 + [("loan", -1, 402, 1)] * 40
    assert "Generate explode" not in said._jdf.queryExecution().toString()
    got = {r.i: r.n_glosses for r in G.expand(texts, "i", "s", t, ()).collect()}
    assert got[40] == 20_000 and got[3] == 1
