"""Greedy spacing against one pass over sorted marks."""

import random

from siltwork.operators import spacing as S


def greedy(ps, gap):
    out = []
    for p in sorted(set(ps)):
        if not out or p - out[-1] > gap:
            out.append(p)
    return out


def test_spacing_against_one_pass(spark, monkeypatch):
    rng = random.Random(2)
    docs = {d: [rng.randrange(60) if d % 2 else 5 * rng.randrange(3000) for _ in range(rng.choice((1, 3, 40)))] for d in range(30)} | {99: list(range(300))}
    rows = [(d, p) for d, ps in docs.items() for p in ps]
    for piece, gap in ((4096, 2), (8, 2), (8, 20), (4096, 0)):
        monkeypatch.setattr(S, "PIECE", piece)
        got = {}
        for r in S.spaced(spark.createDataFrame(rows, "d int, p int"), "d", "p", gap).collect():
            got.setdefault(r.d, []).append(r.p)
        assert {d: sorted(ps) for d, ps in got.items()} == {d: greedy(ps, gap) for d, ps in docs.items()}
    assert S.spaced(spark.createDataFrame([], "d int, p int"), "d", "p", 2).count() == 0


def test_numbers_within_groups(spark):
    from siltwork.operators import structure

    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(40)])) for _ in range(500)]
    got = structure.numbered(spark.createDataFrame(rows, "g string, o int").repartition(5), "g", ["o"], "n").collect()
    for g in ("hot", "a", None):
        mine = sorted((r.n, r.o) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [o for _, o in mine] == sorted((o for x, o in rows if x == g), key=lambda o: (o is not None, o or 0))
    assert len(got) == 500
