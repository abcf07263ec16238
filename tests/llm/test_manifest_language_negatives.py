"""Merkle proofs, language filters and hard negatives against plain forms."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltwork.llm import hard_negatives as H
from siltwork.llm import language_id as L
from siltwork.llm import merkle_manifest as M

from . import fixtures as fx


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(top, for each leaf its (left, right) siblings from below)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level, at = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0] if level else None, paths


def manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> the contract's rows, by plain loops."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], sha(*map(said, r)), r))
    subs, out = {}, []
    for lang, leaves in groups.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[lang] = (leaves, *tree([x[1] for x in leaves]))
    order = sorted(subs, key=lambda k: (k is not None, (k or "").encode()))
    root, above = tree([subs[k][1] for k in order])
    for k, up in zip(order, above):
        leaves, top, paths = subs[k]
        for (i, digest, r), path in zip(leaves, paths):
            node = digest
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                node = sha(*map(said, (*r[:4], fx.fold(r[4]) if r[4] is not None else None)))
            for a, b in path + up:
                node = sha(a, node, b)
            out.append((i, digest, top, root, sha("".join(a + b for a, b in path + up)), node, node == root))
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [{"en": 1}, {None: 3}, {"en": 8, "de": 9}, {"en": 64, "fr": 65, None: 1, "é": 7, "z": 2}, {f"l{k}": k % 3 + 1 for k in range(70)}, {"en": 600, "de": 513}])
def test_manifest_against_plain_trees(spark, sizes):
    rng = random.Random(4)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            i = rng.choice([None, rng.randrange(300), rng.randrange(300)])
            rows.append((i, rng.choice(["s", None, ""]), lang, rng.choice([None, 5]), rng.choice([None, "", "Ab É", "plain", "UPPER " * rng.randrange(3)])))
    rows += rows[: len(rows) // 3]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 as pos", "'x' as digest", "2 as tree", "'y' as leaf", "3 as n")
    assert sorted(map(tuple, M.merkle_manifest(df).collect()), key=repr) == sorted(manifest(rows), key=repr)


def test_manifest_of_odd_rows(spark):
    odd = fx.odd_docs(spark).selectExpr("*", "cast(null as string) as source", "'en' as lang", "cast(length(text) as long) as n_chars")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert sorted(map(tuple, M.merkle_manifest(odd).collect()), key=repr) == sorted(manifest(rows), key=repr)
    assert M.merkle_manifest(odd.where("false")).count() == 0


def test_a_forged_leaf_or_proof_does_not_fold_to_the_root(spark):
    rows = [(i, "s", "en" if i % 2 else "de", 3, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, FIELDS).withColumn("leaf", M.leaf([F.col(c) for c in M.FIELDS]))
    got = M.merkle_proofs(docs, "lang", "doc_id", "leaf")
    forged = got.select("root", M.fold(F.col("leaf"), F.col("path")).alias("own"), M.fold(F.sha2(F.col("leaf"), 256), F.col("path")).alias("leaf"), M.fold(F.col("leaf"), F.reverse("path")).alias("path"))
    assert forged.where("own = root and leaf <> root and path <> root").count() == 200


def test_language_held_out_accuracy(spark):
    """Held-out rows at two sizes; labels of held-out rows don't matter."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.language_id(docs).collect()}
    held = [r for r in docs.collect() if fx.held(r.doc_id, 5)]
    assert len(got) == docs.count() and all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    small = fx.table(spark, "documents")
    other = small.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'xx', lang) as lang", "'q' as word", "1 as count")
    a, b = (sorted(map(tuple, L.language_id(x).collect())) for x in (small, other))
    assert a == b and not any(r[2] == "xx" for r in a)


def plain_grams(text):
    """(n-gram, size) of every word of letters and marks between two marks of its own."""
    out, word = [], ""
    for c in (text or "") + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            w = "\0" + word + "\0"
            out += [w[i : i + n] for n in L.ORDERS for i in range(len(w) - n + 1) if n > 1 or w[i] != "\0"]
            word = ""
    return out


def test_languages_against_exact_sets(spark):
    """Without false positives the corrected shares are those of plain sets of n-grams."""
    rng = random.Random(3)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 25)))
    kinds = {"a": "abcdeé", "b": "bcdefß", "c": "xyzক্ষি"}
    rows = [(i, say(kinds[k]), k) for i in range(240) for k in [rng.choice("abc")]]
    sets, counts = {}, {}
    for i, t, k in rows:
        if not fx.held(i, 5):
            for g in plain_grams(t):
                counts[k, len(g), g] = counts.get((k, len(g), g), 0) + 1
    totals = {}
    for (k, n, _), c in counts.items():
        totals[k, n] = totals.get((k, n), 0) + c
    for (k, n, g), c in counts.items():
        if c >= L.RATE * totals[k, n]:
            sets.setdefault(k, set()).add(g)
    rows += [(1000, None, "a"), (1001, "", None), (1002, "12 ...", "b"), (1003, "ééé abc", None), (None, "xyz xyz", "q")]
    got = {r.doc_id: r for r in L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        gs = plain_grams(t)
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        shares = {k: sum(g in s for g in gs) / len(gs) for k, s in sets.items()}
        assert shares[got[i].lang_pred] >= max(shares.values()) - 0.01
        assert abs(got[i].score - shares[got[i].lang_pred]) < 0.01
    assert got[None].held_out is None


def test_language_odd_rows(spark):
    odd = fx.odd_docs(spark).selectExpr("*", "if(doc_id % 2 = 0, 'x', null) as lang")
    assert L.language_id(odd).count() == len(fx.odd_rows())
    assert L.language_id(odd.where("false")).count() == 0
    assert {r.lang_pred for r in L.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_filters_return_all_languages():
    """Every n-gram put in is found, whatever the number of languages."""
    rng, found = np.random.default_rng(1), []
    import pandas as pd

    sets = [rng.integers(0, 1 << 60, 300) for _ in range(70)]
    for k, s in enumerate(sets):
        r = L._filter(pd.DataFrame({"lang": [f"l{k:02}"] * len(s), "gram": s})).iloc[0]
        found.append((r["lang"], r["bits"]))
    f = L.Filters(found)
    for k, s in enumerate(sets):
        at = L.places(s.view(np.uint64))
        mask = np.logical_and.reduce([(f.masks[k // f.width][p] >> f.masks.dtype.type(k % f.width)) & f.masks.dtype.type(1) for p in at])
        assert mask.all()


def plain_negatives(rows):
    take = []
    for i, v, k in rows:
        if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            take.append((i, (k + 1) % 10 if i % 7 == 0 else k, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for i, k, v in take:
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in take]
        for p, j, _ in sorted(x for x in scored if x[2] == k and x[1] != i)[:5]:
            window = sorted(x for x in scored if x[2] != k and 80 * -p <= 100 * -x[0] <= 100 * -p)[:5]
            out += [(i, j, n, x[1], -p, -x[0]) for n, x in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_negatives_against_plain_search(spark, seed):
    """Ties, repeated ids and rows, nulls, infinities, unequal lengths, scores below zero."""
    rng = random.Random(seed)
    one = lambda: rng.choice([None] * 1 + [float("nan"), float("inf")] + [round(rng.uniform(-1, 1), 1) for _ in range(120)])
    rows = [(rng.choice([None, rng.randrange(400), 100 * rng.randrange(4)]), rng.choice([None, *[[one() for _ in range(rng.choice((3, 3, 3, 2, 0)))] for _ in range(20)]]), rng.choice([None, *range(4)] if seed % 2 else [0, 1])) for _ in range(300)]
    rows += rows[:60]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as at", "2 as part", "'x' as ids")
    want = plain_negatives(rows)
    assert want and sorted(map(tuple, H.hard_negatives(df).collect())) == want
    assert sorted(map(tuple, H.hard_negatives(df, block=40).collect())) == want


def test_negatives_of_large_components_are_exact(spark):
    """Products beyond 2^53 go by whole numbers."""
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.uniform(1, 2) * 2**20)) for _ in range(3)], i % 2) for i in [0, 100, *range(1, 60)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, H.hard_negatives(df).collect())) == plain_negatives(rows)
    assert H.hard_negatives(df.where("false")).count() == 0
    assert H.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0
