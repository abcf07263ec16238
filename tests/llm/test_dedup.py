"""Exact and near duplicates against brute force, Grace recursion, and the odd cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from siltwork.llm import exact_dedup as X
from siltwork.llm import minhash_dedup as M
from siltwork.llm.common import shingle_sets, word_hashes
from siltwork.llm.components import components

from . import fixtures as fx


def brute_exact(rows):
    g = defaultdict(list)
    for i, t in rows:
        g[fx.fold(t)].append(i)
    out = []
    for i, t in rows:
        ids = g[fx.fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(fx.fold(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups_of_the_table(spark):
    rows = fx.texts(spark)
    got = X.exact_dedup(fx.table(spark, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(rows)


@pytest.mark.parametrize("limit", [1, 1 << 12, 32 << 20])
def test_exact_odd_cases_with_any_table_size(spark, limit):
    got = X.exact_dedup(fx.odd_docs(spark), table_bytes=limit).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(fx.odd_rows())
    assert X.exact_dedup(fx.no_docs(spark)).count() == 0


def test_grace_recursion_compares_whole_contents():
    """All digests alike in their first bits: buckets must be split again and again, and contents told apart."""
    random.seed(1)
    grace, want = X.GraceDedup(limit=5000), defaultdict(list)
    for i in range(3000):
        content = f"text {random.randrange(700)}".encode()
        digest = b"\x00\x00" + hashlib.sha256(content).digest()[2:]
        grace.add(digest, content, i, 1)
        want[content].append(i)
    got = {c: (best, n) for _, c, best, n in grace.groups()}
    assert got == {c: (max(v), len(v)) for c, v in want.items()}
    assert grace.dir is None


def test_colliding_digests_are_told_apart():
    grace = X.GraceDedup()
    grace.add(b"\x01" * 32, b"one", 1, 1)
    grace.add(b"\x01" * 32, b"two", 2, 1)
    assert sorted(r[1] for r in grace.groups()) == [b"one", b"two"]


def test_word_hashes_follow_the_contract():
    texts = ["Alpha beta\x0bGAMMA", "", "  ", "a\x1cb É", "x " * 50, "one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, at = word_hashes(data, offs)
    assert [b - a for a, b in zip(at[:-1], at[1:])] == [len(fx.words(t)) for t in texts]
    assert [len(s) for s in shingle_sets(h, at, 2)] == [len(fx.shingle_set(t, 2)) for t in texts]


@pytest.mark.parametrize("k", [2, 5])
def test_near_components_of_the_table(spark, k):
    rows = fx.texts(spark)
    links, want = fx.components(rows, k, 80)
    got = M.near_components(fx.table(spark, "documents"), k=k).collect()
    assert links > 0
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(fx.shingle_set(t, k)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_of_near_copies_lose_no_link(spark):
    """Families of copies with edits of their own, many of them near 0.8, so that stars alone would miss links."""
    rng, rows = random.Random(5), []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(60)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(4000)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    links, want = fx.components(rows, 2, 80)
    got = M.near_components(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert links > 50
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_odd_cases(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in M.near_components(fx.odd_docs(spark), k=2).collect()}
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (None, 3, None) in got
    assert (5, 4, 4) in got and (7, 1, 7) in got
    assert M.near_components(fx.odd_docs(spark), k=2).count() == len(fx.odd_rows())
    assert M.near_components(fx.no_docs(spark)).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 203


def test_components_walk_leads_only(spark, monkeypatch):
    """Five hundred nodes under eight leads each: what is walked in rounds is links between leads, a link a member before."""
    from siltwork.llm import components as C

    rng, walked, plain = random.Random(9), [], C.passed
    pairs = [(a, b) for b in range(100, 600) for a in rng.sample(range(20), 8)] + [(650, 600), (650, 700), (700, 599), (800, 900), (5, 5), (950, 950)]
    own = {n: n for p in pairs for n in p}
    for _ in own:
        for a, b in pairs:
            own[a] = own[b] = min(own[a], own[b])
    monkeypatch.setattr(C, "passed", lambda links: walked.append(links.count()) or plain(links))
    got = C.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in got) == sorted(own.items())
    assert walked[0] < 300 < len(pairs)


def test_links_inside_a_star_grow_in_proportion(spark, monkeypatch):
    """One hot group of near copies, many of which its smallest member doesn't link: links are never listed by pairs."""
    rng, rows, counts = random.Random(3), [], []
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    for i in range(480):
        w = list(base)
        for _ in range(rng.randrange(2, 30)):
            w[rng.randrange(400)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    whole = M.components
    monkeypatch.setattr(M, "components", lambda links: counts.append(links.count()) or whole(links))
    most = []
    for n in (240, 480):
        counts.clear()
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in M.near_components(docs, k=2).collect()}
        assert got == fx.components(rows[:n], 2, 80)[1]
        most.append(max(counts))
    pairs = fx.components(rows, 2, 80)[0]
    assert most[1] < 3 * most[0] and most[1] < pairs / 4


def test_a_digest_of_two_contents_stops_the_job():
    for limit in (1, 1 << 20):
        grace = X.GraceDedup(limit, unique=True)
        for i, text in enumerate((b"one", b"two", b"three")):
            grace.add((b"\x02" if i == 2 else b"\x01") * 32, text, i, 1)
        with pytest.raises(RuntimeError):
            list(grace.groups())
