"""Toxicity by held-out accuracy, secrets against a brute-force scan, decontamination by planted passages."""

import hashlib
import random
import re

import pytest

from siltwork.llm import decontamination as D
from siltwork.llm import secrets as S
from siltwork.llm import toxicity as T

from . import fixtures as fx


def test_held_out_accuracy(spark):
    """On a table large enough to learn every language's terms."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if fx.held(r.doc_id, 5)]
    assert all(r.held_out for r, _ in held)
    assert sum(r.predicted == y for r, y in held) / len(held) >= 0.95
    assert sum(r.predicted == 1 for r, y in held if y == 1) >= 0.8 * sum(y for _, y in held)
    assert len(got) == docs.count()


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = fx.table(spark, "documents"), fx.table(spark, "labels")
    flipped = labels.withColumn("toxic", (1 - labels.toxic)).where("false").unionByName(labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic"))
    a, b = (sorted((r.doc_id, r.score) for r in T.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_automaton_against_edit_distance():
    def osa(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return min(d[len(a), j] for j in range(len(b) + 1))

    stems, rng = ["idiot", "worthless", "scum", "pathetic"], random.Random(3)
    trie = T.Trie(stems)
    for _ in range(3000):
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice("abcdiot")], [w[k], rng.choice("xyz")], w[k : k + 2][::-1]])
        w = "".join(w)
        best = min((osa(s, w), -len(s), s) for s in stems if osa(s, w) <= T.Trie.allowed(s)) if any(osa(s, w) <= T.Trie.allowed(s) for s in stems) else None
        got = trie.match(w)
        assert (got and got[1]) == (best and best[0]), w


def test_misspelling_counts_and_quotation_counts_less():
    rows = [(f"you{i} idiot are{i} and a{i} moron in{i}", 1) for i in range(60)] + [(f"plain words of text number {i} go here", 0) for i in range(300)]
    s = T.Scorer(T.learn(rows, 0.15))
    assert s.score("what an idiot he is")[0] > 0.5
    assert s.score("what an idoit he is")[0] > 0.5
    assert s.score('the word "idiot" is rude')[0] < s.score("the word idiot is rude")[0]
    assert s.score("plain words")[0] < 0.5 and s.score("")[0] < 0.5


def test_toxicity_odd_cases(spark):
    labels = fx.table(spark, "labels").limit(0)
    got = T.toxicity(fx.odd_docs(spark), labels).collect()
    assert len(got) == len(fx.odd_rows()) and len({r.score for r in got}) == 1
    assert T.toxicity(fx.no_docs(spark), fx.table(spark, "labels")).count() == 0
    assert T.drop_toxic(fx.odd_docs(spark), labels).columns == fx.odd_docs(spark).columns


KINDS = (("assign", re.compile(S.KINDS[0][1].replace("(?i)", ""), re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def brute_secrets(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, rx, g, n) in enumerate(KINDS) for m in rx.finditer(text or "") if len(m[g]) >= n]
    said = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(spans))
    return [sum(s[3] == k[0] for s in spans) for k in KINDS], hashlib.sha256(said.encode()).hexdigest(), said


def test_secrets_of_the_table(spark):
    rows = fx.texts(spark)
    got = {r.doc_id: r for r in S.secret_scan(fx.table(spark, "documents")).collect()}
    for i, t in rows:
        n, sha, said = brute_secrets(t)
        r = got[i]
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (n, sha)
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


TRICKY = [
    (1, "password==abc secret:token:abcdefgh"), (2, "é😀 token = 'abcdef' API_KEY:\"x/y+z=0\" apikey=12345"), (3, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA0"), (4, "deadbeef" * 3 + "DEADBEEF" * 3 + " " + "a" * 23), (5, None), (6, ""),
    (7, "PASSWORD : hunter22 passwd=short"), (8, "tokentoken=abcdef1 secret=" + "0123456789abcdef" * 3),
]


def test_secrets_tricky_cases(spark):
    got = {r.doc_id: r for r in S.secret_scan(spark.createDataFrame(TRICKY, "doc_id long, text string")).collect()}
    for i, t in TRICKY:
        n, sha, _ = brute_secrets(t)
        assert ([got[i].n_assign, got[i].n_access, got[i].n_hex], got[i].base_sha256) == (n, sha), i
    assert S.secret_scan(fx.odd_docs(spark)).count() == len(fx.odd_rows())
    assert S.secret_scan(fx.no_docs(spark)).count() == 0


def test_secrets_of_long_runs_and_many_spans(spark):
    """A run of any length overflows nothing, and the work doesn't grow with the square of a text's spans."""
    rng = random.Random(5)
    rows = [(1, "ab-" * 300_000 + "x"), (2, "1," * 300_000), (3, "a" * 400_000), (4, " ".join(f"{rng.getrandbits(128):032x}" for _ in range(6000))), (5, "password=" + "ab/" * 100_000), (6, "token: abcdef12 " * 8000)]
    got = {r.doc_id: r for r in S.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        n, sha, _ = brute_secrets(t)
        assert ([got[i].n_assign, got[i].n_access, got[i].n_hex], got[i].base_sha256) == (n, sha), i


def test_added_spans_meet_no_base_span(spark):
    """Against a plain look at every pair of spans."""
    rng, signs = random.Random(12), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = []
    for i in range(120):
        parts = [rng.choice(["token=", "secret: ", "", "AKIA", "key "]) + "".join(rng.choice(rng.choice([signs, "0123456789abcdef", signs[:26]])) for _ in range(rng.choice((22, 30, 44)))) for _ in range(rng.randrange(1, 5))]
        rows.append((i, " and ".join(parts)))
    got = {r.doc_id: r for r in S.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = 0
    for i, t in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in filter(None, got[i].spans.split(",")))]
        base, new = [x for x in spans if x[0] != "random"], [x for x in spans if x[0] == "random"]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in base) == brute_secrets(t)[2]
        assert not any(a < y[2] and y[1] < b for n, (_, a, b) in enumerate(new) for y in base + new[:n])
        added += len(new)
    assert added > 40


def test_battery_finds_random_strings_and_leaves_words(spark):
    rng = random.Random(7)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, f"key material {''.join(rng.choice(b64) for _ in range(40))} follows") for i in range(50)]
    rows += [(100 + i, "internationalisationandlocalisation antidisestablishmentarianism " + "a" * 30 + " 2024010120240102202401032024") for i in range(50)]
    got = {r.doc_id: r.n_random for r in S.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(50)) >= 47
    assert sum(got[100 + i] for i in range(50)) == 0


def test_benchmark_passages_of_the_table(spark):
    docs, items = fx.texts(spark), [(r.item_id, r.text) for r in fx.table(spark, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(fx.table(spark, "documents"), fx.table(spark, "benchmark")).collect()}
    exact = {(i, k) for i, t in docs for k, s in items if D.normal(s) in D.normal(t)}
    assert exact and exact <= got


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_verification_is_exact():
    rng = random.Random(2)
    for _ in range(60):
        item, text = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (20, 60))
        got = D.edits_inside(D.codes(item), D.codes(text), 8)
        want = brute_edits(item, text)
        assert (got[0] if got else None) == (want if want <= 8 else None)


@pytest.mark.parametrize(("share", "least"), [(0.05, 1.0), (0.1, 0.98), (0.18, 0.9)])
def test_edited_passages_are_found(spark, share, least):
    rng, items = random.Random(4), [(r.item_id, r.text) for r in fx.table(spark, "benchmark").collect()]
    index, found = D.Index(items, D.EDIT_SHARE), 0
    for k, s in items:
        y = list(D.normal(s))
        for _ in range(int(share * len(y))):
            q = rng.randrange(len(y))
            y[q : q + 1] = rng.choice([[], [rng.choice("abcdefgh ")], [y[q], rng.choice("abcdefgh ")]])
        found += any(hit[1] == k for hit in index.find(["some other words before " + "".join(y) + " and words after"]))
    assert found >= least * len(items)
    assert index.find(["plain prose with nothing of the kind in it at all, as long as may be wanted " * 20]) == []


def test_decontamination_odd_cases(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, "  "), (None, "lorem ipsum dolor"), (5, "single"), (1, "alpha beta gamma delta")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(fx.odd_docs(spark), items).collect()}
    assert {(4, 1), (5, 1), (6, None), (7, 5)} <= got and not any(i in (1, 2, 3) for i, _ in got)
    assert D.contaminated(fx.no_docs(spark), items).count() == 0
    assert {tuple(r) for r in D.contaminated(fx.odd_docs(spark), items, block_items=1).collect()} == {tuple(r) for r in D.contaminated(fx.odd_docs(spark), items).collect()}


def test_no_passage_within_the_edits_is_passed_over():
    """Items of any length against the exact distance: short ones, edits at every tenth character, and edits up to the limit and beyond."""
    rng, letters = random.Random(7), "abcdefghij "
    for _ in range(12):
        items = [(k, "".join(rng.choice(letters) for _ in range(n)).strip() or "x") for k, n in enumerate([3, 9, 10, 11, 12, 15, 20, 20, 33, 60, 110, 150])]
        index, texts = D.Index(items, D.EDIT_SHARE), [lead + D.normal(s) + "tail" for _, s in items for lead in ("", "lead")]
        for _, s in items:
            y = list(D.normal(s))
            texts.append("".join("#" if q % 10 == 9 else c for q, c in enumerate(y)))
            texts.append("".join("#" if q == len(y) // 2 else c for q, c in enumerate(y)))
            for more in (0, 0, 1):
                z = list(y)
                for _ in range(len(z) // 5 + more):
                    q = rng.randrange(len(z) or 1)
                    z[q : q + 1] = rng.choice([[], [rng.choice(letters)], [*z[q : q + 1], rng.choice(letters)]])
                texts.append("some " + "".join(z) + " more")
        want = {}
        for i, t in enumerate(texts):
            for k, s in items:
                x = D.codes(D.normal(s))
                if (e := D.edits_inside(x, D.codes(D.normal(t)), len(x) // 5)) is not None:
                    want[i, k] = e[0]
        assert {(i, k): e for i, k, e, _ in index.find(texts)} == want


def test_edits_at_the_limit_lose_no_passage(spark):
    """Whatever the bit samples say: they only spare a window the steps before the exact distance."""
    rng, items = random.Random(9), [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index, texts = D.Index(items, D.EDIT_SHARE), []
    for _, s in items:
        y = list(D.normal(s))
        for q in rng.sample(range(len(y)), len(y) // 5):
            y[q] = "#"
        texts.append("".join(y))
    got = index.find(texts)
    assert {(i, items[i][0]) for i in range(len(texts))} <= {r[:2] for r in got}
    index.proposed = lambda raw, ends, found: found[0] < 0
    assert index.find(texts) == got


def test_secrets_behind_names_and_paths(spark):
    """The span is the secret alone, and a name or path before it hides none."""
    rng, b64 = random.Random(3), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows, want = [], {}
    for i in range(120):
        before = ("export AWS_SECRET_ACCESS_KEY=", "see deadbeef/user/profile/", "it is ")[i % 3]
        rows.append((i, before + "".join(rng.choice(b64) for _ in range(40)) + " and more"))
        want[i] = f"random:{len(before)}:{len(before) + 40}"
    got = {r.doc_id: r.spans for r in S.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(3):
        assert sum(got[i] == want[i] for i in want if i % 3 == k) >= 37


def test_edits_of_many_pairs_at_once():
    """Columns of many lengths against the plain recurrence, with and without a bound."""
    import numpy as np

    from siltwork.llm import decontamination as D

    rng = np.random.default_rng(6)
    for _ in range(30):
        sizes = rng.integers(1, 12, 8)
        items, texts = rng.integers(1, 4, (int(sizes.max()), 8)).astype(np.uint8), rng.integers(1, 4, (int(rng.integers(3, 40)), 8)).astype(np.uint8)
        for most in (None, 0, 1, 2, 3, 5):
            edits, ends = D.fewest_edits(items, sizes, texts, most)
            for c in range(8):
                want = D.edits_inside(items[: sizes[c], c].astype(np.uint32), texts[:, c].astype(np.uint32), 100)
                if most is None or want[0] <= most:
                    assert (int(edits[c]), int(ends[c])) == want
                else:
                    assert edits[c] > most
