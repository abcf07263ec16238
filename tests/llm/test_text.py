"""Packing, pages, lines, revisits and language-model scores against plain forms."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltwork.llm import html_extraction as H
from siltwork.llm import line_dedup as L
from siltwork.llm import lm_scoring as LM
from siltwork.llm import packing as P
from siltwork.llm import queries as Q
from siltwork.llm import warc as W

from . import fixtures as fx


def plain_pieces(rows):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(Q.tokenizer_files()[0]), []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def sequences_hold(got, size=2048):
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for xs in seqs.values():
        at = 0
        for off, n in sorted(xs):
            assert off == at
            at += n
        assert at <= size
    return len(seqs)


def test_packing_of_the_table(spark):
    got = P.best_fit_packing(fx.table(spark, "documents"), *Q.tokenizer_files()).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == plain_pieces(fx.texts(spark))
    assert sequences_hold(got) <= P.fewest([r.length for r in got], 2048) + 1


def test_packing_odd_cases(spark):
    docs = fx.odd_docs(spark).unionByName(fx.odd_docs(spark).limit(1).selectExpr("99L as doc_id", "'a <|endoftext|> b' as text", "* except (doc_id, text)"))
    got = P.best_fit_packing(docs, *Q.tokenizer_files()).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == plain_pieces([*fx.odd_rows(), (99, "a <|endoftext|> b")])
    sequences_hold(got)
    assert P.best_fit_packing(fx.no_docs(spark), *Q.tokenizer_files()).count() == 0


def test_local_search_empties_bins():
    """60+30, 50+40, 20: the last bin empties once the first two have exchanged 60 for 50."""
    bins = P.improve([[0, 1], [2, 3], [4]], [60, 30, 50, 40, 20], 100, 2)
    assert len(bins) == 2 and sorted(k for b in bins for k in b) == [0, 1, 2, 3, 4]
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))]
        bins = P.pack(lengths, 100)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in b) <= 100 for b in bins)
        assert math.ceil(sum(lengths) / 100) <= P.fewest(lengths, 100) <= len(bins) <= P.fewest(lengths, 100) * 1.1 + 1


def test_local_search_goes_on_until_no_step_is_left():
    rng = random.Random(14)
    lengths, bins = [rng.randrange(120, 520) for _ in range(150)], P.Bins(1000)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bins.best_fit(k, lengths[k])
    least = P.fewest(lengths, 1000)
    got = P.improve(bins.items, lengths, 1000, least)
    search = P.Search(got, lengths, 1000)
    assert len(got) == least or not any(search.step(at) for _, at in list(search.open))



PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, a lot.</p></div><article><h1>Head &amp; line</h1><p>First   paragraph, with <b>bold<br>text</b>. &eacute;<p>Second one, unclosed.
<ul><li>item one, yes<li>item two, no</ul><aside><p>Aside, not text.</p></aside><div class="ad">Buy, now.</div><form><p>Name?</p><input></form><script>var a="<p>no</p>";</script>
<section id="comments"><p>A comment, from a reader.</p></section></article><footer>&copy; 2024, all.</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE) == "Head & line\nFirst paragraph, with bold text. é\nSecond one, unclosed.\nitem one, yes\nitem two, no"
    plain = "<body><div class='menu'><a>a</a> <a>b</a></div><div><p>Long prose, with marks. And more of it, so that it counts.</p><p>Short.</p></div><div><a href=x>one</a> <a>two</a></div></body>"
    assert H.main_text(plain) == "Long prose, with marks. And more of it, so that it counts.\nShort."
    for bad in ("", "<", "<p", "<!--", "text only", "<script>x", "</p></div>", "&#0;&bogus;<p>x"):
        H.main_text(bad)
    assert H.main_text("text only") == "text only"


def article(page):
    """The blocks of a generated page's article."""
    import html
    import re

    inner = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:h1|p)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_paths_decide_without_names(spark):
    """All names gone - neutral elements, no class, id or role - the ratios alone find nearly every article."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:nav|aside|footer|article|header|section|main)\b", r"<\1div", p)) for p in pages]
    assert sum(H.main_text(q) == article(p) for p, q in zip(pages, plain, strict=True)) >= 0.95 * len(pages)
    assert sum(H.main_text(p, prior=False) == article(p) for p in pages) >= 0.95 * len(pages)
    assert all(H.main_text(p) == article(p) for p in pages)


def test_main_text_of_odd_markup():
    prose = "Words go on here, and then some more of them follow. " * 5
    assert H.main_text('<p title="x>Text') == "Text"
    assert H.main_text("<p>one <a href=x'y>z</a> two, three</p>") == "one z two, three"
    assert H.main_text('<p title="a > b">Text, of it.</p>') == "Text, of it."
    named = f"<article><p class=search>One, two. Three.</p><p class='related-work side'>Some more, of it.</p><p>{prose}</p></article>"
    assert H.main_text(named) == f"One, two. Three.\nSome more, of it.\n{prose.strip()}"
    whole = f"<body><form id=f><div><h1>Title</h1><p>{prose}</p></div></form></body>"
    assert H.main_text(whole) == f"Title\n{prose.strip()}"
    short = "<body><nav><a href=/a>menu</a></nav><div class=ad>Buy this now, friends. It is cheap.</div><article><h1>Hi</h1><p>Yo</p></article><footer>All rights. Reserved, really.</footer></body>"
    assert H.main_text(short) == "Hi\nYo"
    comments = f"<article><h1>Title</h1><p>{prose}</p><ul><li>one<li>two</ul><section class='comments'><p>{prose}</p></section></article><aside><p>{prose}</p></aside>"
    assert H.main_text(comments) == f"Title\n{prose.strip()}\none\ntwo"
    assert H.main_text("<div>" * 20_000 + "deep text" + "<b>" * 20_000 + "x</b>") == "deep textx"


def test_pages_of_the_table(spark):
    """The generated pages hold their text in one article: all of its blocks and nothing else."""
    pages = {r.page_id: r.html for r in fx.table(spark, "pages").collect()}
    for r in H.extract_text(fx.table(spark, "pages")).collect():
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2)], "page_id long, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in H.extract_text(odd).collect()] == [("", 0)] * 3
    assert H.extract_text(odd.where("false")).count() == 0


def test_lines_against_brute_force(spark):
    rows = [(r.doc_id, r.source, r.text) for r in fx.table(spark, "documents").collect()]
    pages, held = Counter(s for _, s, _ in rows), Counter()
    for _, s, t in rows:
        held.update({(s, x.strip(" ")) for x in t.split("\n")} - {(s, "")})
    drop = {k for k, n in held.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    for most in (0, 10_000):
        got = L.drop_boilerplate(fx.table(spark, "documents"), F.col("source"), ratio=0.1, pages=3, broadcast_lines=most).collect()
        want = {i: "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop) for i, s, t in rows}
        assert {r.doc_id: r.text for r in got} == want and drop
    odd = L.drop_boilerplate(fx.odd_docs(spark), F.lit(None).cast("string"), ratio=0.01, pages=2).collect()
    assert len(odd) == len(fx.odd_rows()) and {r.text for r in odd if r.doc_id == 4} == {""}
    assert L.drop_boilerplate(fx.no_docs(spark), F.col("host")).count() == 0


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.com:80/A/?utm_x=1#top", "https://m.example.com/A?ref=x", "example.com/A", None, "", "http://e.org/p?a=1&ref=2&b=3"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(W.canonical_url(F.col("u"))).collect()]
    assert got == ["example.com/A", "example.com/A", "example.com/A", "", "", "e.org/p?a=1&b=3"]


def test_revisits_against_brute_force(spark):
    rng, recs = random.Random(3), []
    for i in range(400):
        at = None if i % 97 == 0 else rng.randrange(0, 20_000)
        tag = rng.choice(["a", "b", None])
        recs.append((i, rng.choice(["http://x.com/1", "https://www.x.com/1#f", "http://y.com/2"]), at, rng.choice(["response", "revisit"]), tag and f'W/"{tag}"', rng.choice(["m1", None]), rng.choice(["d", None]), {"etag": "e", "content-length": str(i), "date": str(at)} if i % 5 else None))
    df = spark.createDataFrame(recs, "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    key = lambda u: "y" if "y.com" in u else "x"
    for width in (500, 10**9):
        got = {r.record_id: r for r in W.resolve_revisits(df, width).collect()}
        assert len(got) == sum(r[3] == "revisit" for r in recs)
        for r in (x for x in recs if x[3] == "revisit"):
            src = max(((s[2], s[0]) for s in recs if s[3] == "response" and s[2] is not None and r[2] is not None and key(s[1]) == key(r[1]) and s[2] < r[2]), default=None)
            g = got[r[0]]
            assert g.source_id == (src[1] if src else None)
            if not src:
                assert g.verdict == "missing" and g.headers is None
                continue
            s = recs[src[1]]
            first = next(((a, b) for a, b in zip(r[4:7], s[4:7]) if a is not None), None)
            assert g.verdict == ("unchecked" if first is None else "resolved" if first[0] == first[1] else "mismatch")
            if g.verdict != "mismatch":
                assert g.headers == {**(s[7] or {}), **{k: v for k, v in (r[7] or {}).items() if k in W.PERMITTED}}
    assert W.resolve_revisits(df.where("false")).count() == 0


def brute_base(rows):
    c = Counter()
    for i, t in rows:
        if i is not None and not fx.held(i, 10):
            c.update([*fx.words(t), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        w = [*fx.words(t), None]
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out


def test_lm_base_of_the_table(spark):
    rows = fx.texts(spark)
    got = LM.lm_scores(fx.table(spark, "documents")).collect()
    want = brute_base(rows)
    for r in got:
        n, k, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, k, total, fx.held(r.doc_id, 10))
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_lm_head_and_tail_give_the_same(spark):
    a, b = (sorted((r.doc_id, round(r.base_score, 6), round(r.n_known)) for r in LM.lm_scores(fx.table(spark, "documents"), head_words=n).collect()) for n in (5, 50_000))
    assert a == b


def test_lm_odd_cases(spark):
    got = LM.lm_scores(fx.odd_docs(spark)).collect()
    want = brute_base(fx.odd_rows())
    assert len(got) == len(fx.odd_rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_tokens, r.n_known) == want[r.doc_id][:2]
    assert LM.lm_scores(fx.no_docs(spark)).count() == 0
    alone = LM.lm_scores(spark.createDataFrame([(None, "never learned")], "doc_id long, text string")).first()
    assert alone.held_out is None and alone.train_tokens == 0 and alone.base_score == 0.0 and alone.n_known == 0


def trained(streams):
    data = np.frombuffer(b"".join(streams), np.uint8)
    code, bits = LM.Code(np.bincount(data, minlength=256)), LM.table_bits(len(data))
    total = [np.zeros((1 << b, 2), np.uint32) for b in bits]
    LM.count_bits(streams, code, bits, total)
    return LM.Mixer(code, bits, [LM.stretch(t) for t in total])


def plain_log10(mixer, text):
    """The mixer one decision at a time, in plain floats."""
    d = LM.Decisions([text], mixer.code, mixer.bits)
    slots = [[] for _ in LM.ORDERS]
    for k, _, x in d.slots(100):
        slots[k] += x.tolist()
    score = 0.0
    for lo in range(0, len(text), LM.SEGMENT):
        weights = [[float(x) for x in row] for row in mixer.weights]
        refined = [float(x) for x in mixer.refined]
        end = int(d.at[min(lo + LM.SEGMENT, len(text))])
        for begin in range(int(d.at[lo]), end, LM.SPAN):
            step, cells, gate = [0.0] * 8, {}, None
            for i in range(begin, min(begin + LM.SPAN, end)):
                x, bit = [int(mixer.tables[k][slots[k][i]]) for k in range(len(LM.ORDERS))], int(d.bit[i])
                if gate is None:
                    gate = sum(abs(v) >= LM.SURE * LM.SCALE for v in x)
                dot = min(max(sum(w * v for w, v in zip(weights[gate], x)), -7.9), 7.9)
                p = 1 / (1 + math.exp(-dot))
                cell = gate * LM.CELLS + LM.CELLS // 2 + int(np.rint(np.float32(dot) * 2))
                q = (p + refined[cell]) / 2
                score += math.log10(q if bit else 1 - q)
                cells[cell] = refined[cell] + (bit - refined[cell]) * LM.REFINE
                for k, v in enumerate(x):
                    step[k] += (bit - p) * v
            for cell, v in cells.items():
                refined[cell] = v
            weights[gate] = [w + u * LM.RATE / LM.SCALE**2 for w, u in zip(weights[gate], step)]
    return score


def test_mixing_of_many_lanes_is_mixing_one_by_one(spark):
    texts = [LM.stream(LM.words((t or "").encode())) for _, t in fx.texts(spark)]
    mixer = trained(texts[::2])
    some = sorted(texts[1::2], key=len)[:: len(texts) // 12] + [b"\n", b"a " * 4000 + b"\n"]
    for got, text in zip(mixer.log10(some), some, strict=True):
        want = plain_log10(mixer, text)
        assert abs(got - want) < 1e-3 * max(1, abs(want))
    assert np.allclose(mixer.log10(some[::-1]), mixer.log10(some)[::-1])


def test_mixed_probabilities_of_all_continuations_sum_to_one():
    """After any beginning the 256 next bytes share the probability of the beginning."""
    random.seed(8)
    texts = [" ".join(random.choice(["ab", "abc", "ba", "c"]) for _ in range(50)).encode() + b"\n" for _ in range(20)]
    mixer = trained(texts)
    for begin in (b"", b"ab", b"abc b", texts[0][:60]):
        whole = mixer.log10([begin])[0] if begin else 0.0
        assert abs(sum(10 ** (x - whole) for x in mixer.log10([begin + bytes([b]) for b in range(256)])) - 1) < 1e-4


def test_mixer_learns_contexts_across_words_and_in_the_text(spark):
    held = [(i, t) for i, t in ((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())]
    train = [LM.stream(LM.words((t or "").encode())) for i, t in held if not fx.held(i, 10)]
    mixer = trained(train)
    order = random.Random(4).sample
    known = [b"one two three four five six\n"] * 30
    pair = trained(known + [LM.stream(order(b"one two three four five six".split(), 6)) for _ in range(30)])
    assert pair.log10([b"one two three four five six\n"])[0] > pair.log10([b"two one four three six five\n"])[0] + 1
    # a long text of one language costs less a byte later on
    rest = b"zq xj vk qz jx kv " * 100
    assert -mixer.log10([rest[:1800] + b"\n"])[0] < 4 * -mixer.log10([rest[:450] + b"\n"])[0]


def test_held_out_texts_cost_less_than_under_the_base(spark):
    got = LM.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_counting_makes_the_decisions_of_equal_contexts_once(monkeypatch):
    """The counts are those of all decisions one by one, but a line that comes a thousand times costs its decisions once."""
    streams = [b"the same line again\n"] * 1000 + [b"another one\n", b"\n"]
    data = np.frombuffer(b"".join(streams), np.uint8)
    code, bits = LM.Code(np.bincount(data, minlength=256)), LM.table_bits(len(data))
    d, want = LM.Decisions(streams, code, bits), [np.zeros((1 << b, 2), np.uint32) for b in bits]
    for k, here, slot in d.slots(1 << 12):
        np.add.at(want[k], (slot.astype(np.int64), d.bit[here].astype(np.int64)), 1)
    made, turns = [], LM._turns
    monkeypatch.setattr(LM, "_turns", lambda c, x: made.append(len(x)) or turns(c, x))
    got = [np.zeros((1 << b, 2), np.uint32) for b in bits]
    LM.count_bits(streams, code, bits, got)
    assert all((g == w).all() for g, w in zip(got, want, strict=True))
    assert sum(made) < 40 * len(bits) < len(data)


def test_partial_counts_add_up(spark, monkeypatch):
    """Many tasks and sums of sums give the tables of one task."""
    docs = fx.table(spark, "documents")
    one = {r.doc_id: r.score for r in LM.lm_scores(docs).collect()}
    monkeypatch.setattr(LM, "SMALL_TASK", 1 << 16)
    monkeypatch.setattr(LM, "LARGE_TASK", 1 << 16)
    monkeypatch.setattr(LM, "FAN", 2)
    many = {r.doc_id: r.score for r in LM.lm_scores(docs.repartition(7)).collect()}
    assert all(abs(one[k] - v) < 1e-6 * max(1, abs(v)) for k, v in many.items())


def test_words_of_a_decision_are_what_the_slots_say():
    """The tables' log-odds and the bit of a decision, fetched at once, are those of its slots."""
    streams = [b"some words of a line\n", b"\n", "é and ৯\n".encode()]
    data = np.frombuffer(b"".join(streams), np.uint8)
    code, bits = LM.Code(np.bincount(data, minlength=256)), LM.table_bits(len(data))
    tables = [np.random.default_rng(k).integers(-127, 128, 1 << b).astype(np.int8) for k, b in enumerate(bits)]
    d = LM.Decisions(streams, code, bits)
    got = d.said(tables, 7).view(np.int8).reshape(-1, 4)
    assert (got[:, 3] == d.bit).all()
    for k, here, slot in d.slots(5):
        assert (got[here, k] == tables[k][slot]).all()
