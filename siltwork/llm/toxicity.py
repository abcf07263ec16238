"""Toxicity by a learned lexicon: Levenshtein automata over the lexicon's trie, and windows that tell quotation from abuse."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

#: The lexicon is fitted on at most so many labelled rows of each class, those of least hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 6000
STEM_LEAST, STEM_MOST = 4, 12
WINDOW = 12
#: Weight of a use in quotation marks; of a misspelt use where clean texts have none; where the bound lies between classes that are apart.
QUOTED, MISSPELT, GAP = 0.1, 0.6, 0.25
_WORD = re.compile(r"\w+")
_LEET = str.maketrans("013457", "oieast")
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}


@dataclass
class Lexicon:
    """Stems with the weight of a whole and of a misspelt use, and the fitted combination of what a text has."""

    stems: dict[str, tuple[float, float]] = field(default_factory=dict)
    intercept: float = -4.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)


class Trie:
    """The lexicon as a trie, intersected with the Levenshtein automaton of a word.

    The automaton's states for 0, 1 and 2 edits are bit masks over the places of the word; a branch is
    left when none is alive within the edits that its stems allow. A swap of neighbours is one edit.
    Stems may be followed by any ending.
    """

    def __init__(self, stems):
        self.root: dict = {}
        self.tails: set[tuple[int, str]] = set()
        for stem in stems:
            allowed, node = self.allowed(stem), self.root
            for c in stem:
                node = node.setdefault(c, {})
                node["most"] = max(allowed, node.get("most", 0))
            node["stem"] = stem
            parts = allowed + 1  # with fewer edits than parts, one part stays whole, shifted by as many places
            for k in range(parts):
                a, b = k * len(stem) // parts, (k + 1) * len(stem) // parts
                self.tails |= {(a + shift, stem[a:b]) for shift in range(-allowed, allowed + 1) if a + shift >= 0}
        self.places = sorted({(at, at + len(part)) for at, part in self.tails})

    @staticmethod
    def allowed(stem: str) -> int:
        return 0 if len(stem) < 5 else 1 if len(stem) < 9 else 2

    def plausible(self, word: str) -> bool:
        tails = self.tails
        for a, b in self.places:
            if (a, word[a:b]) in tails:
                return True
        return False

    def match(self, word: str) -> tuple[str, int] | None:
        """The stem that a beginning of the word is nearest to, and the edits."""
        if not self.plausible(word):
            return None
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        every = (2 << len(word)) - 1
        best: tuple[int, int, str] | None = None
        stack = [(self.root, (1, 3 & every, 7 & every), (0, 0, 0), 0)]
        while stack:
            node, (r0, r1, r2), (b0, b1, _), last = stack.pop()
            for c, below in node.items():
                if len(c) > 1:
                    continue
                m = at.get(c, 0)
                n0 = (r0 & m) << 1
                n1 = ((r1 & m) << 1 | r0 << 1 | r0 | n0 << 1 | ((b0 & m) << 1 & last) << 1) & every
                n2 = ((r2 & m) << 1 | r1 << 1 | r1 | n1 << 1 | ((b1 & m) << 1 & last) << 1) & every
                if stem := below.get("stem"):
                    edits = 0 if n0 else 1 if n1 else 2 if n2 else 3
                    if edits <= self.allowed(stem) and (best is None or (edits, -len(stem)) < best[:2]):
                        best = (edits, -len(stem), stem)
                if (n0, n1, n2)[below["most"]] | n0:
                    stack.append((below, (n0, n1, n2), (r0, r1, r2), m))
        return (best[2], best[0]) if best else None


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def plain(word: str) -> str:
    """Digits for letters, where a word mixes both."""
    return word.translate(_LEET) if not word.isalpha() and not word.isdigit() else word


def _surprise(n1: int, n0: int, base: float) -> float:
    """Lower bound of -log of the chance that so large a share of the uses is in toxic texts."""
    n = n1 + n0
    p = n1 / n
    if p <= base:
        return 0.0
    return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


def learn(rows: list[tuple[str, int]], toxic_rate: float) -> Lexicon:
    """Stems whose uses are in toxic texts by more than chance among all stems tried, and their combination.

    A stem's uses in toxic texts count once for each pair of neighbours, so that copies of a text add
    nothing. Of stems that extend each other the most surprising stays, at a tie the longest.
    """
    uses, seen, tokens = Counter(), set(), [0, 0]
    for text, label in rows:
        ws = ["", *map(plain, words_of(text)), ""]
        tokens[label] += len(ws) - 2
        if label:
            for a, w, b in zip(ws, ws[1:], ws[2:], strict=False):
                if len(w) >= STEM_LEAST and (k := hash((a, w, b))) not in seen:
                    seen.add(k)
                    uses[w] += 1
    del seen
    if not tokens[0] or not tokens[1]:
        return Lexicon(intercept=4.0 if tokens[1] else -4.0)
    n1: Counter = Counter()
    for w, c in uses.items():
        for k in range(STEM_LEAST, min(len(w), STEM_MOST) + 1):
            n1[w[:k]] += c
    likely = {s for s, c in n1.items() if c >= 4}
    n0: Counter = Counter()
    for text, label in rows:
        if not label:
            for w, c in Counter(map(plain, words_of(text))).items():
                if w[:STEM_LEAST] in likely:
                    for k in range(STEM_LEAST, min(len(w), STEM_MOST) + 1):
                        if w[:k] in likely:
                            n0[w[:k]] += c
    base = tokens[1] / (tokens[0] + tokens[1])
    need = math.log(max(len(likely), 1) / 0.05)
    good = {s: v for s in likely if (v := _surprise(n1[s], n0[s], base)) > need and n1[s] * tokens[0] >= 7 * n0[s] * tokens[1]}
    stems: set[str] = set()
    for s in sorted(good, key=lambda s: (-round(good[s], 6), -len(s), s)):
        if not any(s.startswith(t) or t.startswith(s) for t in stems):
            stems.add(s)
    whole = {s: math.log((n1[s] + 0.5) / (tokens[1] + 1)) - math.log((n0[s] + 0.5) / (tokens[0] + 1)) for s in stems}
    trie, near, memo = Trie(stems), Counter(), {}
    for text, label in rows:
        for w in map(plain, words_of(text)):
            if w not in memo:
                memo[w] = trie.match(w)
            if (m := memo[w]) and m[1]:
                near[m[0], label] += 1
    lex = Lexicon()
    for s in stems:
        f1, f0 = near[s, 1], near[s, 0]
        odds = math.log((f1 + 0.5) / (tokens[1] + 1)) - math.log((f0 + 0.5) / (tokens[0] + 1))
        lex.stems[s] = (whole[s], MISSPELT * whole[s] if not f0 else min(MISSPELT * whole[s], odds) if odds > 0.5 * whole[s] else 0.0)
    scorer = Scorer(lex)
    x = np.array([scorer.features(text)[0] for text, _ in rows])
    y = np.array([label for _, label in rows], float)
    beta = _logistic(x, y)
    shift = math.log(max(toxic_rate, 1e-4) / max(1 - toxic_rate, 1e-4)) - math.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5))
    logits = beta[0] + x @ beta[1:]
    low, high = np.quantile(logits[y == 0], 0.999), np.quantile(logits[y == 1], 0.01)
    if high > low:  # classes are apart, so the fit says nothing about the gap: the bound goes nearer to the clean texts
        shift = -(low + GAP * (high - low))
    lex.intercept, lex.slopes = float(beta[0] + shift), tuple(map(float, beta[1:]))
    return lex


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton's method; the ridge keeps slopes finite where classes are apart."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull, x.T @ (y - p) - pull @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _quoted(text: str, start: int, end: int) -> bool:
    """The span lies in quotation marks that open and close within WINDOW words of it."""
    left, right = max(0, start - 12 * WINDOW), end + 12 * WINDOW
    before = " ".join(text[left:start].rsplit(None, WINDOW)[-WINDOW:]) if start else ""
    after = " ".join(text[end:right].split(None, WINDOW)[:WINDOW])
    for opens, closes in _QUOTES.items():
        if opens == closes:
            if before.count(opens) % 2 == 1 and closes in after:
                return True
        elif before.rfind(opens) > before.rfind(closes) and closes in after:
            return True
    return False


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.trie = lexicon, Trie(lexicon.stems)
        self.hits: dict[str, tuple[str, float]] = {}
        self.clean: set[str] = set()

    def weigh(self, word: str) -> tuple[str, float] | None:
        if word in self.clean:
            return None
        if (hit := self.hits.get(word)) is None:
            m = self.trie.match(plain(word))
            if m and (weight := self.lexicon.stems[m[0]][m[1] > 0]) > 0:
                hit = self.hits[word] = (m[0], weight)
            else:
                if len(self.clean) > 150_000:
                    self.clean.clear()
                self.clean.add(word)
        return hit

    def features(self, text: str) -> tuple[tuple[float, float, float], int]:
        """Weights of all uses: their sum, the sum for the text's length, that it is not nought; and the stems found."""
        low = text.lower()
        words = _WORD.findall(low)
        found = {w: h for w in set(words) if (h := self.weigh(w))} if self.lexicon.stems else {}
        total = 0.0
        if found:
            marks = any(q in low for q in _QUOTES)
            for m in _WORD.finditer(low):
                if h := found.get(m[0]):
                    total += h[1] * (QUOTED if marks and _quoted(low, m.start(), m.end()) else 1.0)
        return (min(total, 25.0), min(total / math.sqrt(1 + len(words) / 300), 25.0), float(total > 0)), len({h[0] for h in found.values()})

    def score(self, text: str) -> tuple[float, int]:
        x, n = self.features(text)
        logit = self.lexicon.intercept + sum(a * b for a, b in zip(self.lexicon.slopes, x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), n


def _scoring(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            got = [scorer.score(t.as_py() or "") for t in batch.column("t")]
            keep = [c for c in batch.schema.names if c != "t"]
            yield batch.select(keep).append_column("score", pa.array([g[0] for g in got], pa.float64())).append_column("n_terms", pa.array([g[1] for g in got], pa.int32()))

    return run


def held_out(id_col: Column, parts: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % parts == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5) -> Lexicon:
    """Lexicon from labelled rows outside the held-out part; rows with a null label or id are not used."""
    own = labels.select(F.col("doc_id").alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("i"), parts))
    share = own.agg(F.avg("y")).first()[0] or 0.0
    pick = [own.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = F.broadcast(pick[0].unionByName(pick[1]))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    small_batches(docs.sparkSession)
    got = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(sample, "i").select("i", "t", "y")
    rows = sorted({(r.i, r.t, r.y) for r in got.collect()})
    return learn([(t, y) for _, t, y in rows], share)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_terms.

    A text is scored by nothing but its own characters. Null and empty texts get the score of a text
    without any term. held_out marks ids that were not learned from; a null id is never learned from and
    has held_out null. Labels that are null or absent are not learned from; without labels of both kinds
    every text gets the same score. Repeated rows get equal scores; other columns are ignored.
    """
    lexicon = fit(docs, labels, id_col, text_col, label_col, parts)
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    out = src.mapInArrow(lean(_scoring(lexicon)), "doc_id long, score double, n_terms int")
    return out.select("doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_terms")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", parts: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic; learned from ``labels`` as in toxicity()."""
    lexicon = fit(docs, labels, text_col=text_col, parts=parts)
    small_batches(docs.sparkSession)
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("t"))
    out = src.mapInArrow(lean(_scoring(lexicon)), src.select("row", F.lit(0.0).alias("score"), F.lit(0).alias("n_terms")).schema)
    return out.where("score < 0.5").select("row.*")
