"""The text functions that run over every whole text, once more in Python over Arrow: a batch of texts takes a few calls of
C code, where the JVM's patterns take one text through a chain of copies. Each gives what its namesake in ``text`` gives."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship
from . import text as T

_ZERO_WIDTH, _TOKEN = re.compile(f"[{T.ZERO_WIDTH}]"), re.compile(T.TOKEN)
_THOUSANDS = re.compile("(?<=[০-৯0-9]),(?=[০-৯0-9]{2,3}(?![০-৯0-9]))")
_GROUPS, _BN_DIGIT = re.compile(b",(?<=[0-9],)(?=[0-9])"), re.compile(f"[{T.BN_DIGITS}]")
_FOLD = str.maketrans(T.BN_DIGITS, T.ASCII_DIGITS)
_STOP = frozenset(T.STOP_WORDS)
_BLANKS = tuple(bytes([b]) for b in b" \t\n\x0b\x0c\r")
_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_QUOTES = re.compile(b"\xe2\x80[\x98-\xb0]")


def texts(col: pa.Array) -> Iterator[str]:
    for s in col:
        yield s.as_py() or ""


def index_tokens(s: str) -> list[str]:
    """``text.index_tokens`` of one text; blanks are no part of a token, so they stay as they are."""
    if not s.isascii():
        s = _ZERO_WIDTH.sub("", unicodedata.normalize("NFC", s)).replace(T.DANDA_ALT, T.DANDA)
    kept = [t for t in "\n".join(_TOKEN.findall(s)).lower().split("\n") if t and t not in _STOP]
    return kept + [x for x in (_THOUSANDS.sub("", t) for t in kept if "," in t) if x]


def norm_body(s: str) -> bytes:
    """``text.norm_body`` of one text in UTF-8."""
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
        s = s.translate(_FOLD) if _BN_DIGIT.search(s) else s
    return b" ".join(_GROUPS.sub(b"", s.encode()).split())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), np.uint64)


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, one row after another, and how many each has."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=rows)


def shingle_hashes(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct n-word shingles of each canonical body, and how many each text has; fewer words are taken one by one."""
    seen: dict[bytes, int] = {}
    codes, sizes = [], []
    for s in texts(col):
        w = norm_body(s).split()
        codes += [seen.setdefault(v, len(seen)) for v in w]
        sizes.append(len(w))
    size = np.array(sizes, np.int64)
    word, row = word_hashes(list(seen))[np.array(codes, np.int64)], np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))
    run = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for k in range(n):
        run = run * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(run)]
    full = left[: len(run)] >= n
    short = size[row] < n
    return distinct(np.concatenate([run[full], word[short]]), np.concatenate([row[: len(run)][full], row[short]]), len(size))


def body_digest(c: Column) -> Column:
    """Struct (digest, n): SHA-1 of the canonical body in hexadecimal, null for an empty one, and its characters."""
    ship(SparkSession.active())

    def run(col: pa.Array) -> pa.Array:
        digests, sizes = [], []
        for s in texts(col):
            b = norm_body(s)
            digests.append(hashlib.sha1(b).hexdigest() if b else None)
            sizes.append(len(b) if b.isascii() else len(b.decode()))
        return pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int32())], ["digest", "n"])

    return F.arrow_udf(run, "digest string, n int")(c)


def latin_counts(c: Column, markers: tuple[str, ...]) -> Column:
    """Struct (visible, latin, bengali, v, hits): characters that are no blank, of Latin scripts and quotation marks, of the corpus language; v; markers found."""
    ship(SparkSession.active())
    found = tuple(m.encode() for m in markers)

    def run(col: pa.Array) -> pa.Array:
        out: list[list[int]] = [[] for _ in range(5)]
        for s in texts(col):
            b = s.encode()
            latin = len(b.translate(None, _NOT_LETTERS)) + b.count(b"\xc2") + b.count(b"\xc3") + len(_QUOTES.findall(b))
            for to, n in zip(out, (len(s) - sum(map(b.count, _BLANKS)), latin, b.count(b"\xe0\xa6") + b.count(b"\xe0\xa7"), b.count(b"v"), sum(m in b for m in found)), strict=True):
                to.append(n)
        names = ["visible", "latin", "bengali", "v", "hits"]
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in out], names)

    return F.arrow_udf(run, "visible int, latin int, bengali int, v int, hits int")(c)


def legacy_paragraph_score(c: Column, markers: tuple[str, ...]) -> Column:
    """``text.legacy_paragraph_score`` from counts that are made once a text."""
    k = latin_counts(c, markers)
    n, latin = F.greatest(k["visible"], F.lit(1)), k["latin"]
    s = F.when(latin / n > 0.5, 0.45).otherwise(0.0) + 0.30 * F.least(k["hits"] / 5, F.lit(1.0)) + F.when(k["v"] / F.greatest(latin, F.lit(1)) > 0.08, 0.25).otherwise(0.0)
    return F.when((k["visible"] < 6) | (k["bengali"] / n > 0.15), 0.0).otherwise(F.round(F.least(s, F.lit(1.0)), 2))
