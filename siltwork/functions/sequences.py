"""Similarity of two short texts by what they share in order: longest common subsequence and matching blocks. JVM only.

Both are for passages and lines: work grows with the product of the lengths (subsequence: over 62).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a word of the row that the subsequence is counted in; two more hold carry and sign.
WORD = 62
_FULL = (1 << WORD) - 1
#: A close match has at least this ratio.
CUTOFF = 0.3


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Characters of the longest common subsequence, by rows of bits: one addition a word for each character of `b`."""

    def masks(chars: Column) -> Column:
        """For each distinct character its places as bits, a long for each WORD places."""
        words = F.transform(F.sequence(F.lit(0), F.greatest((F.size(chars) - 1) / WORD, F.lit(0)).cast("int")), lambda w: F.slice(chars, w * WORD + 1, F.lit(WORD)))
        bits = lambda c: F.transform(words, lambda part: F.aggregate(F.transform(part, lambda x, i: F.when(x == c, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")), F.expr("0L"), lambda s, x: s + x))
        known = F.array_distinct(chars)
        return F.map_from_arrays(known, F.transform(known, bits))

    def run(at: Column) -> Column:
        zero = F.transform(F.element_at(F.map_values(at), 1), lambda _: F.expr("0L"))
        full = F.transform(zero, lambda _: F.lit(_FULL).cast("long"))
        word = F.struct(F.expr("0L").alias("carry"), F.array().cast("array<bigint>").alias("row"))

        def step(row: Column, c: Column) -> Column:
            pairs = F.zip_with(row, F.coalesce(F.try_element_at(at, c), zero), lambda v, m: F.struct(v.alias("v"), m.alias("m")))

            def add(acc: Column, x: Column) -> Column:
                total = x["v"] + x["v"].bitwiseAND(x["m"]) + acc["carry"]
                new = total.bitwiseAND(F.lit(_FULL).cast("long")).bitwiseOR(x["v"].bitwiseAND(F.bitwise_not(x["m"])))
                return F.struct(F.shiftright(total, WORD).alias("carry"), F.concat(acc["row"], F.array(new)).alias("row"))

            return F.aggregate(pairs, word, add)["row"]

        return F.aggregate(letters(b), full, step, lambda row: F.aggregate(row, F.lit(0), lambda n, v: n + WORD - F.bit_count(v)))

    return F.when((F.length(a) > 0) & (F.length(b) > 0), _bound(masks(letters(a)), run)).when(a.isNotNull() & b.isNotNull(), 0)


def matching_blocks(a: Column, b: Column) -> Column:
    """Structs (a, b, n) of runs that both texts have, places from 0: the longest first, then those left and right of it.

    Of equally long runs the one first in `a`, then first in `b`, counts. The longest run of two ranges is found by
    halving its length: some run of n is shared as long as one of n + 1 is.
    """
    rng = lambda alo, ahi, blo, bhi: F.struct(alo.alias("alo"), ahi.alias("ahi"), blo.alias("blo"), bhi.alias("bhi"))
    none = F.array().cast("array<struct<a:int,b:int,n:int>>")
    zero, n, m = F.lit(0), F.length(a), F.length(b)

    def grams(s: Column, lo: Column, hi: Column, size: Column) -> Column:
        return F.when(hi - size >= lo, F.transform(F.sequence(lo, F.greatest(hi - size, lo)), lambda i: F.substring(s, i + 1, size))).otherwise(F.array().cast("array<string>"))

    def both(r: Column, size: Column) -> tuple[Column, Column]:
        return grams(a, r["alo"], r["ahi"], size), grams(b, r["blo"], r["bhi"], size)

    def longest(r: Column) -> Column:
        most = F.least(r["ahi"] - r["alo"], r["bhi"] - r["blo"])
        halvings = F.sequence(F.lit(1), F.ceil(F.log2(most + 1.0)).cast("int"))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.expr("0") + ((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
            shared = F.arrays_overlap(*both(r, mid))
            return F.when(acc["lo"] >= acc["hi"], acc).when(shared, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), (mid - 1).alias("hi")))

        return F.aggregate(halvings, F.struct(zero.alias("lo"), most.alias("hi")), halve, lambda acc: acc["lo"])

    def step(acc: Column, _: Column) -> Column:
        rest = F.slice(acc["todo"], F.lit(1), F.size(acc["todo"]) - 1)

        def split(x: Column) -> Column:
            r, size = x["r"], x["size"]
            in_a, in_b = both(r, size)

            def at(g: Column) -> Column:
                i, j = (r["alo"] + F.array_position(in_a, g) - 1).cast("int"), (r["blo"] + F.array_position(in_b, g) - 1).cast("int")
                return _bound(F.struct(i.alias("a"), j.alias("b"), size.alias("n")), lambda k: F.struct(
                    F.concat(rest, F.filter(F.array(rng(r["alo"], k["a"], r["blo"], k["b"]), rng(k["a"] + k["n"], r["ahi"], k["b"] + k["n"], r["bhi"])), lambda x: (x["alo"] < x["ahi"]) & (x["blo"] < x["bhi"]))).alias("todo"),
                    F.concat(acc["out"], F.array(k)).alias("out"),
                ))

            return F.when(size == 0, F.struct(rest.alias("todo"), acc["out"].alias("out"))).otherwise(_bound(F.element_at(F.array_intersect(in_a, in_b), 1), at))

        found = _bound(F.element_at(acc["todo"], -1), lambda r: _bound(F.struct(r.alias("r"), longest(r).alias("size")), split))
        return F.when(F.size(acc["todo"]) == 0, acc).otherwise(found)

    start = F.struct(F.when((n > 0) & (m > 0), F.array(rng(zero, n, zero, m))).otherwise(F.array().cast("array<struct<alo:int,ahi:int,blo:int,bhi:int>>")).alias("todo"), none.alias("out"))
    # each block leaves at most two ranges, so there are at most two looks for a character and one
    looks = F.sequence(F.lit(1), 2 * F.least(n, m) + 1)
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(looks, start, step, lambda acc: F.array_sort(acc["out"])))


def _ratio(shared: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def subsequence_ratio(a: Column, b: Column) -> Column:
    """Twice the common subsequence over both lengths; two empty texts are alike."""
    return _ratio(lcs_length(a, b), a, b)


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over both lengths. Not symmetric: ties between runs go by `a`."""
    return _ratio(F.aggregate(matching_blocks(a, b), F.lit(0), lambda s, x: s + x["n"]), a, b)


def closest(literal: Column, lines: Column, cutoff: float = CUTOFF) -> Column:
    """Struct (ratio, line) of the line most like the literal, of equal ones the greatest; null where none reaches the cutoff."""
    scored = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.struct(block_ratio(x, literal).alias("ratio"), x.alias("line")))
    return F.array_max(F.filter(scored, lambda x: x["ratio"] >= cutoff))
