"""Figures of a text as typed values: clause numbers whole, ordinals, multipliers, grouped digits; and audits of ranges and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Multipliers and endings of ordinals by language.
MULTIPLIERS = {
    "bn": (("হাজার", 1000), ("লক্ষ", 100000), ("লাখ", 100000), ("কোটি", 10000000)),
    "en": (("thousand", 1000), ("lakh", 100000), ("crore", 10000000)),
}
ORDINALS = {"bn": "(?:ম|য়|র্থ|ষ্ঠ)", "en": "(?:st|nd|rd|th)\\b"}
# What an amount with a unit may be.
ENVELOPES = {"টাকা": (100, 100_000_000), "%": (0, 100), "শতাংশ": (0, 100)}
#: A dotted number of three parts or more is one token.
ATOMIC = "[0-9]+(?:\\.[0-9]+){2,}+"
_DIGIT = "[0-9০-৯]"
_RANGE = f"({_DIGIT}[0-9০-৯,]*)\\s*[-–—]\\s*({_DIGIT}[0-9০-৯,]*)"
#: Digits before the point that an exact value keeps; longer figures stay as printed.
_WHOLE = 24


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _plain(number: Column, scale: Column) -> Column:
    """A value as text: four decimals at most, no trailing zeros; a figure too long to be exact stays as printed."""
    n = number.try_cast(f"decimal({_WHOLE + 4},4)")
    said = (n * scale.cast("decimal(10,0)")).cast("decimal(38,4)").cast("string")
    return F.coalesce(F.regexp_replace(said, "\\.?0+$", ""), number)


def figures(c: Column | str, lang: str = "bn") -> Column:
    """Structs (kind, value) of a text's figures: `clause`, `ordinal`, `scaled` (by a word after it), `number`.

    The first rule that claims a character has it: dotted numbers of three parts are taken out whole, then a number takes the
    ordinal ending or the multiplier after it. An ending closes its number: digits right after it are the next one. Commas
    between digits are no part of a value. In an English text, runs of the corpus language are names in brackets and give
    nothing. Clauses come first, then the others in order; null has none.
    """
    s = T.nfc(c)
    s = T.fold_digits(F.regexp_replace(s, "[ঀ-৿]+", " ") if lang == "en" else s)
    words = "|".join(w for w, _ in MULTIPLIERS[lang])
    scale = F.create_map(*(F.lit(x) for w, k in (*MULTIPLIERS[lang], ("", 1)) for x in (w, k)))
    number = f"([0-9]+(?:\\.[0-9]+)?)({ORDINALS[lang]})?(?:\\s*({words}))?"

    def rest(t: Column) -> Column:
        part = lambda k: F.regexp_extract_all(t, F.lit(number), F.lit(k))
        found = F.arrays_zip(part(1).alias("n"), part(2).alias("o"), part(3).alias("w"))

        def one(x: Column) -> Column:
            word = F.coalesce(x["w"], F.lit(""))
            kind = F.when(word != "", "scaled").when(F.coalesce(x["o"], F.lit("")) != "", "ordinal").otherwise("number")
            return F.struct(kind.alias("kind"), _plain(x["n"], F.element_at(scale, word)).alias("value"))

        return F.transform(found, one)

    def both(t: Column) -> Column:
        clauses = F.transform(F.regexp_extract_all(t, F.lit(ATOMIC), F.lit(0)), lambda x: F.struct(F.lit("clause").alias("kind"), x.alias("value")))
        return F.concat(clauses, _bound(T.strip_groups(F.regexp_replace(t, ATOMIC, " ")), rest))

    return _bound(s, both)


def values(c: Column | str, lang: str = "bn") -> Column:
    """The sorted multiset of a text's values."""
    return F.array_sort(F.transform(figures(c, lang), lambda x: x["value"]))


def surplus(a: Column, b: Column) -> Column:
    """Elements of sorted `a` beyond those of `b`, each as often as it is too many."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.flatten(F.transform(F.array_distinct(a), lambda v: F.array_repeat(v, F.greatest(times(a, v) - times(b, v), F.lit(0)))))


def audit(c: Column | str, envelopes: dict[str, tuple[int, int]] = ENVELOPES) -> Column:
    """Structs (issue, fragment) of figures that look damaged.

    `range_digit_count_mismatch`: the ends of a range differ by two digits or more; else `range_inverted`: the first is
    greater; `magnitude_implausible`: an amount outside its unit's envelope. Ends of any length are compared as numbers.
    """
    s = T._s(c)
    units = "|".join(envelopes)
    digits = lambda x: F.replace(T.fold_digits(x), F.lit(","), F.lit(""))
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")

    def ends(x: Column) -> Column:
        lo, hi = digits(x["lo"]), digits(x["hi"])
        greater = (F.length(bare(lo)) > F.length(bare(hi))) | ((F.length(bare(lo)) == F.length(bare(hi))) & (bare(lo) > bare(hi)))
        issue = F.when(F.abs(F.length(lo) - F.length(hi)) >= 2, "range_digit_count_mismatch").when(greater, "range_inverted")
        return F.struct(issue.alias("issue"), x["all"].alias("fragment"))

    def amount(x: Column) -> Column:
        v, outside = digits(x["n"]).try_cast("decimal(38,0)"), F.lit(False)
        for unit, (lo, hi) in envelopes.items():
            outside = F.when(x["u"] == unit, v.isNull() | (v < lo) | (v > hi)).otherwise(outside)
        return F.struct(F.when(outside, "magnitude_implausible").alias("issue"), x["all"].alias("fragment"))

    def found(rx: str, **groups: int) -> Column:
        return F.arrays_zip(*(F.regexp_extract_all(s, F.lit(rx), F.lit(k)).alias(name) for name, k in groups.items()))

    both = F.concat(F.transform(found(_RANGE, all=0, lo=1, hi=2), ends), F.transform(found(f"({_DIGIT}[0-9০-৯,]*)\\s*({units})", all=0, n=1, u=2), amount))
    return F.filter(both, lambda x: x["issue"].isNotNull())
