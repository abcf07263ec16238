"""Canonical composition (NFC) of any script inside the JVM: decomposition, ordering by combining class, composition.

Texts that a pattern shows to be composed pass unchanged. Of others only the runs that may change are rebuilt; each
distinct run of a text goes through the fold once.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the syllables that are composed by arithmetic begin, and how many parts they have.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
N_VOWELS, N_TAILS, N_SYLLABLES = 21, 28, 11172


@cache
def _tables() -> tuple[dict[str, str], dict[str, int], dict[str, str], set[int], set[int]]:
    """Full decompositions, combining classes, composing pairs; code points that composition changes, and those it may take up."""
    apart, classes, pairs, no, maybe = {}, {}, {}, set(), set()
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or SYLLABLES <= c < SYLLABLES + N_SYLLABLES:
            continue
        if k := unicodedata.combining(ch):
            classes[ch] = k
            maybe.add(c)
        if unicodedata.decomposition(ch)[:1] not in ("", "<"):
            apart[ch] = unicodedata.normalize("NFD", ch)
            if unicodedata.combining(apart[ch][0]):
                maybe.add(c)
            if unicodedata.normalize("NFC", ch) == ch:
                a, b = (chr(int(x, 16)) for x in unicodedata.decomposition(ch).split())
                pairs[a + b] = ch
                maybe.add(ord(b))
            else:
                no.add(c)
    maybe |= set(range(VOWELS, VOWELS + N_VOWELS)) | set(range(TAILS + 1, TAILS + N_TAILS))
    return apart, classes, pairs, no, maybe


#: Every character up to the last of these is composed and takes nothing up.
_PLAIN = "\\x{0}-\\x{2ff}"


def _class(points: set[int]) -> str:
    """The inside of a pattern's character class: sixteen ranges at a time behind one that spans them, since a class tries its parts in turn."""
    ranges = []
    for p in sorted(points):
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    said = lambda a, b: f"\\x{{{a:x}}}-\\x{{{b:x}}}"
    parts = [ranges[k : k + 16] for k in range(0, len(ranges), 16)]
    return "".join(f"[{said(p[0][0], p[-1][1])}&&[{''.join(said(*r) for r in p)}]]" for p in parts)


@cache
def _patterns() -> tuple[str, str]:
    """Whether a text has anything to do, and the runs to do: a character and what it may take up, or one that changes by itself."""
    _, _, _, no, maybe = _tables()
    alone, marks, far = f"[{_class(no)}]", f"[{_class(maybe)}]", f"(?=[^{_PLAIN}])"
    return f"[{_class(no | maybe)}]", f"[{_PLAIN}]{far}{marks}++|{far}(?:(?:[^{_class(no | maybe)}]|{alone})?+{marks}++|{alone})"


def _map(rows: dict[str, str], value: str = "string") -> Column:
    """A table as one constant; keys and values hold no separator."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in rows.items())), F.lit("\x01"), F.lit("\x02")).cast(f"map<string,{value}>")


def _code(c: Column) -> Column:
    """Code point of a character of three UTF-8 bytes."""
    return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _within(c: Column, start: int, count: int) -> Column:
    return c.between(chr(start), chr(start + count - 1)) & (F.length(c) == 1)


def _apart(c: Column, table: Column) -> Column:
    """A character taken apart, as a string."""
    s = _code(c) - SYLLABLES
    tail = F.when(s % N_TAILS > 0, _char(s % N_TAILS + TAILS)).otherwise("")
    syllable = F.concat(_char((s / (N_VOWELS * N_TAILS)).cast("int") + LEADS), _char(((s % (N_VOWELS * N_TAILS)) / N_TAILS).cast("int") + VOWELS), tail)
    return F.when(_within(c, SYLLABLES, N_SYLLABLES), syllable).otherwise(F.coalesce(F.try_element_at(table, c), c))


def _together(a: Column, b: Column, table: Column) -> Column:
    """The character that two compose to, or null."""
    lv = _char(((_code(a) - LEADS) * N_VOWELS + _code(b) - VOWELS) * N_TAILS + SYLLABLES)
    lvt = _char(_code(a) + _code(b) - TAILS)
    # syllables begin at LEADS + 0 .. 18
    pair = F.when(_within(a, LEADS, 19) & _within(b, VOWELS, N_VOWELS), lv)
    pair = pair.when(_within(a, SYLLABLES, N_SYLLABLES) & _within(b, TAILS + 1, N_TAILS - 1) & ((_code(a) - SYLLABLES) % N_TAILS == 0), lvt)
    return pair.otherwise(F.try_element_at(table, F.concat(a, b)))


def compose(run: Column) -> Column:
    """NFC of a short string by one fold over its characters taken apart and ordered."""
    apart, classes, pairs, *_ = _tables()
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    taken = F.array_join(F.transform(letters(run), lambda c: _apart(c, _map(apart))), "")
    # marks are ordered by class between two characters of class 0; equal classes stay in their order
    of = _map({k: str(v) for k, v in classes.items()}, "int")
    marked = F.transform(letters(taken), lambda c: F.struct(c.alias("c"), F.coalesce(F.try_element_at(of, c), F.lit(0)).alias("k")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<n:int,k:int,i:int,c:string>>").alias("out"))

    def place(acc: Column, x: Column) -> Column:
        n = acc["n"] + (x["k"] == 0).cast("int")
        return F.struct(n.alias("n"), F.concat(acc["out"], F.array(F.struct(n.alias("n"), x["k"].alias("k"), F.size(acc["out"]).alias("i"), x["c"].alias("c")))).alias("out"))

    ordered = F.array_sort(F.aggregate(marked, start, place)["out"])
    state = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        # a mark is blocked by one of its class or a higher one before it, a base by any mark
        free = (acc["base"] != "") & ((acc["marks"] == "") | ((acc["last"] < x["k"]) & (x["k"] > 0)))
        one = F.when(free, _together(acc["base"], x["c"], _map(pairs)))
        held = lambda name: acc[name].alias(name)
        grown = F.struct(held("done"), one.alias("base"), held("marks"), held("last"))
        new = F.struct(F.concat(acc["done"], acc["base"], acc["marks"]).alias("done"), x["c"].alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))
        more = F.struct(held("done"), held("base"), F.concat(acc["marks"], x["c"]).alias("marks"), x["k"].alias("last"))
        return F.when(one.isNotNull(), grown).when(x["k"] == 0, new).otherwise(more)

    return F.aggregate(ordered, state, step, lambda acc: F.concat(acc["done"], acc["base"], acc["marks"]))


def nfc(c: Column) -> Column:
    """Canonical composition; null stays null."""
    odd, runs = _patterns()

    def rebuilt(s: Column) -> Column:
        hits = F.regexp_extract_all(s, F.lit(runs), F.lit(0))
        known = F.array_distinct(hits)
        # bound once: the table of a text's distinct runs, then its runs and the text between them
        said = lambda m: F.array_join(F.zip_with(F.split(s, runs, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(F.element_at(m, hit), F.lit("")))), "")
        return F.element_at(F.transform(F.array(F.map_from_arrays(known, F.transform(known, compose))), said), 1)

    return F.when(c.rlike(f"[^{_PLAIN}]") & c.rlike(odd), rebuilt(c)).otherwise(c)
