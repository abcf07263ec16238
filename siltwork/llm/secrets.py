"""Secret scan: fixed patterns, and a randomness test battery with length-aware control of false discoveries. Native only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed patterns; a match counts if the group named by the third entry has so many characters.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same matches as the entries above, without those that the length drops: a run is matched whole or not at all.
_QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Candidates of the battery: runs of characters that encodings use, first without the names or path before them, then whole,
#: then their parts between signs that separate as well as encode. Of those that overlap, the first that is random is reported.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The repetition is possessive: nothing follows it, and the JVM matches any other repetition of a group by recursion.
NAMES = r"^(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})[0-9]?[=/_-]+)++"
PARTS = (r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9+_=-]{20,}", r"[A-Za-z0-9+/=]{20,}", r"[A-Za-z0-9]{20,}")
#: Share of false discoveries among added spans; the least probability that each random string is passed over with.
FDR, ALPHA = 0.01, 0.001
#: Evidence is counted in bins of a quarter nat; more than this is this.
BINS = 2000
#: Relative letter frequencies of running text, in hundredths of a percent.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7), strict=True))
#: Chances of a character of running text that is no lower-case letter: a capital is so much rarer, a digit and a sign have so much each.
CAPITAL, DIGIT, SIGN = 0.04, 0.002, 0.004


SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
VALUES = "array<struct<start:bigint,end:bigint,val:string>>"


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Items of a piece of a long fold.
PIECE = 256


def _scan(items: Column, edge: Column, moved, kept, kind: str) -> Column:
    """What ``kept(edge, item)`` (an array) gives for each item, the edge going on by ``moved(edge, item)``.

    The fold goes piece by piece: a single one would copy all it has found at every item.
    """
    none = F.array().cast(kind)

    def fold(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(moved(acc["edge"], x).alias("edge"), F.concat(acc["out"], kept(acc["edge"], x)).alias("out"))
        return F.aggregate(part, F.struct(start.alias("edge"), none.alias("out")), step)

    def pieces(all_: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.floor((F.size(all_) - 1) / PIECE).cast("int"), F.lit(0)))
        start = F.struct(edge.alias("edge"), F.array().cast(f"array<{kind}>").alias("outs"))
        one = lambda acc, k: _bound(fold(F.slice(all_, k * PIECE + 1, F.lit(PIECE)), acc["edge"]), lambda r: F.struct(r["edge"].alias("edge"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))
        return F.aggregate(at, start, one, lambda acc: F.flatten(acc["outs"]))

    return _bound(items, pieces)


def _walk(hits: Column, gaps: Column, value: Column, keep) -> Column:
    """Structs (start, end, value) of the matches kept: a match begins where all gaps and matches before it end."""
    triples = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), value.alias("val"))
    length = lambda x: F.length(x["gap"]) + F.length(F.coalesce(x["hit"], F.lit("")))

    def kept(at: Column, x: Column) -> Column:
        one = F.array(F.struct((at + F.length(x["gap"])).alias("start"), (at + length(x)).alias("end"), x["val"].alias("val")))
        return F.when(x["hit"].isNotNull() & keep(x["val"]), one).otherwise(F.array().cast(VALUES))

    return _scan(triples, F.lit(0).cast("long"), lambda at, x: at + length(x), kept, VALUES)


def _matches(t: str, pattern: str, group: int, least: int) -> Column:
    text, none = F.col(t), F.array().cast(VALUES)
    hits, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(text.rlike(pattern), _walk(hits, F.split(text, pattern, -1), value, lambda v: F.length(v) >= least)).otherwise(none)


def _candidates(runs: Column) -> Column:
    """For each run structs (start, end, value) of itself and its parts, in the order in which they are reported. Runs don't overlap."""

    def of(run: Column) -> Column:
        val, moved = run["val"], lambda at: lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["val"].alias("val"))
        bare = F.regexp_replace(val, NAMES, "")
        rest = F.struct((run["end"] - F.length(bare)).alias("start"), run["end"].alias("end"), bare.alias("val"))
        parts = []
        for p in PARTS:
            hits = F.regexp_extract_all(val, F.lit(p), F.lit(0))
            parts.append(F.transform(_walk(hits, F.split(val, p, -1), hits, lambda v: F.lit(True)), moved(run["start"])))
        return F.concat(F.filter(F.array(rest, run), lambda x: F.length(x["val"]) >= 20), *parts)

    return F.transform(runs, lambda run: F.array_distinct(of(run)))


def _phi(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation, error under 2e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565988 * z * z * z))


def _battery(span: Column) -> Column:
    """(start, end, evidence, random) of a candidate.

    The encoding is the smallest alphabet that holds the string: decimal, hex, base32, base36, letters,
    base64. Three tests against even use of it: chi-squared of the counts (normal law with the exact
    variance), runs of the upper and the lower half of the alphabet, and serial correlation of neighbours.
    ``random``: none of the three is under ALPHA / 3. evidence: log-likelihood of even use over running
    text. It grows with the length, and exp(-evidence) bounds the chance that running text reaches it.
    """
    s, n = span["val"], F.length(span["val"]).cast("double")
    alphabets = [
        (r"^[0-9]+$", "0123456789"), (r"^[0-9a-f]+$", "0123456789abcdef"), (r"^[0-9A-F]+$", "0123456789ABCDEF"), (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
        (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"), (r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), (r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ]
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")
    for pattern, letters in reversed(alphabets):
        alphabet = F.when(s.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    total = sum(LETTERS.values())
    chance = {c: v / total * (1 - 10 * DIGIT - 5 * SIGN) * (1 - CAPITAL) for c, v in LETTERS.items()}
    chance |= {c.upper(): v * CAPITAL / (1 - CAPITAL) for c, v in chance.items()} | {c: DIGIT for c in "0123456789"} | {c: SIGN for c in "+/_-="}
    logs = F.create_map(*(x for c, v in chance.items() for x in (F.lit(c), F.lit(_ln(v)))))
    zero = F.lit(0.0)
    state = F.struct(*(zero.alias(k) for k in ("last", "runs", "high", "sx", "sxx", "sxy", "text")), F.lit(-1).cast("int").alias("side"))

    def fit(base: Column) -> Column:
        m = F.length(base["alphabet"]).cast("double")

        def step(acc: Column, c: Column) -> Column:
            v = F.greatest(F.position(c, base["alphabet"]) - 1, F.lit(0)).cast("double")
            side = (v * 2 >= m).cast("int")
            return F.struct(
                v.alias("last"), (acc["runs"] + F.when(side != acc["side"], 1.0).otherwise(0.0)).alias("runs"), (acc["high"] + side).alias("high"), (acc["sx"] + v).alias("sx"), (acc["sxx"] + v * v).alias("sxx"),
                (acc["sxy"] + acc["last"] * v).alias("sxy"), (acc["text"] + F.coalesce(F.element_at(logs, c), F.lit(-6.0))).alias("text"), side.alias("side"),
            )

        return F.aggregate(base["chars"], state, step)

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    # bound once: named in the fold, the alphabet would be looked for anew at every character
    base = F.array(F.struct(chars.alias("chars"), alphabet.alias("alphabet")))
    return F.element_at(F.transform(base, lambda b: F.struct(span["start"].alias("start"), span["end"].alias("end"), s.alias("val"), n.alias("n"), b.alias("base"), fit(b).alias("w"))), 1)


def _ln(v: float) -> float:
    import math

    return math.log(v)


def _verdict(c: Column) -> Column:
    """(start, end, evidence, random) from the sums of a candidate."""
    n, w, m = c["n"], c["w"], F.length(c["base"]["alphabet"]).cast("double")
    counts = F.aggregate(F.array_distinct(c["base"]["chars"]), F.lit(0.0), lambda acc, x: acc + F.pow((n - F.length(F.replace(c["val"], x, F.lit("")))).cast("double"), F.lit(2.0)))
    df = m - 1
    chi = m / n * counts - n
    # few characters over many cells spread less than the chi-squared law says; its spread is that of the exact variance
    z_chi = (chi - df) / F.sqrt(2 * df * (n - 1) / n)
    p_chi = _phi(z_chi)
    high, low = w["high"], n - w["high"]
    mean = 2 * high * low / n + 1
    var = F.greatest(2 * high * low * (2 * high * low - n) / (n * n * (n - 1)), F.lit(1e-9))
    p_runs = F.when(high * low > 0, 2 * _phi(F.least(F.abs(w["runs"] - mean) / F.sqrt(var), F.lit(8.0)))).otherwise(0.0)
    sq = w["sx"] * w["sx"]
    serial = (n * w["sxy"] - sq) / F.greatest(n * w["sxx"] - sq, F.lit(1e-9))
    p_serial = 2 * _phi(F.least(F.abs(serial + 1 / n) * F.sqrt(n), F.lit(8.0)))
    even = -n * F.log(m)
    decimal = c["val"].rlike("^[0-9]+$")
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), (even - w["text"]).alias("evidence"), ((F.least(F.least(p_chi, F.lit(1.0)), p_runs, p_serial) >= ALPHA / 3) & ~decimal).alias("random"))


def _apart(base: str, new: str, rank: int) -> Column:
    """Spans of ``new`` that meet none of ``base``: two passes over both in order of place, never span by span.

    On the way up a span meets a base span that begins at or before it if the furthest end so far lies beyond its start; on
    the way down it meets one that begins after it if the nearest start so far lies before its end.
    """
    both, far = F.array_sort(F.concat(base, new)), F.lit(1 << 62).cast("long")
    old = lambda x: x["rank"] < rank

    def sweep(spans: Column, start: Column, edge, clear) -> Column:
        kept = lambda e, x: F.when(old(x) | clear(e, x), F.array(x)).otherwise(F.array().cast(SPANS))
        return _scan(spans, start, lambda e, x: F.when(old(x), edge(e, x)).otherwise(e), kept, SPANS)

    up = sweep(both, F.lit(-1).cast("long"), lambda e, x: F.greatest(e, x["end"]), lambda e, x: e <= x["start"])
    down = sweep(F.reverse(up), far, lambda e, x: F.least(e, x["start"]), lambda e, x: e >= x["end"])
    return F.filter(F.reverse(down), lambda x: ~old(x))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, tried) with the spans of each kind and, for each run, the verdicts of the battery's candidates."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(F.col(text_col)).alias("t"))
    found = t.select("doc_id", *(_matches("t", _QUICK.get(k, p), g, n).alias(k) for k, p, g, n in KINDS), _matches("t", CANDIDATE, 0, 0).alias("runs"))
    each = lambda c, f: F.transform(c, lambda run: F.transform(run, f))
    tried = found.withColumn("sums", each(_candidates(F.col("runs")), _battery)).withColumn("tried", each("sums", _verdict))
    return tried.select("doc_id", "assign", "access", "hex", "tried")


def discovery_bound(tried: DataFrame, rate: float = FDR) -> float:
    """Least evidence at which, by Benjamini and Hochberg's rule over all candidates, ``rate`` of discoveries are false.

    Only counts by bins of evidence leave the executors: at most BINS rows whatever the input.
    """
    e = tried.select(F.explode(F.flatten("tried")).alias("x")).select("x.*")
    bins = e.groupBy(F.least(F.greatest(F.floor(F.col("evidence") * 4), F.lit(-1)), F.lit(BINS)).cast("int").alias("b")).agg(F.count("*").alias("n"), F.count_if("random").alias("r")).collect()
    total, above, bound = sum(x.n for x in bins), 0, float("inf")
    for x in sorted(bins, key=lambda x: -x.b):
        above += x.r
        if above and 2.718281828459045 ** (-x.b / 4) * total <= rate * above:
            bound = x.b / 4
    return bound


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    A null text is an empty one: no spans, and the digest of an empty string. Places are code points, the
    end is exclusive. Spans of kind ``random`` are those of the battery that overlap no other span.
    Null ids are carried, repeated rows give equal rows, other columns are ignored.
    """
    own = cut(scan(docs, id_col, text_col))
    bound = discovery_bound(own, rate)
    kinds = [k for k, *_ in KINDS]
    rank = lambda k, name, c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), F.lit(name).alias("kind")))
    base = F.array_sort(F.concat(*(rank(k, name, F.col(name)) for k, name in enumerate(kinds))))
    none = F.array().cast(SPANS)
    meets = lambda x: lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])
    # of a run's random candidates that overlap the first counts; a run has as many as its parts
    first = lambda run: F.aggregate(rank(len(kinds), "random", F.filter(run, lambda x: x["random"] & (x["evidence"] >= bound))), none, lambda acc, x: F.when(F.exists(acc, meets(x)), acc).otherwise(F.concat(acc, F.array(x))))
    new = F.flatten(F.transform("tried", first))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = own.withColumn("base", base).withColumn("new", new).withColumn("alone", _apart("base", "new", len(kinds)))
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(said("base"), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "alone"))).alias("spans"), F.size("alone").cast("long").alias("n_random"))
