"""Typed values and audits against plain forms."""

import random
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from siltwork.functions import figures as N
from siltwork.operators import quiz


def plain_values(text, lang):
    t = unicodedata.normalize("NFC", text or "")
    if lang == "en":
        t = re.sub("[ঀ-৿]+", " ", t)
    t = t.translate(str.maketrans("০১২৩৪৫৬৭৮৯", "0123456789"))
    clauses = re.findall(r"[0-9]+(?:\.[0-9]+){2,}", t)
    t = re.sub(r"[0-9]+(?:\.[0-9]+){2,}", " ", t)
    t = re.sub(r"([0-9]+)(?:st|nd|rd|th)\b" if lang == "en" else "([0-9]+)(?:ম|য়|র্থ|ষ্ঠ)", r"\1 ", t)
    t = re.sub(r"(?<=[0-9]),(?=[0-9])", "", t)
    words = dict(N.MULTIPLIERS[lang])
    out = []
    for m in re.finditer(rf"([0-9]+(?:\.[0-9]+)?)(?:\s*({'|'.join(words)}))?", t):
        n = Decimal(m[1]).quantize(Decimal("0.0001"), ROUND_HALF_UP) * words.get(m[2], 1)
        said = f"{n:.4f}".rstrip("0").rstrip(".")
        out.append(said)
    return sorted(out + clauses)


def test_values_against_the_plain_form(spark):
    rng = random.Random(3)
    bits = ["1", "20", "1,50,000", "3.5", "1.2.2", "২০", "১ম", "4th", "2nd ", "thousand", " lakh", "crores", "হাজার", " কোটি", "য়", " ", ", ", "-", "text", "1.25.3.4", "0.00004", "12.34567", "ম", "(", "é"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))) for i in range(800)] + [(-1, None), (-2, ""), (-3, "৫ হাজার ৩য় 1.2.3"), (-4, "1," * 50_000 + "1"), (-5, "1." * 50_000)]
    df = spark.createDataFrame(rows, "i int, s string")
    for lang in ("bn", "en"):
        got = {r.i: r.v for r in df.select("i", N.values("s", lang).alias("v")).collect()}
        for i, s in rows[:-2]:
            assert got[i] == plain_values(s, lang), (s, lang)


def test_surplus_counts_repeats(spark):
    r = spark.createDataFrame([(["1", "1", "2", "5"], ["1", "5", "7"])], "a array<string>, b array<string>").select(N.surplus(F.col("a"), F.col("b")).alias("x"), N.surplus(F.col("b"), F.col("a")).alias("y")).first()
    assert (r.x, r.y) == (["1", "2"], ["7"])


def test_audit(spark):
    rows = [("500-100000 taka", ["range_digit_count_mismatch"]), ("900 – 100", ["range_inverted"]), ("100-900", []), ("120%", ["magnitude_implausible"]), ("৫০ টাকা", ["magnitude_implausible"]), ("৫০০ টাকা, 5%", []), (f"{'9' * 50}%", ["magnitude_implausible"]), (f"{'8' * 60}-{'7' * 60}", ["range_inverted"]), (None, [])]
    got = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string").select("i", N.audit("s").alias("a")).collect()
    assert {r.i: [x.issue for x in r.a] for r in got} == {i: w for i, (_, w) in enumerate(rows)}


def test_range_end_looks_at_every_use(spark):
    rows = [("5 taka", "5 taka is paid; then 5 taka - 9 taka", True), ("5 taka", "5 taka is paid, 5 taka more", False), ("9 taka", "9 taka here. 5 - 9 taka", True), ("5 taka", "from 5 taka to page 9", False), ("", "x", False), ("5", "", False)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string").select("i", quiz.range_end(F.col("a"), F.col("b"), "taka|month").alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: w for i, (*_, w) in enumerate(rows)}
