"""Documents with every odd case, and plain brute-force forms of the contracts."""

import re
import zlib

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns whose names the operators use inside.
EXTRA = "id string, t string, i long, label int, rep long, key long, bands int, score double, word string, c int, row string, host string, digest string, lines int"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(fold(text))


def odd_rows():
    long = "lorem ipsum dolor sit amet " * 8000
    return [(None, "no id at all"), (1, None), (2, ""), (3, " \n\t "), (4, "Alpha beta gamma delta epsilon"), (5, "alpha BETA gamma delta epsilon"), (6, long), (7, "single"), (8, "word\x1cjoined ünïcödé É"), (4, "Alpha beta gamma delta epsilon")]


def odd_docs(spark):
    extra = [f.split()[1] for f in EXTRA.split(", ")]
    fill = {"string": "x", "long": 1, "int": 1, "double": 0.5}
    rows = [(i, t, *(fill[k] for k in extra)) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA)


def no_docs(spark):
    return odd_docs(spark).where("false")


def held(i, parts):
    return zlib.crc32(str(i).encode()) % parts == 0


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts(spark):
    return [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent):
    """(links, component of each id) by comparing all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for n, (a, x) in enumerate(sets):
        for b, y in sets[n + 1 :]:
            inter = len(x & y)
            if inter and 100 * inter >= percent * (len(x) + len(y) - inter):
                links += 1
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return links, {i: find(i) for i, _ in rows}
