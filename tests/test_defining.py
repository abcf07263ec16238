"""Which chunk defines a name: each piece of evidence, the crowd rule, ties, names that are only mentioned."""

from siltwork.operators import defining as D

CHUNKS = [
    (1, 1, "Goti loan", "Goti loan is for farms", False),
    (2, 2, "About goti loan rates", "rates here", False),
    (3, 3, "Goti loan, big loan, farm loan", "all of them", False),
    (4, 4, "Limits", "a) big loan: for houses", False),
    (5, 5, "Limits", "see\nb) farm loan\nnext", False),
    (6, 6, "Changes", "farm loan: new, it is other", True),
    (7, 7, "Other", "a word on the gold loan here", False),
    (8, 8, "Limits", "big loan: again for houses", False),
    (9, 9, None, None, None),
]
CHUNK_COLUMNS = "id int, ord int, head string, body string, is_table boolean"
NAMES = [("g", "goti loan"), ("b", "big loan"), ("f", "farm loan"), ("z", "gold loan"), ("n", "never said"), ("g", "goti")]


def test_defining_chunks(spark):
    c = spark.createDataFrame(CHUNKS, "id int, ord int, head string, body string, is_table boolean")
    n = spark.createDataFrame(NAMES, "name_id string, alias string")
    rules = (r"\bis\b", "changes", "^intro")
    got = {(r.name_id, r.id): (r.score, r.why) for r in D.evidence(c, n, *rules).collect()}
    assert got["g", 1] == (8, ["own heading", "heading ends with it", "verb"])
    assert got["g", 2] == (4, ["own heading"])
    assert got["g", 3] == (0, [])
    assert got["b", 4] == (3, ["label"]) and got["f", 5] == (3, ["list item"]) and got["z", 7] == (0, [])
    assert got["f", 6] == (0, ["label", "verb", "table", "changes"])
    best = {r.name_id: (r.id, r.score) for r in D.defining_chunks(c, n, *rules).collect()}
    assert best == {"g": (1, 8), "b": (4, 3), "f": (5, 3), "z": (None, None), "n": (None, None)}
    assert D.defining_chunks(c.where("false"), n, *rules).where("id is not null").count() == 0


def test_a_chunk_meets_its_names_in_one_row(spark):
    """Runs that are no name are not written, and a body is not copied for each of its names."""
    body = " ".join(f"alpha{k} beta{k}" for k in range(300))
    c = spark.createDataFrame([(1, 1, "Limits", body, False)], CHUNK_COLUMNS)
    n = spark.createDataFrame([(f"n{k}", f"alpha{k} beta{k}") for k in range(300)], "name_id string, alias string")
    assert D.postings(c, n).count() == 300
    assert "explode" not in D.postings(c, n)._jdf.queryExecution().toString().lower()
    e = D.evidence(c, n, "^ alpha1 ", "changes", "^intro")
    assert sorted((r.name_id, r.score) for r in e.where("score > 0").collect()) == [("n0", 2)]
    assert "instr(lower" not in e._jdf.queryExecution().optimizedPlan().toString()
