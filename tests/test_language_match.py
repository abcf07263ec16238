"""Language of replies by sentences: quotations don't count, weight decides, open cases stay open."""

from siltwork.operators import language_match as L

ROWS = [
    ("What is the loan for?", "It is for the farm. The loan was big.", "en", "en", True),
    ("What is the loan for?", 'The answer is "la que de los el en" [le la les].', "en", "en", True),
    ("Was ist das und der Preis?", "It is the price of the loan.", "de", "en", False),
    ("Was ist das und der Preis?", "Das ist der Preis und nicht mehr. The end of it.", "de", "de", True),
    ("xyz", "It is the price of the loan.", None, "en", None),
    ("The price of it?", "Xyz abc", "en", None, None),
    ("The price of it?", None, "en", None, None),
    ("ঋণ কত টাকা?", "ঋণ ৫০০ টাকা। সীমা the", "bn", "bn", True),
    ("ঋণ কত টাকা?", "The limit of the loan is here", "bn", "en", False),
    ("The limit is in it. Der Preis und das ist", "The loan", "mixed", "en", None),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, q, r) for i, (q, r, *_) in enumerate(ROWS)], "i int, q string, r string")
    got = {r.i: (r.asked, r.said, r.ok) for r in L.language_match(df, "q", "r").collect()}
    assert got == {i: tuple(w) for i, (_, _, *w) in enumerate(ROWS)}
    assert L.language_match(df.where("false"), "q", "r").count() == 0
