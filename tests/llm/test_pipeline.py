"""The pipeline stage by stage against plain forms of what each stage must drop."""

import corpus_pipeline as C
from siltwork.llm import decontamination as D

from . import fixtures as fx


def test_stages_of_the_table(spark):
    docs = fx.table(spark, "documents")
    assert [k for k, _ in C.STAGES] == ["toxicity", "exact_duplicates", "near_duplicates", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    clean = C.toxicity(spark, docs, fx.SF).cache()
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    labels = {r.doc_id: r.toxic for r in fx.table(spark, "labels").collect()}
    assert not [i for i in rows if i not in left and labels.get(i) == 0]

    once = C.exact_duplicates(spark, clean, fx.SF).cache()
    best = {}
    for i, t in left.items():
        best[fx.fold(t)] = max(i, best.get(fx.fold(t), i))
    assert {r.doc_id for r in once.collect()} == set(best.values()) and once.columns == docs.columns

    near = C.near_duplicates(spark, once, fx.SF).cache()
    _, comp = fx.components([(i, left[i]) for i in best.values()], 5, 80)
    assert {r.doc_id for r in near.collect()} == {i for i, c in comp.items() if i == c}

    done = C.decontamination(spark, near, fx.SF).cache()
    items = [D.normal(r.text) for r in fx.table(spark, "benchmark").collect()]
    kept = {r.doc_id for r in done.collect()}
    assert not [i for i in kept if any(s in D.normal(left[i]) for s in items)]
    packed = C.packing(spark, done, fx.SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_run_is_the_stages_in_turn(spark):
    got = C.run(spark, fx.SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (fx.odd_docs(spark), fx.no_docs(spark)):
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, fx.SF)
            assert docs.columns == fx.odd_docs(spark).columns
            docs = docs.cache()
            docs.count()
        C.packing(spark, docs, fx.SF).count()
