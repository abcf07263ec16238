"""Every query of the library against its SQL on the smallest tables, and negative controls that must differ."""

import datetime
import decimal
import math

import pytest

import siltwork.queries as library
from importlib import import_module

SF = "/root/testdata/sf0.001"
MODULES = [import_module(f"siltwork.queries.{m}") for m in library.MODULES]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date()
    return v


def rows(names, found):
    return sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in found), key=repr)


def test_names_are_of_one_kind_each():
    assert set(ORACLE) <= set(QUERIES)
    assert sum(len(m.QUERIES) for m in MODULES) == len(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, r.fetchall())


def test_recall_at_k_takes_ranks_from_the_dense_search(spark):
    """No row a pair of query and point: the pairs are scored in blocks, and a task gives out its best rows."""
    plan = QUERIES["agg11_recall_at_k"](spark, SF)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan
