"""Plug-points: an encoder and a judge given by the caller, called in batches over Arrow; what fails is a column, not a job.

Nothing here is called unless a query asks for it. The functions are the caller's: a model, a service, a rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from ..plans.session import ship

#: Texts of one call.
BATCH = 64
Encoder = Callable[[Sequence[str]], np.ndarray]
Judge = Callable[[Sequence[tuple[str, str]]], Sequence[bool | None]]


def _each(call: Callable, items: list, size: int) -> Iterator[tuple[object, str | None]]:
    """(result, failure) of each item: a batch that fails is called again item by item, so that one bad item spoils no other."""
    for at in range(0, len(items), size):
        part = items[at : at + size]
        try:
            got = list(call(part))
            if len(got) != len(part):
                raise ValueError(f"{len(got)} results for {len(part)} items")
            yield from ((x, None) for x in got)
        except Exception as e:  # noqa: BLE001  whatever the caller's function raises is that item's failure
            if len(part) == 1:
                yield None, f"{type(e).__name__}: {e}"
            else:
                yield from _each(call, part, 1)


def _with(df: DataFrame, new: list[S.StructField], inputs: list[str], make: Callable[[list[list]], list[pa.Array]]) -> DataFrame:
    """df with new columns made from some of its own, batch by batch; a clash of names is an error."""
    taken = {f.name for f in new} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make([b.column(c).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, S.StructType([*df.schema.fields, *new]))


def encode(df: DataFrame, text: str, encoder: Encoder, into: str = "embedding", batch: int = BATCH) -> DataFrame:
    """df with a unit vector of each text, and `{into}_failure`, null where it worked. Null texts have neither; a zero vector stays zero."""

    def unit(v) -> list[float]:
        v = np.asarray(v, np.float64)
        n = float(np.sqrt((v * v).sum()))
        if not np.isfinite(n):
            raise ValueError("a vector is not finite")
        return (v / n if n else v).astype(np.float32).tolist()

    def make(cols: list[list]) -> list[pa.Array]:
        texts = cols[0]
        here = [k for k, t in enumerate(texts) if t is not None]
        out, failed = [None] * len(texts), [None] * len(texts)
        for k, (v, e) in zip(here, _each(lambda xs: [unit(v) for v in encoder(xs)], [texts[k] for k in here], batch), strict=True):
            out[k], failed[k] = v, e
        return [pa.array(out, pa.list_(pa.float32())), pa.array(failed, pa.string())]

    return _with(df, [S.StructField(into, S.ArrayType(S.FloatType())), S.StructField(f"{into}_failure", S.StringType())], [text], make)


def judge(df: DataFrame, fact: str, answer: str, rule: Judge, into: str = "holds", batch: int = BATCH) -> DataFrame:
    """df with whether each answer states its fact (null: undecided), and `{into}_failure`. A null fact or answer is undecided."""

    def make(cols: list[list]) -> list[pa.Array]:
        pairs = list(zip(*cols, strict=True))
        here = [k for k, p in enumerate(pairs) if None not in p]
        out, failed = [None] * len(pairs), [None] * len(pairs)
        for k, (v, e) in zip(here, _each(rule, [pairs[k] for k in here], batch), strict=True):
            out[k], failed[k] = None if v is None else bool(v), e
        return [pa.array(out, pa.bool_()), pa.array(failed, pa.string())]

    return _with(df, [S.StructField(into, S.BooleanType()), S.StructField(f"{into}_failure", S.StringType())], [fact, answer], make)
