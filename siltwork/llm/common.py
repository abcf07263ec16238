"""Shared pieces of the training-data operators: Arrow text access, word hashing, cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64
#: Bytes of text that one vectorised step takes; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
#: Size of a cut table's files, by the plan's estimate, and files a core that are never merged further.
CUT_BYTES, FILES_A_CORE = 16 << 20, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python; few rows a batch keep the buffers on both sides small. Workers find this package."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def lean(run: Callable) -> Callable:
    """The same task, whose worker gives its memory back at the end: workers live on between tasks and share an executor's limit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return task


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on one machine."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        sc = spark.sparkContext
        got = sc.getCheckpointDir()
        if not got:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltwork-"))
            got = sc.getCheckpointDir()
    return got.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and a lost executor costs nothing.

    Small files cost more than they save, so a table has no more files than one for each CUT_BYTES of the plan's
    estimate, or FILES_A_CORE for each core where that is more; both tasks and files grow with the data.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltwork-{uuid.uuid4().hex}"
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = min(max(FILES_A_CORE * spark.sparkContext.defaultParallelism, size // CUT_BYTES), 1 << 24)
    df.coalesce(files).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty texts."""
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def steps(offs: np.ndarray, most: int = STEP_BYTES):
    """Row ranges of at most that many bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((_B, _BI)):
            a = np.full(size, b, U64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0][:n], _POW[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and each row's offsets in them."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    low = _FOLD[data]
    word = ~_WS[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    p, q = _powers(n)
    c = np.empty(n + 1, U64)
    c[0] = 0
    np.cumsum((low.astype(U64) + U64(1)) * p, out=c[1:])
    h = (c[ends] - c[starts]) * q[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offs)


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words are one shingle, none an empty set."""
    n = len(words)
    whole = words.copy()
    if n >= k:
        s = words[: n - k + 1].copy()
        for j in range(1, k):
            s = mix64(s * U64(0x9FB21C651E98DF25) + words[j : n - k + 1 + j])
        whole[: n - k + 1] = s
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            x = words[a : a + 1]
            for j in range(a + 1, b):
                x = mix64(x * U64(0x9FB21C651E98DF25) + words[j])
            out.append(mix64(x + U64(b - a)))
        else:
            out.append(words[:0])
    return out


def text_sets(col: pa.Array, k: int):
    """Yields (row, sorted shingle set) over a string column, in steps of bounded size."""
    data, offs = buffers(col)
    for i, j in steps(offs):
        words, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for r, s in enumerate(shingle_sets(words, at, k)):
            yield i + r, s


def ids_of(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)
