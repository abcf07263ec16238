"""Exact deduplication by Grace hashing: partition by digest, recurse through spill files, compare whole contents."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, LOWER, lower_ascii, small_batches, UPPER

FANOUT_BITS = 4
#: Bytes of content that one in-memory table may hold before its bucket is split over spill files.
TABLE_BYTES = 32 << 20
_FOLD = str.maketrans(UPPER, LOWER)


class OpenTable:
    """Open addressing with linear probing; equal means equal in every byte of the content."""

    def __init__(self, level: int):
        self.shift = level * FANOUT_BITS
        self.slots = np.full(1 << 10, -1, np.int64)
        self.rows: list[list] = []
        self.bytes = 0

    def _home(self, digest: bytes) -> int:
        return (int.from_bytes(digest[:16], "big") << self.shift >> 60) & 0xFFFFFFFFFFFFFFF

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 4, -1, np.int64)
        last = len(self.slots) - 1
        for k, row in enumerate(self.rows):
            at = self._home(row[0]) & last
            while self.slots[at] >= 0:
                at = (at + 1) & last
            self.slots[at] = k

    def add(self, digest: bytes, content: bytes, best: int | None, count: int) -> None:
        if len(self.rows) * 2 >= len(self.slots):
            self._grow()
        last, slots = len(self.slots) - 1, self.slots
        at = self._home(digest) & last
        while (k := int(slots[at])) >= 0:
            row = self.rows[k]
            if row[0] == digest and row[1] == content:
                row[2] = best if row[2] is None or (best is not None and best > row[2]) else row[2]
                row[3] += count
                return
            at = (at + 1) & last
        slots[at] = len(self.rows)
        self.rows.append([digest, content, best, count])
        self.bytes += len(content) + 200


class GraceDedup:
    """Groups records by whole content in bounded memory.

    Records go to one open-addressing table until its contents pass ``limit`` bytes; then table and
    later records are dealt over 16 spill files by the next four bits of the digest, and each file is
    grouped in the same way. A table with a single content is never split, so copies, however many,
    and contents longer than the limit end the recursion. ``unique``: stop where two contents have one digest.
    """

    def __init__(self, limit: int = TABLE_BYTES, level: int = 0, unique: bool = False):
        self.limit, self.level, self.unique = limit, level, unique
        self.table: OpenTable | None = OpenTable(level)
        self.dir: tempfile.TemporaryDirectory | None = None
        self.files: list = []

    def add(self, digest: bytes, content: bytes, best: int | None, count: int) -> None:
        if self.table is not None:
            self.table.add(digest, content, best, count)
            if self.table.bytes > self.limit and len(self.table.rows) > 1 and self.level < 60:
                self._spill()
        else:
            pickle.dump((digest, content, best, count), self.files[self._bucket(digest)], 5)

    def _bucket(self, digest: bytes) -> int:
        byte = digest[self.level // 2]
        return byte >> 4 if self.level % 2 == 0 else byte & 15

    def _spill(self) -> None:
        self.dir = tempfile.TemporaryDirectory(prefix="grace-")
        self.files = [open(os.path.join(self.dir.name, f"{k:x}"), "w+b") for k in range(1 << FANOUT_BITS)]
        for row in self.table.rows:
            pickle.dump(tuple(row), self.files[self._bucket(row[0])], 5)
        self.table = None

    def groups(self) -> Iterator[list]:
        """[digest, content, largest id, rows] of each distinct content."""
        try:
            if self.table is not None:
                # rows of one digest are never dealt to different tables, so this sees every collision
                if self.unique and len({r[0] for r in self.table.rows}) < len(self.table.rows):
                    raise RuntimeError("two contents share a SHA-256 digest; they can't be told apart by it")
                yield from self.table.rows
                return
            while self.files:
                f = self.files.pop()
                with f:
                    f.seek(0)
                    part = GraceDedup(self.limit, self.level + 1, self.unique)
                    try:
                        while True:
                            try:
                                row = pickle.load(f)
                            except EOFError:
                                break
                            part.add(*row)
                        os.unlink(f.name)
                        yield from part.groups()
                    finally:
                        part.close()
        finally:
            self.close()

    def close(self) -> None:
        for f in self.files:
            f.close()
        self.files = []
        if self.dir is not None:
            self.dir.cleanup()
            self.dir = None


_GROUPS = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("best", pa.int64()), ("rows", pa.int64())])


def _out(rows: list[list], names: list[str]) -> pa.RecordBatch:
    cols = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_GROUPS)]
    batch = pa.RecordBatch.from_arrays(cols, schema=_GROUPS)
    return batch.select(names)


def _emit(grace: GraceDedup, names: list[str]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in grace.groups():
        rows.append(row)
        size += len(row[1])
        if size > 4 << 20 or len(rows) >= 10_000:
            yield _out(rows, names)
            rows, size = [], 0
    if rows:
        yield _out(rows, names)


def _local(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grace = GraceDedup(limit)
        try:
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    content = (text.as_py() or "").translate(_FOLD).encode("utf-8", "surrogatepass")
                    grace.add(hashlib.sha256(content).digest(), content, i, 1)
            yield from _emit(grace, _GROUPS.names)
        finally:
            grace.close()

    return run


def _global(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grace, names = GraceDedup(limit, unique=True), ["digest", "best", "rows"]
        try:
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    grace.add(*(v.as_py() for v in row))
            for batch in _emit(grace, names):
                keep = np.flatnonzero(batch.column(2).to_numpy() > 1)
                yield batch.take(pa.array(keep))
        finally:
            grace.close()

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(digest binary, best, rows) of every content that more than one row has.

    Each map task first groups its own rows, so a content crosses the shuffle once per task however
    many copies there are; the shuffle by digest is the first Grace partitioning.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    local = rows.mapInArrow(lean(_local(table_bytes)), "digest binary, content binary, best long, rows long")
    return local.repartition("digest").mapInArrow(lean(_global(table_bytes)), "digest binary, best long, rows long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The row with the
    largest id stays; a null id is less than any other, and stays where all of a group are null. Rows
    that repeat the staying id are all kept. An empty table gives an empty result; other columns are
    ignored, so none can clash.
    """
    groups = exact_groups(docs, id_col, text_col, table_bytes).select(F.lower(F.hex("digest")).alias("g_sha"), "best", "rows")
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(lower_ascii(F.col(text_col).cast("string")), 256).alias("text_sha256"))
    j = mine.join(groups, mine.text_sha256 == groups.g_sha, "left")
    keep = F.when(F.col("g_sha").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return j.select("doc_id", keep.alias("keep_id"), F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


OP9_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
