"""Language-model scores by online logistic context mixing over the bits of a text, beside corpus-wide word counts."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, small_batches

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Distinct words that a counting task holds before it gives out partial counts.
HELD_WORDS = 500_000
#: The most frequent words travel to every task; all others are joined.
HEAD_WORDS = 50_000
END = b""
#: Bytes before the one predicted that a predictor knows.
ORDERS = (2, 4, 6)
#: Bits of the predictors' tables, at most: each has a slot for every byte of training text up to that bound, which keeps what is
#: broadcast under 16 MB. Short contexts have fewer values.
BITS, MIN_BITS = (18, 22, 22), 12
#: Training text of a counting task: as little as SMALL_TASK while cores are free, else LARGE_TASK. Partial counts added at once.
SMALL_TASK, LARGE_TASK, FAN = 32 << 20, 256 << 20, 64
#: Added to both counts of a bit; a predictor says log-odds in steps of 1 / SCALE, and is sure from SURE on.
DELTA, SCALE, SURE = 0.1, 16.0, 2.0
#: First weight of a predictor, and learning rates of weights and of refined probabilities. Both begin anew after SEGMENT bytes of
#: a text, so that long texts are mixed in parallel.
FIRST, RATE, REFINE, SEGMENT = 0.3, 0.015, 0.02, 2048
#: Decisions after which the weights learn; a refined probability then learns from the last of them that it was used for.
SPAN = 16
GATES, CELLS = len(ORDERS) + 1, 33
#: Bytes of text that are mixed together.
_STEP, _TRAIN_STEP = 1 << 21, 1 << 22
_CHUNK = 1 << 16


def words(text: bytes) -> list[bytes]:
    """Words between white space, which is \\x20 and \\x09-\\x0D and nothing else, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def stream(tokens: list[bytes]) -> bytes:
    """What the mixer reads of a text: its words with one blank between them, and the end."""
    return b" ".join(tokens) + b"\n"


class Code:
    """Bytes as paths of a binary tree: a Huffman code by the training texts' bytes, so that frequent bytes take few decisions.

    A byte that never came counts as one, so every text has a path.
    """

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        sons: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            sons[node] = (a, b)
            heapq.heappush(heap, (x + y, node, node))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        todo = [(510, [])]
        while todo:
            node, path = todo.pop()
            if node < 256:
                paths[node] = path
            else:
                todo += [(son, [*path, (node - 255, bit)]) for bit, son in enumerate(sons[node])]
        self.size = np.array([len(p) for p in paths], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.turn = np.array([n for p in paths for n, _ in p], np.uint32) * np.uint32(0x9E3779B1)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)


class Streams:
    """Some streams, one after the other, and the hashes of the predictors' contexts."""

    def __init__(self, streams: list[bytes]):
        self.data = np.frombuffer(b"".join(streams), np.uint8)
        sizes = [len(s) for s in streams]
        self.texts = np.cumsum(sizes) - sizes

    def contexts(self) -> list[np.ndarray]:
        """For each predictor the hash of its context at every byte."""
        history = self.data.astype(np.uint32) + np.uint32(1)
        h, known, out = np.zeros(len(self.data), np.uint32), 0, []
        for order in ORDERS:
            while known < order:
                last = history
                history = np.empty_like(last)
                history[0], history[1:] = 0, last[:-1]
                history[self.texts] = 0
                h, known = (h ^ history) * np.uint32(0x01000193) + np.uint32(0x9E3779B9), known + 1
            out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D))
        return out


def _turns(code: Code, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of decisions of each byte, where they begin, and of each decision the hash of its node and the bit."""
    size = code.size[data]
    at = np.concatenate([[0], np.cumsum(size)])
    pick = np.arange(at[-1], dtype=np.int32) + np.repeat((code.first[data] - at[:-1]).astype(np.int32), size)
    return size, at, code.turn[pick], code.bit[pick]


def _slots(hashes: np.ndarray, size: np.ndarray, turn: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each decision of bytes in these contexts."""
    return _mixed(np.repeat(hashes, size), turn, bits)


def _mixed(x: np.ndarray, turn: np.ndarray, bits: int) -> np.ndarray:
    x += turn
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x >>= np.uint32(32 - bits)
    return x


class Decisions(Streams):
    """The binary decisions of some streams and what the predictors' tables say of them."""

    def __init__(self, streams: list[bytes], code: Code, bits: tuple[int, ...]):
        super().__init__(streams)
        self.code, self.bits = code, bits
        self.size = code.size[self.data]
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    @cached_property
    def bit(self) -> np.ndarray:
        return _turns(self.code, self.data)[3]

    def slots(self, block: int) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(predictor, decisions, their slots), in blocks of bytes."""
        hashes, turn = self.contexts(), _turns(self.code, self.data)[2]
        for lo in range(0, len(self.data), block):
            hi = min(lo + block, len(self.data))
            here, size = slice(int(self.at[lo]), int(self.at[hi])), self.size[lo:hi]
            for k, (h, bits) in enumerate(zip(hashes, self.bits, strict=True)):
                yield k, here, _slots(h[lo:hi], size, turn[here], bits)

    def said(self, tables: list[np.ndarray], block: int) -> np.ndarray:
        """Of each decision four bytes in one word, fetched at once: the predictors' log-odds, and the bit last. In blocks of bytes whose arrays stay in a core's cache."""
        hashes, out = self.contexts(), np.zeros((int(self.at[-1]), 4), np.int8)
        for lo in range(0, len(self.data), block):
            hi = min(lo + block, len(self.data))
            first, end = int(self.at[lo]), int(self.at[hi])
            owner = np.repeat(np.arange(hi - lo), self.size[lo:hi])
            pick = (self.code.first[self.data[lo:hi]] - self.at[lo:hi]).take(owner)
            pick += np.arange(first, end)
            turn = self.code.turn.take(pick)
            out[first:end, 3] = self.code.bit.take(pick)
            for k, (h, bits, table) in enumerate(zip(hashes, self.bits, tables, strict=True)):
                out[first:end, k] = table.take(_mixed(h[lo:hi].take(owner), turn, bits))
        return out.view(np.int32).reshape(-1)


class Mixer:
    """Bit predictors' log-odds by slot, mixed by gated weights that learn as a text goes on.

    Every SPAN decisions the weights learn from them all. The gate is the number of predictors that are
    sure of the first of these. A table of refined probabilities by gate
    and mixed probability learns along; the mean of mixed and refined probability is the decision's.
    """

    def __init__(self, code: Code, bits: tuple[int, ...], tables: list[np.ndarray]):
        self.code, self.bits, self.tables = code, bits, tables
        grid = (np.arange(CELLS) - CELLS // 2) / 2.0
        self.refined = np.tile(1 / (1 + np.exp(-grid)), GATES).astype(np.float32)
        self.weights = np.full((GATES, len(ORDERS)), FIRST / SCALE, np.float32)

    def log10(self, streams: list[bytes]) -> np.ndarray:
        """log10 of the probability of each stream."""
        out, lo = [], 0
        while lo < len(streams):
            hi, size = lo, 0
            while hi < len(streams) and (hi == lo or size + len(streams[hi]) <= _STEP):
                size += len(streams[hi])
                hi += 1
            out.append(self._log10(streams[lo:hi]))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0)

    def _log10(self, streams: list[bytes]) -> np.ndarray:
        d = Decisions(streams, self.code, self.bits)
        said = d.said(self.tables, 1 << 15)
        # lanes: stretches of SEGMENT bytes of one text, longest first
        text = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(d.texts, [*d.texts[1:], len(d.data)], strict=True)])
        stop = np.append(text[1:], len(d.data))
        owner = np.searchsorted(d.texts, text, side="right") - 1
        first, count = d.at[text], d.at[stop] - d.at[text]
        order = np.argsort(-count, kind="stable")
        first, count, owner = first[order], count[order], owner[order]
        # arrays below are (decision of the span, lane)
        lanes, span = len(first), np.arange(SPAN)[:, None]
        weights, refined = np.tile(self.weights, (lanes, 1)), np.append(np.tile(self.refined, lanes), np.float32(0.5))
        cost, w0, r0 = np.zeros(lanes), np.arange(lanes) * GATES, np.arange(lanes) * (GATES * CELLS) + CELLS // 2
        for done in range(0, int(count[0]), SPAN):
            n = int(np.searchsorted(-count, -done, side="left"))
            at = first[:n] + (done + span)
            here = said.take(at, mode="clip").view(np.int8).reshape(SPAN, n, 4)
            *x, bit = (here[:, :, k].astype(np.float32) for k in range(4))
            gate = sum((np.abs(v[0]) >= SURE * SCALE).astype(np.int64) for v in x)
            pick = w0[:n] + gate
            w = weights.take(pick, axis=0).T
            dot = x[0] * w[0]
            for v, u in zip(x[1:], w[1:], strict=True):
                dot += v * u
            np.clip(dot, -7.9, 7.9, out=dot)
            p = 1 / (1 + np.exp(-dot))
            cell = (r0[:n] + gate * CELLS) + np.rint(dot * 2).astype(np.int64)
            lost = bit - p
            if count[n - 1] < done + SPAN:  # a lane ends within the span
                over = done + span >= count[:n]
                cell[over], lost[over] = len(refined) - 1, 0
            r = refined.take(cell)
            chance = p + r
            chance *= np.float32(0.5)
            chance += bit
            chance -= 1
            np.abs(chance, out=chance)
            if count[n - 1] < done + SPAN:
                chance[over] = 1
            # no chance is under 1e-4, so that eight of them are a normal float32
            for part in (chance[lo : lo + 8] for lo in range(0, SPAN, 8)):
                cost[:n] += np.log(np.multiply.reduce(part, axis=0))
            refined[cell] = r + (bit - r) * np.float32(REFINE)
            weights[pick] = (w + np.stack([(lost * v).sum(axis=0) for v in x]) * np.float32(RATE / SCALE**2)).T
        return np.bincount(owner, cost / math.log(10), len(streams))


def _raw(col: pa.Array) -> pa.Array:
    return col.cast(pa.binary())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts with their number; partial counts leave whenever there are many."""
    got: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()).cast(pa.string()), pa.array(list(got.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in _raw(batch.column(0)):
            got.update(words(text.as_py()))
            got[END] += 1
        if len(got) > HELD_WORDS:
            yield out()
            got.clear()
    if got:
        yield out()


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the training streams, from their words' counts."""
    total = np.zeros(256, np.int64)
    for batch in batches:
        n = batch.column(1).to_numpy()
        col = _raw(batch.column(0))
        size = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1])
        data = np.frombuffer(b"".join(w.as_py() for w in col), np.uint8)
        total += np.bincount(data, np.repeat(n, size), 256).astype(np.int64)
        total[32] += int(n[size > 0].sum())
        total[10] += int(n[size == 0].sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])


def count_bits(streams: list[bytes], code: Code, bits: tuple[int, ...], total: list[np.ndarray]) -> None:
    """Add the decisions of the streams to ``total``, each predictor's (slots, 2) counts of the bit 0 and the bit 1."""
    s = Streams(streams)
    for k, h in enumerate(s.contexts()):
        # equal bytes in equal contexts decide alike: counted first, their decisions are made once
        key = h.astype(np.uint64) << np.uint64(8) | s.data
        key.sort()
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        key, n = key[last], np.diff(last, prepend=-1).astype(np.uint32)
        size, _, turn, bit = _turns(code, (key & np.uint64(255)).astype(np.uint8))
        slot = _slots((key >> np.uint64(8)).astype(np.uint32), size, turn, bits[k]).astype(np.int64)
        np.add.at(total[k].reshape(-1), slot * 2 + bit, np.repeat(n, size))


def stretch(total: np.ndarray) -> np.ndarray:
    """Log-odds of the counts (..., 2) in steps of 1 / SCALE; 0 where nothing was counted."""
    odds = np.log((total[..., 1] + DELTA) / (total[..., 0] + DELTA))
    said = np.clip(np.rint(odds * SCALE), -127, 127).astype(np.int8)
    seen = total.any(axis=-1)
    return np.where(seen & (said == 0), np.int8(1), said)


def _train(code: Code, bits: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = [np.zeros((1 << b, 2), np.uint32) for b in bits], [], 0
        for batch in batches:
            for text in _raw(batch.column(0)):
                held.append(stream(words(text.as_py())))
                size += len(held[-1])
                if size > _TRAIN_STEP:
                    count_bits(held, code, bits, total)
                    held, size = [], 0
        if held:
            count_bits(held, code, bits, total)
        task = TaskContext.get().partitionId()
        for k, counts in enumerate(total):
            for lo in range(0, len(counts), _CHUNK):
                part = counts[lo : lo + _CHUNK].astype(np.int64)
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lo], pa.int64()), pa.array([task], pa.int32()), pa.array([_packed(part)], pa.binary())], _PART)

    return run


_PART = ["predictor", "lo", "task", "part"]
_PART_TYPE = "predictor int, lo long, task int, part binary"


def _packed(counts: np.ndarray) -> bytes:
    """Counts by planes of bytes; the high ones, mostly 0, lie together and shrink to nothing on the way."""
    return np.ascontiguousarray(counts.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1, 2)


def _add_parts(key, parts):
    """The sum of at most FAN partial counts of one stretch of slots."""
    total = sum(_unpacked(raw.as_py()) for raw in parts["part"])
    cols = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([key[2].as_py()], pa.int32()), pa.array([_packed(total)], pa.binary())]
    return pa.Table.from_arrays(cols, _PART)


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [stretch(_unpacked(raw.as_py())).tobytes() for raw in batch.column("part")]
        yield pa.RecordBatch.from_arrays([batch.column("predictor"), batch.column("lo"), batch.column("task"), pa.array(said, pa.binary())], _PART)


def _read(head, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mixer = head.value, model.value
        get = known.get
        for batch in batches:
            out: list[list] = [[] for _ in range(3)]
            tail_words, tail_n, ends, streams = [], [], [0], []
            for text in _raw(batch.column("t")):
                tokens = words(text.as_py())
                streams.append(stream(tokens))
                base, seen = 0.0, 0
                tf = Counter(tokens)
                tf[END] = 1
                for w, n in tf.items():
                    price = get(w)
                    if price is not None:
                        base += n * price
                        seen += n
                    else:
                        tail_words.append(w)
                        tail_n.append(n)
                ends.append(len(tail_words))
                for c, v in zip(out, (len(tokens) + 1, base, seen), strict=True):
                    c.append(v)
            tail = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()).cast(pa.string()), pa.array(tail_n, pa.int32())], ["word", "tf"])
            cols = [pa.array(c, k) for c, k in zip((*out, mixer.log10(streams)), (pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)]
            keep = ["rid", "doc_id", "held_out", "n_bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)], [*keep, "n_tokens", "base", "n_known", "score", "tail"])

    return run


def table_bits(size: int) -> tuple[int, ...]:
    """Bits of each table for so many bytes of training text."""
    return tuple(min(b, max(size.bit_length(), MIN_BITS)) for b in BITS)


def fitted(train: DataFrame, known: DataFrame) -> Mixer:
    """The mixer with the bit counts of all training texts. The byte code follows their words' counts."""
    spark, counts = train.sparkSession, np.zeros(256, np.int64)
    for r in known.select("word", "c").mapInArrow(lean(_count_bytes), "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r.byte] = r.n
    code, size = Code(counts), int(counts.sum())
    bits = table_bits(size)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-size // SMALL_TASK)), -(-size // LARGE_TASK))
    parts = train.coalesce(tasks).mapInArrow(lean(_train(code, bits)), _PART_TYPE)
    while True:  # sums of sums, so that no group holds more than FAN parts
        parts = parts.groupBy("predictor", "lo", F.floor(F.col("task") / FAN).cast("int").alias("g")).applyInArrow(_add_parts, _PART_TYPE)
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
    tables = [np.zeros(1 << b, np.int8) for b in bits]
    for r in parts.mapInArrow(lean(_said), _PART_TYPE).toLocalIterator():
        said = np.frombuffer(r.part, np.int8)
        tables[r.predictor][r.lo : r.lo + len(said)] = said
    return Mixer(code, bits, tables)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are the words of the text after lower-casing A-Z, then one end. Texts whose id's CRC-32 leaves
    0 modulo ``parts`` are not learned from; nor are rows with a null id, whose held_out is null. A null
    text is an empty one: its only token is the end. Without training texts base_score is 0 for every
    token and the predictors say nothing. Repeated rows are scored, and learned from, as often as they
    come. Other columns are ignored, an empty table gives an empty result.

    ``score`` is the sum of the mixed log10 probabilities of all bits of the words, blanks and the end.
    Each predictor hashes the last bytes and the place in the byte's code to a slot with the log-odds of all training texts; contexts cross words. Weights by gate
    and refined probabilities learn with the bits as they come, anew in each SEGMENT bytes of a text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("held_out", held)
    train = src.where(F.coalesce(~F.col("held_out"), F.lit(False)))
    got = train.select("t").mapInArrow(lean(_count_words), "word string, c long")
    known = cut(got.groupBy("word").agg(F.sum("c").alias("c")))
    n, v = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = spark.sparkContext.broadcast(fitted(train.select("t"), known))
    base = F.log10((F.col("c") + 0.1) / (n + 0.1 * (v + 1)))
    unknown = math.log10(0.1 / (n + 0.1 * (v + 1)))
    top = known.orderBy(F.desc("c"), "word").limit(head_words).select("word", base.alias("base")).collect()
    head = spark.sparkContext.broadcast({r.word.encode(): r.base for r in top})
    texts = src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", F.octet_length("t").cast("long").alias("n_bytes"), "t")
    per = cut(texts.mapInArrow(lean(_read(head, model)), "rid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, base double, n_known long, score double, tail array<struct<word:string,tf:int>>"))
    tail = per.select("rid", F.explode("tail").alias("x")).select("rid", "x.*")
    c = F.coalesce("c", F.lit(0))
    price = F.when(c > 0, base).otherwise(F.lit(unknown))
    found = tail.join(known, "word", "left").groupBy("rid").agg(F.sum(F.col("tf") * price).alias("b"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("k"))
    j = per.drop("tail").join(found, "rid", "left")
    return j.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
