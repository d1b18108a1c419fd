"""Packing documents into token windows, mixing sources by deficit round-robin.

Mixture-controlled packing: each source is a queue of tokens. With every window a source earns its share of it in
credit and sends whole tokens while its credit lasts; the fraction that it could not send it carries as deficit to
later windows, across partitions. So token ``q`` of a queue falls due when the credit reaches it, at ``(q + 1 - phase) / credit``
windows, and sequence ``w`` holds the tokens from the ``window * w``-th on in the order in which they fall due, those of a source side
by side. How many tokens of each source come before a sequence depends on the queues' lengths and credits alone, so
every task works out the sequences that its documents reach into by itself (``Mixture``), without a table of turns.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import TextEncoder
from .common import materialize, small_batches, table

#: Sources times partitions of which a row each is broadcast at most; more are joined by a shuffle.
BROADCAST = 1 << 20
PIECES = "id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str) -> TextEncoder:
    return TextEncoder(tokenizer_path)


def tokenize(docs: DataFrame, tokenizer_path: str, eos: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, source, n, ids, part, before)``: each row's ids with ``eos`` behind, as little-endian 16-bit binary; ``before`` counts
    the ids of earlier rows of its source in its partition ``part``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode, part, sent = _encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        tail = np.array([eos], "<u2").tobytes()
        for batch in batches:
            ids = [encode(t or "") + tail for t in batch.column(2).to_pylist()]
            n, before = [len(x) // 2 for x in ids], []
            for source, k in zip(batch.column(1).to_pylist(), n, strict=True):
                before.append(sent.get(source, 0))
                sent[source] = before[-1] + k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64())],
                ["id", "source", "n", "ids", "part", "before"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return materialize(rows.mapInArrow(run, f"id {kind}, source string, n long, ids binary, part int, before long"), "tokens")


class Mixture:
    """Where each token of each queue goes: sequences of ``window`` tokens, filled in the order in which tokens fall due.

    Time runs in ``TICKS`` a window and credits are whole multiples of 2 ** -``BITS`` tokens a window, so all counts are exact integers, the same in every task
    and at every size: 64-bit ones, or Python's where a queue takes so long that these would not do.
    """

    #: So many numbers at most are worked on at a time.
    CELLS = 1 << 21
    TICKS, BITS = 10, 24

    def __init__(self, queues: list[int], credits: list[float], window: int):
        self.window, self.total, k = window, sum(queues), len(queues)
        rates = [max(1, round(c * (1 << self.BITS))) for c in credits]
        # Phases differ, so that sources with like shares do not fall due together.
        phases = [((2 * i + 1) << self.BITS) // (2 * k) for i in range(k)]
        #: The tick by which all is due.
        self.end = max(((((n + 1) << self.BITS) // r + 2) << self.TICKS for n, r in zip(queues, rates, strict=True)), default=0)
        small = max((self.end >> self.TICKS, 1)) << self.BITS < 1 << 61 and max(rates, default=0) < 1 << 50
        self.kind = np.int64 if small and self.total < 1 << 61 else object
        self.queue, self.rate, self.phase = (np.array(x, self.kind) for x in (queues, rates, phases))
        self.whole, self.part = self.rate >> self.BITS, self.rate & ((1 << self.BITS) - 1)
        self.speed = sum(rates) / (1 << self.BITS)

    def _ints(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.int64) if self.kind is np.int64 else np.array([int(v) for v in x], object)

    def due_by(self, t: np.ndarray) -> np.ndarray:
        """Tokens of each queue that are due at each tick: (ticks, queues)."""
        w, r = (x.astype(self.kind)[:, None] for x in (t >> self.TICKS, t & ((1 << self.TICKS) - 1)))
        more = (w * self.part + (r * self.rate >> self.TICKS) + self.phase) >> self.BITS
        return np.minimum(self.queue, w * self.whole + more)

    def sent(self, w: np.ndarray) -> np.ndarray:
        """Tokens of each queue before each sequence: (sequences, queues); of those due in one tick, the earlier queues' go first."""
        goal = np.minimum(w.astype(self.kind) * self.window, self.total)
        slack = 4 * (len(self.queue) + 1)
        near = lambda x: self._ints(np.clip(x.astype(float) / self.speed * (1 << self.TICKS), 0, float(self.end)))
        low, high = near(goal - slack), np.minimum(near(goal + slack) + 2, self.end)
        # Once a queue has run out, more time is needed than all speeds together would take.
        low[self.due_by(low).sum(1) > goal] = 0
        high[self.due_by(high).sum(1) <= goal] = self.end
        low[goal >= self.total] = self.end
        while len(wide := np.flatnonzero(high - low > 1)):
            mid = (low[wide] + high[wide]) >> 1
            early = self.due_by(mid).sum(1) <= goal[wide]
            low[wide[early]], high[wide[~early]] = mid[early], mid[~early]
        base = self.due_by(low)
        more = self.due_by(high) - base
        lacks = (goal - base.sum(1))[:, None]
        return base + np.minimum(np.maximum(lacks - (np.cumsum(more, 1) - more), 0), more)

    def rank(self, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        """About the place of token ``q`` of queue ``s`` in the order in which tokens fall due."""
        out, step = np.zeros(len(s), self.kind), max(1, self.CELLS // len(self.queue))
        rate, phase = self.rate.astype(float) / (1 << self.BITS), self.phase.astype(float) / (1 << self.BITS)
        for at in range(0, len(s), step):
            i = s[at : at + step]
            t = (q[at : at + step].astype(float) + 1 - phase[i]) / rate[i] * (1 << self.TICKS)
            out[at : at + step] = self.due_by(self._ints(np.minimum(t, float(self.end)))).sum(1)
        return out

    def pieces(self, s: np.ndarray, at: np.ndarray, n: np.ndarray):
        """``(row, start, length, place)`` of the pieces of rows that hold the ``n`` tokens from ``at`` of queue ``s``."""
        last = -(-self.total // self.window) - 1
        at, n = at.astype(self.kind), n.astype(self.kind)
        # Rounding moves a rank by less than a window, so one more is tried at both ends.
        first = np.maximum(self.rank(s, at) // self.window - 2, 0)
        count = (np.minimum(self.rank(s, at + n - 1) // self.window + 2, last) - first + 1).astype(np.int64)
        sparse = (count > 8 * n) & (n > 1)
        if sparse.any():
            # Tokens many windows apart are placed one by one, not by a look into each window between.
            times = np.where(sparse, n, 1).astype(np.int64)
            row = np.repeat(np.arange(len(s)), times)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            own, start, length, place = self.pieces(s[row], (at[row] + nth).astype(np.int64), np.where(sparse[row], 1, n[row]).astype(np.int64))
            return [row[own], start + nth[own], length, place]
        rows, ws = np.repeat(np.arange(len(s)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        out, step = [], max(1, self.CELLS // len(self.queue))
        for k in range(0, len(rows), step):
            row, w = rows[k : k + step], ws[k : k + step]
            need = np.unique(np.concatenate([w, w + 1]))
            sent = self.sent(need)
            before = np.cumsum(sent, 1) - sent
            i, j, q = np.searchsorted(need, w), np.searchsorted(need, w + 1), s[row]
            low, high = sent[i, q], sent[j, q]
            begin, end = np.maximum(low, at[row]), np.minimum(high, (at + n)[row])
            place = w * self.window + before[j, q] - before[i, q] + begin - low
            some = end > begin
            out.append([x[some] for x in (row, begin - at[row], end - begin, place)])
        got = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
        n = n.astype(np.int64)
        if not np.array_equal(np.bincount(got[0], got[2], len(s)).astype(np.int64), n):
            raise RuntimeError("pieces do not cover their rows")
        return got


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, eos: int = 0, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of every document's ids in sequences of ``window`` tokens; each id is in exactly one piece.

    ``weights`` are the target shares by source (default: each source's share of all tokens, so
    that all queues end together; sources not named get a share of one token a window). Every sequence holds each
    source's share of it but for a few tokens; a queue that has run
    out leaves its share to the others. Null text is empty and packs as ``eos`` alone; null sources are one
    queue named ``""``; repeated rows are packed each; null ids stay null; an empty table gives none.
    Returns ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``. The last sequence alone
    may be short: it is padded to ``window`` unless its length is a power of two.
    Other columns, whatever their names, are not read and not returned.
    """
    tokens = tokenize(docs, tokenizer_path, eos, id_col, text_col, source_col)
    # A queue is its source's rows, partition by partition; the driver gets a row for each source.
    parts = materialize(tokens.groupBy("source", "part").agg(F.sum("n").alias("in_part")), "parts")
    queue = {r["source"]: r["n"] for r in sorted(parts.groupBy("source").agg(F.sum("in_part").alias("n")).collect())}
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("source", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("shift"))
    placed = tokens.join(F.broadcast(shifts) if parts.count() <= BROADCAST else shifts, ["source", "part"])
    queues = list(queue.items())
    total = sum(queue.values())
    if weights is None:
        credits = [n * window / total for _, n in queues]
    else:
        norm = sum(weights.values())
        credits = [window * weights[s] / norm if s in weights else 1.0 for s, _ in queues]
    mixture = Mixture([n for _, n in queues], credits, window) if queues else None
    number = {s: i for i, s in enumerate(queue)}

    def pieces(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sources = batch.column(3).to_pylist()
            s = np.array([number[x] for x in sources], np.int64)
            n, before = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 4))
            row, start, length, place = mixture.pieces(s, before, n)
            ids, crcs, held, words = batch.column(2), [], -1, None
            for i, a, size in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if i != held:
                    held, words = i, memoryview(np.frombuffer(ids[i].as_buffer(), "<u2").astype("<u4")).cast("B")
                crcs.append(zlib.crc32(words[4 * a : 4 * (a + size)]))
            taken = pa.array(row)
            arrays = [batch.column(0).take(taken), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), batch.column(1).take(taken), pa.array(place // window), pa.array(place % window)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    out = placed.select("id", "n", "ids", "source", (F.col("before") + F.col("shift")).alias("before")).mapInArrow(pieces, PIECES.format(id=kind))
    return out.withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` over ``documents``: windows of 1024 tokens, end id 0."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
