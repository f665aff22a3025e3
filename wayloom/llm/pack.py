"""Operator 6: mixture-controlled packing by deficit round-robin over source queues.

Every window of ``length`` tokens is filled to the target proportions of the sources. A round of deficit
round-robin gives each queue its quantum (share times window), serves whole tokens and carries the fractional
deficit to the next window. Served this way, what queue q has got after x tokens has a closed form, the
difference of two floors of cumulative shares, F_q(x) - F_(q-1)(x): each queue is always within one token of
its share, a window is always full, and any task can tell the windows of its own documents from their place in
the queue alone. So deficits carry across windows *and* partitions without a task that sees a whole queue.
With natural shares all queues end together and only the last window is padded. With other targets queues run
out one by one; the shares are then renormalised over the rest (a phase of the schedule). The query and the pipeline ask
for tempered shares: a source's target is its tokens to the power ``TEMPER``, so that small sources gain.

Each source has a queue of its own, however many there are. Its part of the schedule (the ends of the phases) is a row
of a table that is joined by source. Sources without a target of their own run out together, so there are at most two
phases more than targets; the driver holds a number for each source and phase.

The places come from one pass that tokenises and writes the ids once (with each document's tokens before it
in its task and queue), a small table of tokens per queue and task, and its prefix sums. Ids aren't shuffled.

Results for odd input: a null or empty text has only the end id; a null source is a queue of its own; rows that
repeat an id are packed each by itself; a very long text is tokenised whole and cut over as many windows as it takes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import MAX_BROADCAST_KEYS, keep, scratch, small_batches, stored, tidy
from .tokens import Encoder

LENGTH = 4096
#: Targets of the query and the pipeline: token shares to this power.
TEMPER = 0.7

PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """Cumulative allotments F_q(x) of the queues 0..q after x tokens in all; exact integers at the knots."""

    def __init__(self, totals: list[int], targets: list[float] | None = None):
        self.total = sum(totals)
        left, done = np.array(totals, np.int64), np.zeros(len(totals), np.int64)
        knots = [done]
        weights = np.maximum(np.array(totals if targets is None else targets, np.float64), 1e-12)
        while left.any():
            if targets is None:
                served = left
            else:
                ratios = np.where(left > 0, left / weights, np.inf)
                served = np.minimum(left, np.floor(weights * ratios.min()).astype(np.int64))
                # those that end here but for the tokens rounded away end together
                served = np.where((left - served <= len(knots)) | (ratios == ratios.min()), left, served)
            done, left = done + served, left - served
            knots.append(done)
        self.queue = np.array(knots * 2 if len(knots) == 1 else knots, dtype=np.int64)
        self.cum = np.cumsum(self.queue, axis=1) if totals else self.queue
        self.x = self.cum[:, -1] if totals else np.zeros(len(self.queue), np.int64)

    def knots(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All that queue q needs of the schedule: x, F_(q-1)(x) and F_q(x) at the ends of the phases."""
        return self.x, self.cum[:, q - 1] if q else np.zeros_like(self.x), self.cum[:, q]

    @classmethod
    def of(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Schedule:
        """The schedule with one queue's knots: as queue 1, after all those before it as queue 0."""
        one = cls.__new__(cls)
        one.x, one.cum, one.total = x, np.stack([low, high], axis=1), int(x[-1])
        return one

    def upto(self, q: int, x: np.ndarray) -> np.ndarray:
        """F_q(x); q = -1 is 0."""
        x = np.minimum(np.asarray(x, np.int64), self.total)
        if q < 0:
            return np.zeros_like(x)
        p = np.clip(np.searchsorted(self.x, x, "right") - 1, 0, len(self.x) - 2)
        dx, dy = self.x[p + 1] - self.x[p], self.cum[p + 1, q] - self.cum[p, q]
        step = x - self.x[p]
        if self.total >= 1 << 31:
            part = (step.astype(object) * dy.astype(object) // np.maximum(dx, 1).astype(object)).astype(np.int64)
        else:
            part = step * dy // np.maximum(dx, 1)
        return self.cum[p, q] + part

    def got(self, q: int, window: np.ndarray, length: int) -> np.ndarray:
        """Tokens of queue q in all windows before ``window``."""
        return self.upto(q, window * length) - self.upto(q - 1, window * length)

    def window_of(self, q: int, place: np.ndarray, length: int) -> np.ndarray:
        """The window of the queue's token at ``place``, by bisection over the monotone allotments."""
        low = np.zeros(len(place), np.int64)
        high = np.full(len(place), -(-self.total // length), np.int64)
        while (high - low > 1).any():
            mid = (low + high) // 2
            right = self.got(q, mid, length) <= place
            low, high = np.where(right, mid, low), np.where(right, high, mid)
        return low


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None, end_id: int = 2) -> DataFrame:
    """One row per document: ids as little-endian bytes, block (the task), and the tokens of its source before it there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        encoder = Encoder(path, end_id)
        before: dict[str, int] = {}
        for b in batches:
            ids_of, sources = b.column("id"), b.column("source").to_pylist()
            for first, ids, bounds in encoder.encode(b.column("text")):
                rows = len(bounds) - 1
                n = np.diff(bounds)
                starts = np.zeros(rows, np.int64)
                for k in range(rows):
                    s = sources[first + k]
                    starts[k] = before.get(s, 0)
                    before[s] = int(starts[k] + n[k])
                width = ids.dtype.itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer((bounds * width).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(first, rows), pa.array(sources[first : first + rows], pa.string()), pa.array(np.full(rows, block, np.int64)), pa.array(starts), pa.array(n.astype(np.int64)), raw.cast(pa.binary())],
                    ["doc_id", "source", "block", "before", "n", "ids"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    return rows.mapInArrow(tidy(encode), "doc_id long, source string, block long, before long, n long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None, end_id: int = 2, temper: float | None = None) -> DataFrame:
    """The pieces of all documents: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``targets``: token proportions by source (those missing get weight by their size); ``temper``: they are the sources'
    tokens to this power; neither: natural shares.
    """
    with scratch(docs.sparkSession):
        return _packed(docs, length, targets, id_col, text_col, source_col, path, end_id, temper)


def _packed(docs: DataFrame, length: int, targets: dict[str, float] | None, id_col: str, text_col: str, source_col: str, path: str | None, end_id: int, temper: float | None) -> DataFrame:
    spark = docs.sparkSession
    tokens = stored(tokenised(docs, id_col, text_col, source_col, path, end_id), "tokens")
    sums = stored(tokens.groupBy("source", "block").agg(F.sum("n").alias("tokens")), "sums")
    totals = sorted((r["source"], r["t"]) for r in sums.groupBy("source").agg(F.sum("tokens").alias("t")).collect())
    goals = None
    if temper is not None:
        targets = {s: t**temper for s, t in totals}
    if targets is not None:
        known, all_tokens = sum(t for s, t in totals if s in targets), sum(t for _, t in totals)
        goals = [targets[s] if s in targets else (sum(targets.values()) or 1.0) * t / max(known, 1 if not all_tokens else known or all_tokens) for s, t in totals]
    plan = Schedule([t for _, t in totals], goals)
    phases = [(s, *(k.tolist() for k in plan.knots(q))) for q, (s, _) in enumerate(totals)]
    phases = stored(spark.createDataFrame(phases, "source string, x array<long>, low array<long>, high array<long>"), "phases")

    w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "block", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("base"))
    bases = stored(bases.join(phases, "source"), "bases")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, place = b.column("n").to_numpy(), b.column("base").to_numpy() + b.column("before").to_numpy()
            named = b.column("source").dictionary_encode()
            queues = named.indices.to_numpy()
            plans = {}
            first, last = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for q in range(len(named.dictionary)):
                own = np.flatnonzero(queues == q)
                plan = plans[q] = Schedule.of(*(b.column(c)[int(own[0])].values.to_numpy() for c in ("x", "low", "high")))
                first[own] = plan.window_of(1, place[own], length)
                last[own] = plan.window_of(1, place[own] + n[own] - 1, length)
            count = last - first + 1
            row = np.repeat(np.arange(b.num_rows), count)
            window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            begin, end, at = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            for q, plan in plans.items():
                own = np.flatnonzero(queues[row] == q)
                wq = window[own]
                opens = plan.got(1, wq, length)
                begin[own] = np.maximum(opens, place[row[own]])
                end[own] = np.minimum(plan.got(1, wq + 1, length), place[row[own]] + n[row[own]])
                at[own] = begin[own] - opens + plan.upto(0, (wq + 1) * length) - plan.upto(0, wq * length)
            full = end > begin
            row, window, begin, end, at = row[full], window[full], begin[full], end[full], at[full]
            start, size = begin - place[row], end - begin
            ids = b.column("ids")
            crc, seen, words = np.zeros(len(row), np.int64), -1, None
            for k, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), size.tolist())):
                if r != seen:
                    raw = ids[r].as_buffer()
                    words = np.frombuffer(raw, "<u4" if len(raw) == 4 * n[r] else "<u2").astype("<u4")
                    seen = r
                crc[k] = zlib.crc32(words[s : s + m])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("source").take(take), *(pa.array(x) for x in (start, size, crc, n[row], window, at))],
                ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    small = bases.count() * len(plan.x) <= MAX_BROADCAST_KEYS
    keep(tokens)
    keep(bases)
    joined = tokens.join(F.broadcast(bases) if small else bases, ["source", "block"])
    return joined.select("doc_id", "source", "base", "before", "n", "ids", "x", "low", "high").mapInArrow(tidy(cut), PIECES)


def op6_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, tempered token shares of the sources in every window of 4096 while they last."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), temper=TEMPER)
