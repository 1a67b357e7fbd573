"""Operator 1: best-fit packing of token sequences by a configuration linear program.

The configurations are multisets of piece lengths that fit a sequence. The program asks for the fewest sequences that
cover the histogram of lengths. Multiplicative weights solve it: each length has a weight that falls as its pieces get
covered, and a knapsack dynamic program over the capacity prices the next configurations. They are taken in whole sequences,
and the pieces of the rounding remainder go best-fit decreasing over the histogram.

The histogram has at most ``capacity`` rows whatever the input, so the plan is made on the driver; the pieces never leave
the executors. A piece's place follows from its rank among the pieces of its length, which adds a count per (task,
length) to a rank in the task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, steps
from .subwords import WordIds

#: Phases of multiplicative weights at most, how fast weights fall, and the part of what a configuration can cover that is taken at once.
PHASES, RATE, PART = 128, 0.4, 1
#: The share of the best value from which a phase takes a configuration at first, by how much it falls when none is, and the least.
CLOSE = (0.999, 0.003, 0.98)


def price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack for every room up to ``capacity``: the greatest total weight of lengths that fit, and the length to take first (0: leave one unit)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        totals = best[c - 1 :: -1] + weights[1 : c + 1]
        k = int(totals.argmax())
        if totals[k] > best[c - 1] + 1e-15:
            best[c], took[c] = totals[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, took


def configuration(first: int, priced: tuple[np.ndarray, np.ndarray], weights: np.ndarray, left: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The best configuration that holds a piece of length ``first`` and no more pieces than are left, and its value."""
    best, took = priced
    out, room, value = {first: 1}, capacity - first, weights[first]
    while room:
        k = int(took[room])
        if k and out.get(k, 0) >= left[k]:  # the next best that is left
            totals = best[room - 1 :: -1] + weights[1 : room + 1]
            for used, n in out.items():
                if used <= room and n >= left[used]:
                    totals[used - 1] = -1
            k = int(totals.argmax()) + 1
            k = k if weights[k] and out.get(k, 0) < left[k] else 0
            if not k:
                break
        if k:
            out[k] = out.get(k, 0) + 1
            value += weights[k]
        room -= k or 1
    return out, value


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: equal open sequences are one entry with a multiplicity."""
    done: list[tuple[dict[int, int], int]] = []
    rooms: list[int] = []
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(pattern: dict[int, int], times: int, room: int) -> None:
        if not times:
            return
        if not room:
            done.append((pattern, times))
            return
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((pattern, times))

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                put({length: fit}, n // fit, capacity - fit * length)
                put({length: n % fit}, int(n % fit > 0), capacity - (n % fit) * length)
                break
            room = rooms[i]
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            fit = min(room // length, n)
            used = min(times, n // fit)
            put(pattern, times - used, room)
            put({**pattern, length: pattern.get(length, 0) + fit}, used, room - fit * length)
            n -= used * fit
    return done + [x for kept in open_.values() for x in kept]


def solve(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations with multiplicities that hold exactly counts[l] pieces of each length l <= capacity."""
    plan, left = by_program(counts, capacity)
    return plan + best_fit(left, capacity)


def by_program(counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The configurations of the program, rounded to whole sequences, and the pieces that they leave.

    Each phase prices once: the knapsack gives, for every length, the best configuration that holds it, and those close to
    the best of all are taken in part, in whole sequences, before the weights of what they cover fall.
    """
    left, lengths = counts.astype(np.int64).copy(), np.arange(capacity + 1)
    need, plan, close = np.maximum(left, 1).astype(float), {}, CLOSE[0]
    for _ in range(PHASES):
        if not left.any():
            break
        weights = np.where(left > 0, lengths / capacity * np.exp(RATE * (left / need - 1)), 0)
        priced, taken = price(weights, capacity), 0
        for k in np.flatnonzero(left)[::-1].tolist():
            if not left[k] or weights[k] + priced[0][capacity - k] < close * priced[0][capacity]:
                continue
            pattern, value = configuration(k, priced, weights, left, capacity)
            if value < close * priced[0][capacity]:
                continue
            times = -(-min(int(left[j] // n) for j, n in pattern.items()) // PART)
            for j, n in pattern.items():
                left[j] -= times * n
            key = tuple(sorted(pattern.items()))
            plan[key] = plan.get(key, 0) + times
            taken += times
        if not taken:
            close -= CLOSE[1]
            if close < CLOSE[2]:
                break
    return [(dict(key), times) for key, times in plan.items()], left


class Slots:
    """For each length, where the pieces of each rank go."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for pattern, times in plan:
            offset = 0
            for length in sorted(pattern, reverse=True):
                rows.setdefault(length, []).append((first, pattern[length], offset))
                rows[length][-1] += (times,)
                offset += length * pattern[length]
            first += times
        self.sequences = first
        self.of = {k: (np.concatenate([[0], np.cumsum([x[1] * x[3] for x in v])]), np.array([x[:3] for x in v], np.int64)) for k, v in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            ends, rows = self.of[int(k)]
            i = np.searchsorted(ends, rank[at], "right") - 1
            first, n, start = rows[i].T
            inside = rank[at] - ends[i]
            sequence[at], offset[at] = first + inside // n, start + inside % n * k
        return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """(id, text) -> a row per piece with its task, and its rank among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = WordIds(tokenizer), TaskContext.get().partitionId(), {}
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in steps(batch, ("text",)):
                rows = []
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = words.encode(text or "") + tail
                    for piece, at in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[at * 4 : (at + capacity) * 4]
                        n = len(cut) // 4
                        rows.append((i, piece, at, n, zlib.crc32(cut), task, seen.get(n, 0)))
                        seen[n] = seen.get(n, 0) + 1
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "task", "rank"]), schema=schema, preserve_index=False)

    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])
    return docs.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end``; one longer than ``capacity`` is cut into pieces of that length, the last
    of which may be shorter. A null or empty text is one piece that holds ``end`` alone. Each row of ``docs`` is a document
    of its own, also where ids repeat or are null. An empty table gives an empty result. Other columns aren't read.
    """
    ws = Workspace(docs.sparkSession, "packing")
    cut = ws.save(pieces(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), tokenizer, capacity, end), "pieces")
    by_task = ws.save(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    slots = Slots(solve(counts, capacity))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    # a row for each length and task: it grows with the input, so it is never broadcast
    ranked = cut.join(ws.save(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), "before").hint("merge"), ["length", "task"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = slots.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                kept = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, f"`{id}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
