"""Pattern packing: repeat counts of few-document length patterns by non-negative least squares."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .tokens import tokenizer
from .workers import tidy

#: (lengths, repeats): so many sequences that hold pieces of these lengths, in this order.
Run = tuple[tuple[int, ...], int]


@dataclass(frozen=True)
class PackParams:
    tokenizer_path: str
    capacity: int = 2048
    end_id: int = 0
    #: Pieces of a pattern at most, draws of a round, rounds of the fit.
    pattern_pieces: int = 8
    draws: int = 12_000
    sweeps: int = 60
    seed: int = 1


def length_patterns(histogram: np.ndarray, params: PackParams, slack: int, rng: np.random.Generator) -> np.ndarray:
    """(patterns, pattern_pieces) lengths, longest first and 0 for none, that fill a sequence up to ``slack``.

    Starts are draws in proportion to the histogram, half of them begun with each
    present length in turn; what room a start leaves is given to the present length
    that fits best.  Their number is bounded by ``draws`` and ``pattern_pieces``.
    """
    capacity, width = params.capacity, params.pattern_pieces
    present = np.flatnonzero(histogram)
    nearest = np.maximum.accumulate(np.where(histogram > 0, np.arange(len(histogram)), 0))
    share = np.cumsum(histogram) / histogram.sum()
    draw = np.minimum(np.searchsorted(share, rng.random((params.draws, width - 1)), side="right"), capacity)
    head = np.repeat(present[::-1], max(1, params.draws // 2 // len(present)))[: params.draws]
    draw[: len(head), 0] = head
    room = capacity - np.cumsum(draw, axis=1)
    last = nearest[np.maximum(room, 0)]
    row, k = np.nonzero((last > 0) & (room - last <= slack))
    start = np.where(np.arange(width - 1) <= k[:, None], draw[row], 0)
    patterns = np.unique(-np.sort(-np.concatenate([start, last[row, k][:, None]], axis=1), axis=1), axis=0)
    times = (patterns[:, :, None] == patterns[:, None, :]).sum(axis=2)
    return patterns[((patterns == 0) | (histogram[patterns] >= times)).all(axis=1)]


def fit_repeats(histogram: np.ndarray, patterns: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative least squares min ||A x - h||, A counting lengths in patterns, by multiplicative steps.

    All numbers are non-negative, so x * (A'h) / (A'Ax) stays so and never raises the
    error.  A is the index table ``patterns``: its products are a gather and a count.
    """
    flat, width = patterns.ravel(), patterns.shape[1]

    def gathered(r: np.ndarray) -> np.ndarray:
        r[0] = 0.0
        return r[patterns].sum(axis=1)

    goal = gathered(histogram.astype(np.float64))
    x = np.full(len(patterns), histogram.sum() / (3 * len(patterns)))
    for _ in range(sweeps):
        x *= goal / np.maximum(gathered(np.bincount(flat, np.repeat(x, width), minlength=len(histogram))), 1e-12)
    return x


def rounded_runs(histogram: np.ndarray, patterns: np.ndarray, x: np.ndarray) -> tuple[list[Run], np.ndarray]:
    """Whole repeats first, then one more by largest remainder, as long as the histogram has the pieces."""
    left, taken = histogram.tolist(), {}
    rows = patterns.tolist()
    whole = np.floor(x).astype(np.int64)
    steps = [(int(j), int(whole[j])) for j in np.flatnonzero(whole)] + [(int(j), 1) for j in np.argsort(whole - x, kind="stable")]
    for j, n in steps:
        need = Counter(v for v in rows[j] if v)
        n = min(n, *(left[v] // k for v, k in need.items()))
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            taken[j] = taken.get(j, 0) + n
    return [(tuple(v for v in rows[j] if v), n) for j, n in taken.items()], np.array(left, dtype=np.int64)


def best_fit_runs(histogram: np.ndarray, capacity: int) -> list[Run]:
    """Best-fit decreasing over a histogram: whole groups of equal bins and equal pieces move at once."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> pattern -> number
    rooms = np.zeros(capacity + 1, dtype=bool)
    for length in np.flatnonzero(histogram)[::-1]:
        length, count = int(length), int(histogram[length])
        while count:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                per = max(1, capacity // length)
                whole, rest = divmod(count, per)
                for k, n in ((per, whole), (rest, 1)):
                    if k and n:
                        room = capacity - k * length
                        at = bins.setdefault(room, {})
                        key = (length,) * k
                        at[key] = at.get(key, 0) + n
                        rooms[room] = True
                break
            room = int(fits[0]) + length
            at = bins[room]
            pattern, number = next(iter(at.items()))
            n = min(number, count)
            if n == number:
                del at[pattern]
                rooms[room] = bool(at)
            else:
                at[pattern] = number - n
            to = bins.setdefault(room - length, {})
            key = (*pattern, length)
            to[key] = to.get(key, 0) + n
            rooms[room - length] = True
            count -= n
    return [(p, n) for at in bins.values() for p, n in at.items()]


def plan_runs(histogram: np.ndarray, params: PackParams) -> tuple[list[Run], int]:
    """The whole packing plan of a histogram of lengths 1 ... capacity, and the pieces that best fit placed.

    Patterns are fitted and rounded, and those of what is left again, first exact ones
    and, when these place less than a tenth, ones with a little more room; the residual
    is packed by best fit.  The plan's size is bounded by the numbers of lengths and
    patterns, not by the number of documents.
    """
    h = histogram.astype(np.int64).copy()
    runs: list[Run] = [((params.capacity,), int(h[params.capacity]))] if h[params.capacity] else []
    h[params.capacity] = 0
    rng, slack = np.random.default_rng(params.seed), 0
    while h.any() and slack <= params.capacity // 32:
        before = int(h.sum())
        patterns = length_patterns(h, params, slack, rng)
        if len(patterns):
            new, h = rounded_runs(h, patterns, fit_repeats(h, patterns, params.sweeps))
            runs += new
        if before - int(h.sum()) < 0.1 * before:
            slack = 2 * slack + 1
    return runs + best_fit_runs(h, params.capacity), int(h.sum())


def _pieces(params: PackParams, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(params.tokenizer_path)
        end = np.array([params.end_id], dtype="<u4").tobytes()
        size = 4 * params.capacity
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tok.ids(text.as_py()) + end
                for k in range(0, len(ids), size):
                    part = ids[k : k + size]
                    for column, value in zip(rows, (doc.as_py(), k // size, k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], list(names))

    return run


def _placer(runs: list[Run]):
    """Maps (length, rank among that length's pieces) to (sequence, offset)."""
    starts: list[int] = []
    first: list[int] = []
    offset: list[int] = []
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in runs:
        at = 0
        for length in pattern:
            rank = used.get(length, 0)
            starts.append((length << 44) + rank)
            first.append(sequence)
            offset.append(at)
            used[length] = rank + n
            at += length
        sequence += n
    order = np.argsort(np.array(starts, dtype=np.int64), kind="stable")
    table = [np.array(x, dtype=np.int64)[order] for x in (starts, first, offset)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            key = (columns["length"].to_numpy(zero_copy_only=False).astype(np.int64) << 44) + columns.pop("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            j = np.searchsorted(table[0], key, side="right") - 1
            columns["sequence_id"] = pa.array(table[1][j] + key - table[0][j], pa.int64())
            columns["offset"] = pa.array(table[2][j], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def pack_documents(docs: DataFrame, params: PackParams, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (the
    piece's ids as little-endian unsigned 32-bit bytes) if ``with_ids``.  A document is
    its ids and ``end_id``; only one longer than the capacity is cut.  The histogram of
    lengths (at most ``capacity`` numbers) is all that reaches the driver, and the plan
    that goes back is bounded by it.  A piece's rank among those of its length comes from
    ranks inside hashed buckets plus the buckets' running counts, so a very common length
    is never in one task.

    A null or empty text is the end id alone.  Each row is a document of its own, also
    where rows or ids repeat; a null doc_id stays null.  Other columns are not read.  An
    empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = base.mapInArrow(tidy(_pieces(params, with_ids), tokenizes=True), schema)
    pieces = materialize(pieces if with_ids else pieces.drop("ids"), "pack-pieces")
    counted = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(params.capacity + 1, dtype=np.int64)
    for r in counted:
        histogram[r["length"]] = r["count"]
    total = int(histogram.sum())
    runs, _ = plan_runs(histogram, params)
    buckets = min(4096, max(1, -(-total // 2000)))
    ranked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("local", F.row_number().over(inside) - 1)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int").alias("bucket"), "length").groupBy("bucket", "length").agg(F.count("*").alias("n"))
    offsets = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = ranked.join(offsets, ["bucket", "length"]).withColumn("rank", F.col("local") + F.col("base")).drop("bucket", "local", "base")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out = schema.replace(", ids binary", ", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_placer(runs), out)
