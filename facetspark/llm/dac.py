"""Directly addressable codes for token ids: chunk levels, continuation bitmaps, rank directories.

A segment is the unit of the format: the ids of consecutive documents.

    magic "DAC1" | u32 levels | u64 ids | per level: u8 bits, u64 chunks,
    chunks (1 byte for up to 8 bits, else 2), bitmap (1 bit a chunk, set if the id goes on
    at the next level), rank directory (u32 set bits before each block of 512)

Numbers are little-endian.  The i-th id needs one chunk and one rank for each level it
reaches: no block is decoded.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch_path
from .tokens import tokenizer

MAGIC = b"DAC1"
BLOCK = 512


def encode_segment(ids: np.ndarray, widths: tuple[int, ...] = (8, 8, 16)) -> bytes:
    """One segment; ``widths`` are the bits of each level from the lowest, together 32."""
    if sum(widths) < 32:
        raise ValueError("the levels must hold 32 bits")
    left = np.asarray(ids, dtype=np.uint32).astype(np.uint64)
    levels = []
    for bits in widths:
        chunk = left & np.uint64((1 << bits) - 1)
        left = left >> np.uint64(bits)
        on = left > 0
        ones = np.add.reduceat(on, np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0, dtype=np.int64)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(on) else ones
        levels.append(
            struct.pack("<BQ", bits, len(chunk))
            + chunk.astype("<u1" if bits <= 8 else "<u2").tobytes()
            + np.packbits(on, bitorder="little").tobytes()
            + rank.astype("<u4").tobytes()
        )
        left = left[on]
        if not len(left):
            break
    return MAGIC + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class Segment:
    """Random access to the ids of one segment, straight from its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 segment")
        n_levels, self.n = struct.unpack_from("<IQ", data, 4)
        at, self._levels = 16, []
        for _ in range(n_levels):
            bits, n = struct.unpack_from("<BQ", data, at)
            at += 9
            kind = np.dtype("<u1" if bits <= 8 else "<u2")
            chunks = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += len(bitmap)
            rank = np.frombuffer(data, "<u4", -(-n // BLOCK), at)
            at += 4 * len(rank)
            self._levels.append((bits, chunks, bitmap, rank))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for bits, chunks, bitmap, rank in self._levels:
            value |= int(chunks[i]) << shift
            shift += bits
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(rank[block]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n, dtype="<u4")
        at, shift = None, 0
        for bits, chunks, bitmap, _ in self._levels:
            part = chunks.astype("<u4") << np.uint32(shift)
            if at is None:
                out |= part
                at = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))
            else:
                out[at] |= part
                at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
            shift += bits
        return out


@dataclass(frozen=True)
class TokenFileParams:
    tokenizer_path: str
    end_id: int = 1
    #: Ids after which a segment ends, at the end of a document.
    segment_ids: int = 1 << 19


def _write(params: TokenFileParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokenizer(params.tokenizer_path)
        end = np.array([params.end_id], dtype="<u4").tobytes()
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[bytes] = []
        lengths: list[int] = []

        def segment() -> pa.RecordBatch:
            nonlocal seq, start, docs, held, lengths
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            row = [[part], [seq], [start], [len(ids)], [docs], [lengths], [encode_segment(ids)]]
            seq, start, docs, held, lengths = seq + 1, start + len(ids), [], [], []
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "seq", "start", "n_ids", "doc_ids", "lengths", "payload"])

        size = 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tok.ids(text.as_py()) + end
                docs.append(name.as_py())
                held.append(ids)
                lengths.append(len(ids) // 4)
                size += len(ids) // 4
                if size >= params.segment_ids:
                    yield segment()
                    size = 0
        if docs:
            yield segment()

    return run


def write_token_files(docs: DataFrame, path: str, params: TokenFileParams) -> None:
    """Write every document's ids, in ascending doc_id order, as DAC segments below ``path``.

    Spark's own committer writes the segments as binary rows (part, seq, start in the
    part, n_ids, doc_ids, lengths, payload), on any file system and safe against lost
    executors; ``export_segments`` makes plain ``.dac`` files of them.

    A null or empty text is the end id alone.  Rows that share a doc_id follow each
    other by text; a null doc_id comes first.  Other columns are not read.  An empty
    table gives files without segments.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    parts = base.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = base.repartitionByRange(int(parts), *order[:2]).sortWithinPartitions(*order)
    schema = "part int, seq long, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
    ranged.mapInArrow(_write(params), schema).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    seg = spark.read.parquet(path)
    # One row per part: as many as the write had tasks.
    totals = [(r["part"], r["n"]) for r in seg.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()]
    bases, at = {}, 0
    for part, n in totals:
        bases[part], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = Segment(r["payload"]).all().tobytes()
                start, a = bases[r["part"]] + r["start"], 0
                starts, sums = [], []
                for n in r["lengths"]:
                    starts.append(start + a)
                    sums.append(zlib.crc32(data[4 * a : 4 * (a + n)]))
                    a += n
                if 4 * a != len(data):
                    raise ValueError("a segment's ids and lengths differ")
                columns = [r["doc_ids"], starts, r["lengths"], sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return seg.select("part", "start", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_segments(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Plain ``part-segment.dac`` files in a folder that every executor mounts; rows (file, n_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{r['part']:06d}-{r['seq']:06d}.dac"
                own = Path(folder, f".{name}.{os.getpid()}")
                own.write_bytes(r["payload"])
                own.rename(Path(folder, name))  # a task that runs again replaces its own files
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r["n_ids"]], pa.int64())], ["file", "n_ids"])

    return spark.read.parquet(path).select("part", "seq", "n_ids", "payload").mapInArrow(run, "file string, n_ids long")


def token_round_trip(docs: DataFrame, params: TokenFileParams) -> DataFrame:
    """Write ``docs`` to a scratch folder of token files and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, params)
    return read_token_files(docs.sparkSession, path)
