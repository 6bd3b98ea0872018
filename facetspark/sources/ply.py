"""PLY point clouds as a Spark data source: ``spark.read.format("ply")`` and a single-file writer.

Header and body are read through plain files, so the path must be one that every
executor mounts.  A binary body is split by bytes, an ascii body by lines.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The type names of the PLY format.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}

SCHEMA = "point_id long, x double, y double, z double"


@dataclass(frozen=True)
class Header:
    binary: bool
    count: int
    names: tuple[str, ...]
    kinds: tuple[str, ...]
    offset: int

    @property
    def row(self) -> np.dtype:
        return np.dtype([(n, "<" + k) for n, k in zip(self.names, self.kinds, strict=True)])


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path}: not a PLY file")
        form, count, names, kinds, inside = "", None, [], [], False
        while True:
            line = f.readline()
            if not line:
                raise ValueError(f"{path}: the header has no end")
            words = line.decode("ascii", "replace").split()
            if not words or words[0] in ("comment", "obj_info"):
                continue
            if words[0] == "end_header":
                break
            if words[0] == "format":
                form = words[1]
            elif words[0] == "element":
                inside = words[1] == "vertex"
                if inside:
                    count = int(words[2])
                elif count is None:
                    raise ValueError(f"{path}: an element comes before vertex")
            elif words[0] == "property" and inside:
                if words[1] == "list":
                    raise ValueError(f"{path}: list properties of vertex are not supported")
                kinds.append(TYPES[words[1]])
                names.append(words[2])
        if form not in ("ascii", "binary_little_endian"):
            raise ValueError(f"{path}: format {form!r} is not supported")
        if count is None or not {"x", "y", "z"} <= set(names):
            raise ValueError(f"{path}: needs a vertex element with x, y, z")
        header = Header(form != "ascii", count, tuple(names), tuple(kinds), f.tell())
    if header.binary and os.path.getsize(path) < header.offset + count * header.row.itemsize:
        raise ValueError(f"{path}: binary PLY truncated")
    return header


@dataclass
class Part(InputPartition):
    path: str
    first: int
    rows: int


class PlyReader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int):
        self.paths, self.rows = paths, rows

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            h = read_header(path)
            step = self.rows if h.binary else max(h.count, 1)  # lines have no fixed size
            out += [Part(path, a, min(step, h.count - a)) for a in range(0, h.count, step)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        h = read_header(part.path)
        if h.binary:
            for a in range(part.first, part.first + part.rows, 65536):
                n = min(65536, part.first + part.rows - a)
                body = np.fromfile(part.path, h.row, n, offset=h.offset + a * h.row.itemsize)
                yield _batch(a, *(body[c].astype(np.float64) for c in "xyz"))
            return
        at = [h.names.index(c) for c in "xyz"]
        with open(part.path, "rb") as f:
            f.seek(h.offset)
            rows, a = [], 0
            while a + len(rows) < h.count:
                words = f.readline().split()
                if not words:
                    raise ValueError(f"{part.path}: ascii PLY truncated")
                rows.append([float(words[i]) for i in at])
                if len(rows) == 65536:
                    yield _batch(a, *np.array(rows).T)
                    a, rows = a + len(rows), []
            if rows:
                yield _batch(a, *np.array(rows).T)


def _batch(first: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    ids = np.arange(first, first + len(x), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x), pa.array(y), pa.array(z)], ["point_id", "x", "y", "z"])


class PlySource(DataSource):
    """Options: path (a file, or a folder of .ply files), rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlyReader:
        path = self.options["path"].removeprefix("file://")
        paths = [str(p) for p in sorted(Path(path).glob("*.ply"))] if os.path.isdir(path) else [path]
        return PlyReader(paths, int(self.options.get("rowspartition", self.options.get("rowsPerPartition", 4_000_000))))


def read_ply(spark: SparkSession, path: str, rows_per_partition: int = 4_000_000) -> DataFrame:
    """(point_id, x, y, z): point_id is the vertex's place in its file.  A bad header fails here."""
    if not os.path.isdir(path.removeprefix("file://")):
        read_header(path.removeprefix("file://"))
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").option("rowsPerPartition", rows_per_partition).load(path)


def write_ply(cloud: DataFrame, path: str, binary: bool = True) -> int:
    """One PLY file in point_id order, streamed through the driver a partition at a time; returns the number of points."""
    n = cloud.count()
    tmp = Path(path + ".part")
    with tmp.open("wb") as f:
        kind = "binary_little_endian" if binary else "ascii"
        f.write(f"ply\nformat {kind} 1.0\nelement vertex {n}\nproperty double x\nproperty double y\nproperty double z\nend_header\n".encode())
        for r in cloud.select("point_id", "x", "y", "z").orderBy("point_id").select("x", "y", "z").toLocalIterator():
            f.write(np.array(r, dtype="<f8").tobytes() if binary else (" ".join(f"{c:.12g}" for c in r) + "\n").encode())
    tmp.replace(path)
    return n
