"""A kept index of a cloud: points keyed by the Morton code of their cell, in its order, with small row groups.

Neighbours in space are mostly neighbours in the files, so the minimum and maximum of the key
in each row group's footer let the reader skip what a ball cannot reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Vec, fine_code, morton
from ..operators.regions import WIDER, tile_join, tiles

#: Bits of a cell number along each axis.
BITS = 21
VERSION = 1
_P = ("x", "y", "z")


@dataclass(frozen=True)
class CloudIndex:
    """Where a cloud's index lies, and the grid that its keys stand for."""

    path: str
    low: tuple[float, float, float]
    cell: float
    n_points: int
    fingerprint: str

    def points(self, spark: SparkSession) -> DataFrame:
        """(point_id, x, y, z, key)"""
        return spark.read.parquet(f"{self.path}/points")

    def cells(self, at: Vec) -> list[Column]:
        return [F.floor((c - F.lit(o)) / F.lit(self.cell)).cast("long") for c, o in zip((at.x, at.y, at.z), self.low, strict=True)]


def cloud_fingerprint(cloud: DataFrame) -> str:
    """Changes with any point: their number, and the sum of a hash of each."""
    n, total = cloud.agg(F.count("*"), F.sum(F.xxhash64("point_id", *_P).cast("decimal(38,0)"))).first()
    return f"{VERSION}:{n}:{total or 0}"


def build_index(cloud: DataFrame, path: str, cell: float, row_group_bytes: int = 256 << 10) -> CloudIndex:
    """Writes the index of a cloud (point_id, x, y, z); points without finite coordinates are left out.

    One shuffle by ranges of the key and of the place inside its cell, sorted inside.  A cloud of more than two million
    cells along an axis needs a larger cell, which is an error.
    """
    if not cell > 0:
        raise ValueError("the cell must be positive")
    spark = cloud.sparkSession
    finite = [F.abs(F.col(c)) < float("inf") for c in _P]
    own = cloud.select("point_id", *_P).filter(finite[0] & finite[1] & finite[2])
    row = own.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in _P for k, f in (("0", F.min), ("1", F.max))]).first()
    low = tuple(row[f"{c}0"] or 0.0 for c in _P)
    if row["n"] and max((row[f"{c}1"] - row[f"{c}0"]) / cell for c in _P) >= 1 << BITS:
        raise ValueError("too many cells along an axis: take a larger cell")
    index = CloudIndex(path, low, float(cell), row["n"], cloud_fingerprint(own))
    cells = index.cells(Vec.cols(*_P))
    inner = fine_code([(F.col(a) - F.lit(o)) / F.lit(index.cell) - c for a, o, c in zip(_P, low, cells, strict=True)])
    keyed = own.withColumns({"key": morton(cells), "inner": inner})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "inner", "point_id")
    keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("inner").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(f"{path}/points")
    meta = [(VERSION, index.fingerprint, index.cell, *index.low, index.n_points)]
    spark.createDataFrame(meta, "version int, fingerprint string, cell double, x0 double, y0 double, z0 double, n_points long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return index


def open_index(spark: SparkSession, path: str, fingerprint: str | None = None, cell: float | None = None) -> CloudIndex | None:
    """The index at ``path``, or None where there is none, or one of another version, cloud or cell: build it anew then."""
    from pyspark.errors import AnalysisException

    try:
        r = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException:
        return None
    if r is None or r["version"] != VERSION or (fingerprint is not None and r["fingerprint"] != fingerprint) or (cell is not None and r["cell"] != cell):
        return None
    return CloudIndex(path, (r["x0"], r["y0"], r["z0"]), r["cell"], r["n_points"], r["fingerprint"])


def kept_index(cloud: DataFrame, path: str, cell: float) -> CloudIndex:
    """The index at ``path`` if it is of this cloud and cell, else a new one."""
    return open_index(cloud.sparkSession, path, cloud_fingerprint(cloud), cell) or build_index(cloud, path, cell)


def key_ranges(low: tuple[int, int, int], high: tuple[int, int, int], most: int = 48) -> list[tuple[int, int]]:
    """At most about ``most`` intervals [first, last] of keys that cover a box of cells, both corners included.

    Cubes of halving side are split while they cross the box's border; the intervals of
    neighbours are joined.  What they cover beyond the box is for the exact test to drop.
    """
    top = (1 << BITS) - 1
    low, high = tuple(max(0, c) for c in low), tuple(min(top, c) for c in high)
    if any(a > b for a, b in zip(low, high, strict=True)):
        return []
    done: list[tuple[int, int, tuple]] = []
    border = [(BITS, (0, 0, 0), 0)]  # (level, corner, first key)
    while border and len(done) + len(border) < most:
        parts = []
        for level, corner, first in border:
            half = 1 << (level - 1)
            for octant in range(8):
                at = tuple(c + half * ((octant >> (2 - i)) & 1) for i, c in enumerate(corner))
                if any(a > h or a + half - 1 < b for a, b, h in zip(at, low, high, strict=True)):
                    continue
                own = first + (octant << (3 * (level - 1)))
                inside = all(a >= b and a + half - 1 <= h for a, b, h in zip(at, low, high, strict=True))
                if inside or level == 1:
                    done.append((own, own + (1 << (3 * (level - 1))) - 1, at))
                else:
                    parts.append((level - 1, at, own))
        border = parts
    spans = sorted([(a, b) for a, b, _ in done] + [(first, first + (1 << (3 * level)) - 1) for level, _, first in border])
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def index_ball(spark: SparkSession, index: CloudIndex, center: tuple[float, float, float], radius: float, most: int = 48) -> DataFrame:
    """Points (point_id, x, y, z) within ``radius`` of a center, the border included; only key ranges of its box are read."""
    corners = [[int((c + s * radius - o) // index.cell) for c, o in zip(center, index.low, strict=True)] for s in (-1, 1)]
    ranges = key_ranges(tuple(corners[0]), tuple(corners[1]), most)
    points = index.points(spark)
    if not ranges:
        return points.filter("false").select("point_id", *_P)
    keep = F.lit(False)
    for a, b in ranges:
        keep = keep | F.col("key").between(a, b)
    near = (Vec.cols(*_P) - Vec.of(*center)).norm2() <= radius * radius
    return points.filter(keep & near).select("point_id", *_P)


def index_balls(spark: SparkSession, index: CloudIndex, centers: DataFrame, radius: float) -> DataFrame:
    """(center_id, point_id) within ``radius`` of any number of centers (center_id, x, y, z): a join on the kept key.

    The leading bits of a key name a cube of 1, 2, 4, ... cells along each side.  Tiles are cut from
    the points as they are kept, and a center is exploded to the 27 cubes or so that its ball may touch.
    """
    level = 0
    while level < BITS and index.cell * (1 << level) < radius:
        level += 1
    c = centers.select("center_id", *[F.col(a).alias(f"q{a}") for a in _P])
    top = ((1 << BITS) - 1) >> level
    for name, a, o in zip("ijk", _P, index.low, strict=True):
        first, last = (F.floor((F.col(f"q{a}") + s * radius * WIDER - o) / (index.cell * (1 << level))).cast("long") for s in (-1, 1))
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(top))
        c = c.filter(first <= last).withColumn(name, F.explode(F.sequence(first, last)))
    c = c.withColumn("cube", morton([F.col(n) for n in "ijk"])).drop("i", "j", "k")
    points = index.points(spark).withColumn("cube", F.shiftright("key", 3 * level))
    return tile_join(tiles(points, ["cube"]), c, ["cube"], radius)
