"""Point selections: slabs, balls, shells, rectangles; range joins by cells; connected grid cells; set operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Vec, axis_distance, fine_code, inplane_basis, signed_distance
from ..scratch import materialize
from .numbering import numbered
from .quantiles import join_groups


def slab(cloud: DataFrame, n: Vec, d, threshold: float, around: Vec | None = None, radius: float | None = None) -> DataFrame:
    """Points within ``threshold`` of a plane and, if given, within an in-plane ``radius`` of a point."""
    p = Vec.cols("x", "y", "z")
    keep = F.abs(signed_distance(p, n, d)) <= threshold
    if around is not None and radius is not None:
        u, v = inplane_basis(n)
        keep = keep & (F.hypot((p - around).dot(u), (p - around).dot(v)) <= radius)
    return cloud.filter(keep)


def ball(cloud: DataFrame, center: Vec, radius: float) -> DataFrame:
    """Points within ``radius`` of a center, the border included; the box predicates reach the scan."""
    p = Vec.cols("x", "y", "z")
    box = [(a >= b - radius) & (a <= b + radius) for a, b in ((p.x, center.x), (p.y, center.y), (p.z, center.z))]
    return cloud.filter(box[0] & box[1] & box[2] & ((p - center).norm2() <= radius * radius))


def shell_size(radius: float, half_width: float | None = None, half_length: float | None = None) -> tuple[float, float]:
    """Half width and half length of a cylinder shell; None or 0 means by the radius."""
    r = max(radius, 1e-6)
    width = half_width if half_width and half_width > 0 else max(6.0, 0.15 * r)
    length = half_length if half_length and half_length > 0 else max(40.0, r)
    return width, length


def cylinder_shell(cloud: DataFrame, point: Vec, direction: Vec, radius: float, width: float, length: float) -> DataFrame:
    """Points whose axis distance is within ``width`` of the radius, and within ``length`` of the point along the axis."""
    p = Vec.cols("x", "y", "z")
    rho = axis_distance(p, point, direction)
    return cloud.filter((F.abs(rho - radius) <= width) & (F.abs((p - point).dot(direction)) <= length))


def rectangle(frame: DataFrame, u: Column, v: Column, u_range: tuple[float, float], v_range: tuple[float, float]) -> DataFrame:
    return frame.filter(u.between(*u_range) & v.between(*v_range))


#: Points of one tile at most.  Lists this short repeat from center to center within a page of a written result.
TILE_POINTS = 128
#: A margin on the reach of a ball in cubes, far above what rounding can shift.
WIDER = 1 + 2**-20


def _cut_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        *keys, ids, x, y, z = b.columns
        at = np.arange(b.num_rows)
        first = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            k = k.to_numpy(zero_copy_only=False)
            first[1:] |= k[1:] != k[:-1]
        run = np.maximum.accumulate(np.where(first, at, 0))
        start = np.flatnonzero((at - run) % TILE_POINTS == 0)
        box = [f.reduceat(c.to_numpy(), start) for c in (x, y, z) for f in (np.minimum, np.maximum)]
        points = pa.StructArray.from_arrays([ids, x, y, z], ["point_id", "x", "y", "z"])
        lists = pa.ListArray.from_arrays(pa.array([*start, b.num_rows], pa.int32()), points)
        names = [*b.schema.names[: len(keys)], "x0", "x1", "y0", "y1", "z0", "z1", "points"]
        yield pa.RecordBatch.from_arrays([*(k.take(pa.array(start)) for k in keys), *map(pa.array, box), lists], names)


def tiles(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, x1, y0, y1, z0, z1, points): runs of at most ``TILE_POINTS`` rows of equal long keys, with their box.

    Rows (keys, point_id, x, y, z) without nulls are taken as they lie, so neighbours in space should lie together.
    """
    id_type = dict(points.dtypes)["point_id"]
    schema = ", ".join([*(f"{k} long" for k in keys), *(f"{a}{i} double" for a in "xyz" for i in (0, 1)), f"points array<struct<point_id: {id_type}, x: double, y: double, z: double>>"])
    return points.select(*keys, "point_id", *(F.col(a).cast("double").alias(a) for a in "xyz")).mapInArrow(_cut_tiles, schema)


def tile_join(tiled: DataFrame, centers: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """(center_id, point_id) within ``radius``, of tiles and centers (keys, center_id, qx, qy, qz) of equal keys.

    Tiles beyond a center are dropped by their box; rounding is monotone, so no point of such a tile would pass.
    A tile meets its centers one after another, so a written result holds runs of a center beside a repeated list.
    Both sides keep all shuffle partitions: few bytes make many pairs, so partitions must not be united by their bytes.
    """
    parts = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled, centers = tiled.repartition(parts, *keys), centers.repartition(parts, *keys)

    def square(far: list[Column]) -> Column:
        return sum((c * c for c in far), F.lit(0.0)) <= radius * radius

    gap = [F.greatest(F.col(f"{a}0") - F.col(f"q{a}"), F.col(f"q{a}") - F.col(f"{a}1"), F.lit(0.0)) for a in "xyz"]
    met = tiled.join(centers, keys).filter(square(gap)).select("center_id", "qx", "qy", "qz", F.inline("points"))
    return met.filter(square([F.col(a) - F.col(f"q{a}") for a in "xyz"])).select("center_id", "point_id")


def radius_join(cloud: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """(center_id, point_id) of all points within ``radius`` of each center (center_id, x, y, z).

    A range join as an equi-join: points fall in cubes of the radius and in tiles of
    neighbours there, each center is exploded to its 27 cubes, and the exact distance is
    tested on what meets.  Either side may be large; the adaptive planner splits crowded cubes.
    """
    side = radius * WIDER
    cell = {f"c{a}": F.floor(F.col(a) / side).cast("long") for a in "xyz"}
    keys = list(cell)
    p = cloud.select("point_id", "x", "y", "z").dropna(subset=["x", "y", "z"]).withColumns(cell)
    inner = fine_code([F.col(a) / side - F.col(f"c{a}") for a in "xyz"])
    p = p.repartition(*keys).withColumn("inner", inner).sortWithinPartitions(*keys, "inner")
    c = centers.select("center_id", *(F.col(a).alias(f"q{a}") for a in "xyz"))
    for a in "xyz":
        base = F.floor(F.col(f"q{a}") / side).cast("long")
        c = c.withColumn(f"c{a}", F.explode(F.sequence(base - 1, base + 1)))
    return tile_join(tiles(p, keys), c, keys, radius)


#: Side of the square of cells that one task labels: a quarter of a million cells at most.
TILE = 512


def _tile_roots(iu: np.ndarray, iv: np.ndarray) -> np.ndarray:
    """Of each cell the place of its component's largest cell, all cells being in row-major order."""
    n = len(iu)
    root = np.arange(n)
    code = iu * (4 * TILE) + iv
    links = []
    for step in (1, 4 * TILE):
        at = np.minimum(np.searchsorted(code, code + step), n - 1)
        hit = np.flatnonzero(code[at] == code + step)
        links.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    while True:
        # Each end's root points to the larger of the two, then all pointers are followed.
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.maximum.at(root, np.minimum(x, y), np.maximum(x, y))
        while (root[root] != root).any():
            root = root[root]


def component_roots(cells: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, iu, iv, ru, rv): of each occupied cell the largest cell, in row-major order, of its 4-connected component.

    Squares of ``TILE`` by ``TILE`` cells are labelled in a task each.  Components that
    touch across the border of squares are then joined: each round a component takes the
    largest root among itself and those it touches, then the root of the one it points to,
    until none changes.  Only components that touch a border take part in these rounds.
    """
    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "iu long, iv long, ru long, rv long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iu", "iv"])
        iu, iv = pdf["iu"].to_numpy(dtype=np.int64), pdf["iv"].to_numpy(dtype=np.int64)
        root = _tile_roots(iu - iu.min(), iv - iv.min())
        return pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, "iu": iu, "iv": iv, "ru": iu[root], "rv": iv[root]})

    own = cells.select(*keys, F.col("iu").cast("long").alias("iu"), F.col("iv").cast("long").alias("iv"))
    tile = [F.floor(F.col(c) / TILE).alias(f"tile_{c}") for c in ("iu", "iv")]
    done = materialize(own.groupBy(*keys, *tile).applyInPandas(run, schema), "cells")
    root = F.struct("ru", "rv").alias("root")
    touch = None
    for c, o in (("iu", "iv"), ("iv", "iu")):
        last = done.filter(F.pmod(c, F.lit(TILE)) == TILE - 1).select(*keys, (F.col(c) + 1).alias(c), o, root)
        first = done.filter(F.pmod(c, F.lit(TILE)) == 0).select(*[F.col(k).alias(f"{k}__of") for k in keys], F.col(c).alias("c__"), F.col(o).alias("o__"), root.alias("near"))
        met = last.join(first, [F.col(k).eqNullSafe(F.col(f"{k}__of")) for k in keys] + [F.col(c) == F.col("c__"), F.col(o) == F.col("o__")])
        met = met.select(*keys, "root", "near")
        touch = met if touch is None else touch.unionByName(met)
    touch = materialize(touch.unionByName(touch.select(*keys, F.col("near").alias("root"), F.col("root").alias("near"))).distinct(), "cells-touch")
    if touch.isEmpty():
        return done
    cur = touch.select(*keys, "root").distinct().withColumn("top", F.col("root"))
    mark = None
    while True:
        by = touch.withColumnRenamed("root", "from").withColumnRenamed("near", "root")
        sent = join_groups(by, cur, [*keys, "root"]).select(*keys, F.col("from").alias("root"), "top")
        best = materialize(sent.unionByName(cur).groupBy(*keys, "root").agg(F.max("top").alias("top")), "cells-top")
        to = best.select(*keys, F.col("root").alias("top"), F.col("top").alias("far"))
        cur = materialize(join_groups(best, to, [*keys, "top"], "left").select(*keys, "root", F.greatest("top", F.coalesce("far", "top")).alias("top")), "cells-top")
        now = tuple(cur.agg(F.sum(F.xxhash64("root", "top").cast("decimal(38,0)")), F.count("*")).first())
        if now == mark:
            break
        mark = now
    out = join_groups(done.withColumn("root", root), cur, [*keys, "root"], "left")
    return out.select(*keys, "iu", "iv", F.coalesce("top", "root").alias("top")).select(*keys, "iu", "iv", "top.ru", "top.rv")


def grid_components(cells: DataFrame) -> DataFrame:
    """(iu, iv, label) of occupied cells: 4-connected components, numbered 1, 2, ... by their largest cell in row-major order."""
    of = component_roots(cells)
    roots = numbered(of.filter("iu = ru AND iv = rv").select("ru", "rv"), ["ru", "rv"], "number")
    return of.join(roots, ["ru", "rv"]).select("iu", "iv", (F.col("number") + 1).cast("int").alias("label"))


def main_component(cells: DataFrame, labels: DataFrame, clicked: tuple[int, int] | None = None) -> tuple[int, list[str]]:
    """The label under the clicked cell, else that of most points (the first of equal ones), with the reason."""
    reasons = []
    if clicked is not None:
        hit = labels.filter((F.col("iu") == clicked[0]) & (F.col("iv") == clicked[1])).first()
        if hit:
            return hit["label"], reasons
        reasons.append("click_not_on_component_using_largest")
    sizes = cells.join(labels, ["iu", "iv"]).groupBy("label").agg(F.sum("cnt").alias("n"))
    top = sizes.orderBy(F.col("n").desc(), "label").first()
    return (top["label"] if top else 0), reasons


def merge_groups(members: DataFrame, groups: list[int], into: int) -> DataFrame:
    """(group_id, point_id) where the named groups are one, each point once."""
    group = F.when(F.col("group_id").isin(groups), F.lit(into)).otherwise(F.col("group_id"))
    return members.select(group.cast(dict(members.dtypes)["group_id"]).alias("group_id"), "point_id").distinct()


def rebase_to_source(local: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, point_id) of local indices (group_id, local_idx) through members (group_id, local_idx, point_id)."""
    return local.join(members, ["group_id", "local_idx"]).select("group_id", "point_id")
