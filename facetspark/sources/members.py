"""Points and inliers of all groups of a project as two tables, wherever Spark can write.

The points of a group are numbered in the order of their ids; ``local_idx`` is that number.
A save replaces the groups that it holds and leaves the others, as partitions are overwritten
one by one.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..operators.quantiles import join_groups
from ..scratch import materialize

_ENTITY = ["group_id", "kind", "entity"]
_INLIERS = "group_id long, kind string, entity int, point_id long"


def _replace_groups(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_id").parquet(path)


def save_points(store: str, points: DataFrame) -> None:
    """Points (group_id, point_id, x, y, z) with their numbers; of repeated ids of a group the first row by x, y, z stays."""
    own = points.select(F.col("group_id").cast("long").alias("group_id"), F.col("point_id").cast("long").alias("point_id"), F.struct("x", "y", "z").alias("p"))
    own = own.groupBy("group_id", "point_id").agg(F.min("p").alias("p")).select("group_id", "point_id", "p.*")
    _replace_groups(numbered(own, ["point_id"], "local_idx", ["group_id"]), f"{store}/points")


def load_points(spark: SparkSession, store: str) -> DataFrame:
    """(group_id, point_id, x, y, z, local_idx) of all saved groups; a filter on group_id reads that group alone."""
    return spark.read.parquet(f"{store}/points").select(F.col("group_id").cast("long").alias("group_id"), "point_id", "x", "y", "z", "local_idx")


def rebase_local(local: DataFrame, points: DataFrame) -> DataFrame:
    """Inliers (group_id, kind, entity, local_idx) by point_id; a number that its group does not have is an error."""
    known = points.select("group_id", "local_idx", "point_id")
    met = materialize(local.select(*_ENTITY, "local_idx").join(known, ["group_id", "local_idx"], "left"), "inliers-local")
    lost = met.filter("point_id is null").first()
    if lost:
        raise ValueError(f"group {lost['group_id']} {lost['kind']} {lost['entity']}: local index {lost['local_idx']} is out of range")
    return met.select(*_ENTITY, "point_id")


def save_inliers(store: str, entities: DataFrame, source: DataFrame | None = None, local: DataFrame | None = None) -> DataFrame:
    """Inliers of the fits ``entities`` (group_id, kind, entity), and how many each has: (group_id, kind, entity, inlier_n).

    ``source`` has ids of points (point_id), ``local`` numbers among the group's points
    (local_idx).  Where an entity has both, its ids win.  Every group of ``entities`` is
    written anew, so what an earlier save had of other entities is gone; inliers of
    entities that are not listed are not written.  Repeated inliers count once.
    """
    spark = entities.sparkSession
    listed = materialize(entities.select(F.col("group_id").cast("long").alias("group_id"), F.col("kind").cast("string").alias("kind"), F.col("entity").cast("int").alias("entity")).distinct(), "inliers-entities")
    ids = source.select(*_ENTITY, "point_id") if source is not None else spark.createDataFrame([], _INLIERS)
    ids = ids.join(listed, _ENTITY, "left_semi")
    if local is not None:
        own = local.join(listed, _ENTITY, "left_semi").join(ids.select(*_ENTITY).distinct(), _ENTITY, "left_anti")
        ids = ids.unionByName(rebase_local(own, load_points(spark, store)))
    ids = materialize(ids.filter("point_id is not null").distinct(), "inliers")
    # A row without a point marks a group whose entities have none, so that its partition is replaced too.
    null = F.lit(None)
    marks = listed.select("group_id").distinct().select("group_id", null.cast("string").alias("kind"), null.cast("int").alias("entity"), null.cast("long").alias("point_id"))
    _replace_groups(ids.select("group_id", "kind", "entity", "point_id").unionByName(marks).repartition("group_id", "kind", "entity"), f"{store}/inliers")
    counts = ids.groupBy(*_ENTITY).agg(F.count("*").alias("inlier_n"))
    return listed.join(counts, _ENTITY, "left").na.fill(0, ["inlier_n"])


def load_inliers(spark: SparkSession, store: str) -> DataFrame:
    """(group_id, kind, entity, point_id, local_idx) of all saved fits.

    ``local_idx`` is null for all inliers of a fit of which some are not among its group's points.
    """
    rows = spark.read.parquet(f"{store}/inliers").filter("point_id is not null").select(F.col("group_id").cast("long").alias("group_id"), "kind", "entity", "point_id")
    met = rows.join(load_points(spark, store).select("group_id", "point_id", "local_idx"), ["group_id", "point_id"], "left")
    whole = met.groupBy(*_ENTITY).agg((F.count("local_idx") == F.count("*")).alias("whole"))
    return join_groups(met, whole, _ENTITY).select(*_ENTITY, "point_id", F.when(F.col("whole"), F.col("local_idx")).alias("local_idx"))


_KIND = {"": None, "p": "plane", "cyl": "cylinder", "cir": "circle"}


def read_index_files(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, kind, entity, place, point_id) of the ``.npy`` index files of a project's groups.

    ``group_003_indices.npy`` lists a group's points (kind and entity null),
    ``group_003_p0_indices.npy`` those of its plane 0; ``cyl`` and ``cir`` are cylinders and
    circles.  A file is read by one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "group_*_indices.npy").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = re.search(r"group_(\d+)(?:_(p|cyl|cir)(\d+))?_indices\.npy$", path)
                if not m:
                    continue
                ids = np.load(io.BytesIO(content), allow_pickle=False).astype(np.int64).ravel()
                kind, entity = _KIND[m[2] or ""], int(m[3]) if m[3] else None
                for i in range(0, len(ids), 100_000):
                    part = ids[i : i + 100_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(m[1])] * n, pa.int64()), pa.array([kind] * n, pa.string()), pa.array([entity] * n, pa.int32()), pa.array(np.arange(i, i + n)), pa.array(part)],
                        ["group_id", "kind", "entity", "place", "point_id"],
                    )

    return files.mapInArrow(run, "group_id long, kind string, entity int, place long, point_id long")


def fit_names(fits: DataFrame) -> DataFrame:
    """``fits`` with the name of each entity: G3_p0, G3_cyl0 or G3_cir0."""
    short = F.when(F.col("kind") == "plane", "p").when(F.col("kind") == "cylinder", "cyl").otherwise("cir")
    return fits.withColumn("name", F.concat(F.lit("G"), F.col("group_id").cast("string"), F.lit("_"), short, F.col("entity").cast("string")))
