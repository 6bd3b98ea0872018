"""Point clouds over the star-schema tables: (point_id, grp, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def cloud_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(
        spark, sf_dir, "orders", "o_orderkey AS point_id", "o_orderpriority AS grp", "o_totalprice / 1000 AS x",
        "CAST(datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS DOUBLE) AS y", "CAST(o_custkey % 97 AS DOUBLE) AS z",
    )


def cloud_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(
        spark, sf_dir, "embeddings", "vec_id AS point_id", "label AS grp", "CAST(embedding[0] AS DOUBLE) * 1000 AS x",
        "CAST(embedding[1] AS DOUBLE) * 1000 AS y", "CAST(embedding[2] AS DOUBLE) * 1000 AS z",
    )


def cloud_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(
        spark, sf_dir, "part", "p_partkey AS point_id", "p_brand AS grp", "p_retailprice / 100 AS x",
        "CAST(p_size AS DOUBLE) AS y", "CAST(p_partkey % 50 AS DOUBLE) AS z",
    )


def cloud_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No identity: only for aggregates."""
    return _read(spark, sf_dir, "lineitem", "l_returnflag AS grp", "l_quantity AS x", "l_extendedprice / 1000 AS y", "l_discount * 100 AS z")


def depth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", "event_id AS point_id", "event_type AS grp", "value AS t")


def plane_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a scanned plane z = 0.3 x - 0.5 y + noise; every 7th point lies 3 to 5 mm off."""
    return _read(
        spark, sf_dir, "orders", "o_orderkey AS point_id", "CAST(o_orderkey % 200 AS DOUBLE) AS x", "CAST(floor(o_orderkey / 200) % 100 AS DOUBLE) AS y",
        "0.3 * (o_orderkey % 200) - 0.5 * (floor(o_orderkey / 200) % 100) + ((o_orderkey * 7919) % 101 - 50) / 1000.0D"
        " + CASE WHEN o_orderkey % 7 = 0 THEN 3 + (o_orderkey % 5) * 0.5D ELSE 0D END AS z",
    )


def plane_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as eleven scanned planes, each with a slope of its own, with noise; every 7th point lies 3 to 5 mm off."""
    return _read(
        spark, sf_dir, "orders", "o_orderkey AS point_id", "o_orderkey % 11 AS grp", "CAST(o_orderkey % 200 AS DOUBLE) AS x", "CAST(floor(o_orderkey / 200) % 100 AS DOUBLE) AS y",
        "0.05D * (o_orderkey % 11) * (o_orderkey % 200) - 0.5 * (floor(o_orderkey / 200) % 100) + ((o_orderkey * 7919) % 101 - 50) / 1000.0D"
        " + CASE WHEN o_orderkey % 7 = 0 THEN 3 + (o_orderkey % 5) * 0.5D ELSE 0D END AS z",
    )


def turned_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points of a rectangle with sides along (2, 2, -1) / 3 and (-1, 2, 2) / 3, denser in one corner, with noise."""
    a, b = "((o_orderkey % 200) * (o_orderkey % 200) / 200)", "(pow(floor(o_orderkey / 200) % 100, 2) / 100)"
    r = "(((o_orderkey * 7919) % 101 - 50) / 1009.0D)"
    return _read(
        spark, sf_dir, "orders", "o_orderkey AS point_id",
        *(f"({i} * {a} + {j} * {b} + {k} * {r}) / 3 AS {n}" for n, i, j, k in (("x", 2, -1, 2), ("y", 2, 2, -1), ("z", -1, 2, 2))),
    )


#: The same clouds for an SQL engine with one-based lists.
SQL = {
    "cloud_orders": "SELECT o_orderkey AS point_id, o_orderpriority AS grp, o_totalprice / 1000 AS x,"
    " CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y, CAST(o_custkey % 97 AS DOUBLE) AS z FROM orders",
    "cloud_embeddings": "SELECT vec_id AS point_id, label AS grp, CAST(embedding[1] AS DOUBLE) * 1000 AS x,"
    " CAST(embedding[2] AS DOUBLE) * 1000 AS y, CAST(embedding[3] AS DOUBLE) * 1000 AS z FROM embeddings",
    "cloud_part": "SELECT p_partkey AS point_id, p_brand AS grp, p_retailprice / 100 AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey % 50 AS DOUBLE) AS z FROM part",
    "cloud_lineitem": "SELECT l_returnflag AS grp, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem",
    "depth_events": "SELECT event_id AS point_id, event_type AS grp, value AS t FROM events",
    "plane_scene": "SELECT o_orderkey AS point_id, CAST(o_orderkey % 200 AS DOUBLE) AS x, CAST((o_orderkey // 200) % 100 AS DOUBLE) AS y,"
    " CAST(0.3 AS DOUBLE) * (o_orderkey % 200) - CAST(0.5 AS DOUBLE) * ((o_orderkey // 200) % 100) + ((o_orderkey * 7919) % 101 - 50) / CAST(1000 AS DOUBLE)"
    " + CASE WHEN o_orderkey % 7 = 0 THEN 3 + (o_orderkey % 5) * CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS z FROM orders",
    "plane_scenes": "SELECT o_orderkey AS point_id, o_orderkey % 11 AS grp, CAST(o_orderkey % 200 AS DOUBLE) AS x, CAST((o_orderkey // 200) % 100 AS DOUBLE) AS y,"
    " CAST(0.05 AS DOUBLE) * (o_orderkey % 11) * (o_orderkey % 200) - CAST(0.5 AS DOUBLE) * ((o_orderkey // 200) % 100) + ((o_orderkey * 7919) % 101 - 50) / CAST(1000 AS DOUBLE)"
    " + CASE WHEN o_orderkey % 7 = 0 THEN 3 + (o_orderkey % 5) * CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS z FROM orders",
    # In the face's own coordinates: along its sides, and the residual.
    "turned_face": "SELECT o_orderkey AS point_id, (o_orderkey % 200) * (o_orderkey % 200) / CAST(200 AS DOUBLE) AS a,"
    " pow((o_orderkey // 200) % 100, 2) / CAST(100 AS DOUBLE) AS b, ((o_orderkey * 7919) % 101 - 50) / CAST(1009 AS DOUBLE) AS r FROM orders",
}
