"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free_name, materialize

#: Words: runs of anything but space and the controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    #: Documents of one leaf of the reduction tree, and children of its inner nodes.
    leaf: int = 1000
    fan_in: int = 64
    seed: int = 20


def ranked_sources(own: DataFrame) -> DataFrame:
    """``own`` with a column rank: the place of each source by code point, null last, without one task for all.

    Sources are dealt into ranges, numbered inside each, and moved on by the sizes of
    the ranges before, of which there are as many as shuffle partitions.
    """
    spark = own.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "mix-ranges")
    counts, before, at = ranged.groupBy("range").count().orderBy("range").collect(), [(-1, 0)], 0
    for r in counts:
        before.append((r["range"], at))
        at += r["count"]
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    first = F.broadcast(spark.createDataFrame(before, "range int, first long"))  # a row a range
    return ranged.withColumn("inside", inside).join(first, "range").withColumn("rank", F.col("first") + F.col("inside")).drop("range", "inside", "first")


def source_targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """(source, source_size, target) of a table with columns source and size.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn.  The
    total is ``share`` times all sizes; a target stops at ``most`` times its source's
    size and the excess is shared again by weight until none is above.  Only two sums a
    round reach the driver.
    """
    own = ranked_sources(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    weight = F.array(*[F.lit(float(w)) for w in params.weights])[F.pmod("rank", F.lit(len(params.weights))).cast("int")]
    table = materialize(own.select("source", "source_size", weight.alias("weight"), (F.lit(params.most) * F.col("source_size")).alias("cap")), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0]
    left, level, below = params.share * float(total or 0), 0.0, F.lit(False)
    rounds = table.count() + 1
    for _ in range(rounds):
        free = table.filter(~below)
        r = free.agg(F.sum("weight")).first()[0]
        if not r:
            break
        level = left / r
        above = free.filter(F.col("cap") < F.lit(level) * F.col("weight")).agg(F.sum("cap"), F.count("*")).first()
        if not above[1]:
            break
        left -= above[0]
        below = below | (F.col("cap") < F.lit(level) * F.col("weight"))
    target = F.when(below, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(a: int, b: int, seed: int) -> float:
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def pair_off(held: list | None, new: list, seed: int) -> tuple[list | None, list]:
    """One pivotal step between two fractional items [tie, size, p, ...]: (what stays fractional, what is settled).

    Words move from one to the other, p * size in sum unchanged, until one is at 0 or 1;
    each p is kept in expectation.
    """
    if held is None:
        return new, []
    si, pi = held[1:3]
    sj, pj = new[1:3]
    up = min((1 - pi) * si, pj * sj)  # words that can move to the held one
    down = min(pi * si, (1 - pj) * sj)
    if _uniform(held[0], new[0], seed) * (up + down) < down:
        a, b = pi + up / si, pj - up / sj
        i_full, j_full = (1 - pi) * si <= pj * sj, pj * sj <= (1 - pi) * si
        held[2], new[2] = (1.0 if i_full else a), (0.0 if j_full else b)
    else:
        a, b = pi - down / si, pj + down / sj
        i_full, j_full = pi * si <= (1 - pj) * sj, (1 - pj) * sj <= pi * si
        held[2], new[2] = (0.0 if i_full else a), (1.0 if j_full else b)
    for x in (held, new):
        x[2] = min(max(x[2], 0.0), 1.0)
    done = [x for x in (held, new) if x[2] in (0.0, 1.0)]
    rest = [x for x in (held, new) if x[2] not in (0.0, 1.0)]
    return (rest[0] if rest else None), done


def _tie():
    """A hash of what makes a document: doc_id, source and text."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    return F.xxhash64(F.col("doc_id").cast("long"), source.isNull(), source, text.isNull(), text)


_NODE = "group_key long, node long, doc_id long, tie long, size long, p double"


def _settle(seed: int, last: bool):
    """Runs each (group_key, node) of a sorted partition as one chain; holds one fractional item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None

        def closed() -> list[tuple]:
            if held is None:
                return []
            p = held[2]
            if last:  # the single item left of a source goes to the nearer side
                p = 1.0 if p >= 0.5 else 0.0
            return [(*at, held[3], held[0], held[1], p)]

        for batch in batches:
            out: list[tuple] = []
            for group, node, doc, tie, size, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, node) != at:
                    out += closed()
                    held, at = None, (group, node)
                if p <= 0.0 or p >= 1.0:
                    out.append((group, node, doc, tie, size, min(max(p, 0.0), 1.0)))
                    continue
                held, done = pair_off(held, [tie, size, p, doc], seed)
                out += [(group, node, x[3], x[0], x[1], x[2]) for x in done]
            yield _rows(out)
        yield _rows(closed())

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    types = [pa.int64()] * 5 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _NODE.split(", ")])


def _mixed_items(docs: DataFrame, p: MixParams) -> DataFrame:
    """One row per document (doc_id, source, tie): size, n equal rows, whole copies of each, extra copies of all."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        _tie().alias("tie"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    items = materialize(keyed.groupBy("doc_id", "source", "tie").agg(F.min("size").alias("size"), F.count("*").alias("n")), "mix-items")
    leaves = max(1, -(-items.count() // p.leaf))
    group_key = F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("group_key")
    targets = materialize(source_targets(items.select("source", (F.col("size") * F.col("n")).alias("size")), p).select(group_key, "source_size", "target"), "mix-targets")
    if targets.count() <= 100_000:  # a few words a source: small enough for every executor
        targets = F.broadcast(targets)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = items.select("*", group_key).join(targets, "group_key").withColumns({"whole": F.floor(ratio).cast("long"), "part": F.col("n") * (ratio - F.floor(ratio))})
    node = F.pmod(F.xxhash64("tie", F.lit(p.seed)), F.lit(leaves)).alias("node")
    rows = materialize(rows.withColumns({"certain": F.floor("part").cast("long"), "part": F.col("part") - F.floor("part")}), "mix-rows")
    open_rows = rows.filter("size > 0 and part > 0").select("group_key", node, "doc_id", "tie", "size", F.col("part").alias("p"))
    settled, level = [], 0
    while True:
        last = leaves == 1
        chained = open_rows.repartition("group_key", "node").sortWithinPartitions("group_key", "node", F.col("size").desc(), "tie", "doc_id")
        done = materialize(chained.mapInArrow(_settle(p.seed + level, last), _NODE), f"mix-level{level}")
        settled.append(done.filter("p = 1.0").select("group_key", "doc_id", "tie"))
        if last:
            break
        leaves, level = -(-leaves // p.fan_in), level + 1
        # The next level's items carry what their subtree left over.
        open_rows = done.filter("p > 0.0 and p < 1.0").withColumn("node", F.floor(F.col("node") / p.fan_in).cast("long"))
    more = settled[0]
    for s in settled[1:]:
        more = more.unionByName(s)
    more = more.select(F.col("group_key").alias("g"), F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.lit(1).alias("one"))
    same = (F.col("tie") == F.col("t")) & (F.col("group_key") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d"))
    return rows.join(more, same, "left").withColumn("extra", F.col("certain") + F.coalesce("one", F.lit(0))).drop("g", "d", "t", "one", "part", "certain")


def mix_sources(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Copies of each document: doc_id, source, size, source_size, target, copies, taken.

    A source of target T and size S takes each of its documents T / S times on average:
    the whole part for certain, one more copy with the fraction's probability.  The
    fractions are rounded together: pairs exchange words until one of them is settled,
    so a source's sum of words stays at its target up to the last single document.
    Leaves of hashed documents are chained first; what each leaves over meets others in
    a tree of ``fan_in`` until one item a source is left, which goes to the nearer side.
    All choices are hashes of the documents, so reruns agree.

    A null or empty text has size 0 and is taken 0 times in words; its copies are the
    whole part of the ratio.  Null sources are one source, last in order; a null doc_id
    is kept.  Rows that repeat in all of doc_id, source and text are one item: their
    fractions are added up, so only what is left beyond whole copies is rounded, and the
    first rows of them have one copy more.  Other columns are not read.  An empty table
    gives an empty result.
    """
    items = _mixed_items(docs, params).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("whole") + (F.col("row") <= F.col("extra")).cast("long")
    return items.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken.

    Whole texts are moved once, by a join on the document's hash.  Rows that repeat in
    doc_id, source and text but differ in other columns take their turns by a hash of
    all columns; of such rows only, groups are numbered by a window.  Columns of any
    name stay as they are.
    """
    names = [free_name(docs.columns, c) for c in ("tie", "doc", "copies", "extra", "n", "whole", "times")]
    tie, doc, copies, extra, n, whole, times = names
    items = materialize(_mixed_items(docs, params).select(F.col("tie").alias(tie), F.col("doc_id").alias(doc), "n", "whole", "extra"), "mix-copies")
    own = docs.withColumn(tie, _tie())
    same = (own[tie] == F.col(f"i.{tie}")) & own["doc_id"].cast("long").eqNullSafe(F.col(f"i.{doc}"))
    single = items.filter("n = 1").select(tie, doc, (F.col("whole") + F.col("extra")).alias(copies)).filter(F.col(copies) > 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    often = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(times)
    out = own.join(single.alias("i"), same).select(*[own[f"`{c}`"] for c in docs.columns], F.col(copies)).select(*columns, often).drop(times)
    many = items.filter("n > 1").select(tie, doc, F.col("extra").alias(extra), F.col("whole").alias(whole))
    if many.isEmpty():
        return out
    rows = own.join(many.alias("i"), same).select(*[own[f"`{c}`"] for c in docs.columns], own[tie], F.col(extra), F.col(whole))
    rank = F.row_number().over(Window.partitionBy(tie, "doc_id", extra).orderBy(F.xxhash64(*columns)))
    rows = rows.withColumn(n, rank).withColumn(copies, F.col(whole) + (F.col(n) <= F.col(extra)).cast("long")).filter(F.col(copies) > 0)
    return out.unionByName(rows.select(*columns, often).drop(times))
