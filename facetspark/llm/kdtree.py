"""Exact top-k inner products: a KD-tree for each shard, best-first traversal, a propagated kth score."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    every: int = 50
    scale: float = 256.0
    #: Rows of a shard, of a leaf of its tree, and queries of a block.
    shard_rows: int = 20_000
    leaf_rows: int = 256
    query_rows: int = 2_000
    #: Rows whose scores give each query its first lower bound of the kth score.
    pilot_rows: int = 2_000


class KDTree:
    """Median splits of the widest dimension, with tight bounding boxes of every node.

    Rows stay in tree order, so a leaf is one slice.  All numbers are integers held in
    doubles; products are exact while dim * max**2 stays below 2**53, else Python
    integers are used.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            part = rows[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            node = len(self.span)
            self.lo.append(lo)
            self.hi.append(hi)
            self.span.append((a, b))
            self.kids.append([])
            if parent is not None:
                self.kids[parent].append(node)
            width = hi - lo
            d = int(width.argmax())
            if b - a > leaf and width[d] > 0:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], mid)]
                todo.append((a, a + mid, node))
                todo.append((a + mid, b, node))
        self.ids, self.rows = ids[order], rows[order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Of each node the largest inner product that its box allows."""
        zero = q * 0
        return np.maximum(q, zero) @ self.hi.T + np.minimum(q, zero) @ self.lo.T

    def search(self, q: np.ndarray, own: int, k: int, best: list[tuple], least) -> list[tuple]:
        """Best-first: ``best`` is a heap of (score, -id), at most k; ``least`` a lower bound of the kth score."""
        bound = self.bounds(q)
        queue = [(-bound[0], 0)]
        while queue:
            top, node = heapq.heappop(queue)
            kth = best[0][0] if len(best) == k else least
            if kth is not None and -top < kth:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if kth is None or bound[kid] >= kth:
                        heapq.heappush(queue, (-bound[kid], kid))
                continue
            a, b = self.span[node]
            scores = self.rows[a:b] @ q
            if kth is not None:
                near = np.flatnonzero(scores >= kth)
            else:
                near = np.arange(b - a)
            near = near[self.ids[a + near] != own]
            if len(near) > 4 * k:
                # Each id once, with its highest score; ties of the kth score are all kept, as the smaller id counts.
                near = near[np.argsort(scores[near], kind="stable")[::-1]]
                near = near[np.unique(self.ids[a + near], return_index=True)[1]]
                if len(near) > k:
                    near = near[scores[near] >= np.partition(scores[near], len(near) - k)[len(near) - k]]
            for j in near:
                item = (scores[j], -int(self.ids[a + j]))
                same = next((x for x in best if x[1] == item[1]), None)
                if same is not None:  # a repeated id counts once, with its higher score
                    if item > same:
                        best[best.index(same)] = item
                        heapq.heapify(best)
                elif len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of a list column of equal lengths, as doubles, or as Python integers if they are too large."""
    rows = np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) * scale)
    rows = rows.reshape(len(column), -1)
    if rows.size and float(np.abs(rows).max()) ** 2 * rows.shape[1] >= 2.0**53:
        exact = np.empty(rows.shape, dtype=object)
        exact[...] = [[int(x) for x in r] for r in rows]
        return exact
    return rows


def _search_shards(k: int, scale: float, leaf: int):
    """Rows sorted by (dim, shard, block, role): a shard's rows come before the queries it meets."""

    def answer(rows: list[pa.RecordBatch], queries: pa.RecordBatch) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        vectors = _matrix(table["v"].chunk(0), scale)
        own = _matrix(queries.column("v"), scale)
        if object in (vectors.dtype, own.dtype):
            vectors, own = vectors.astype(object), own.astype(object)
        tree = KDTree(table["id"].to_numpy(), vectors, leaf)
        out: tuple[list, list, list] = ([], [], [])
        for i, (qid, least) in enumerate(zip(queries.column("id").to_pylist(), queries.column("least").to_pylist(), strict=True)):
            # The own row may be among those that gave the bound only if it was left out there.
            for score, negative in tree.search(own[i], qid, k, [], least):
                out[0].append(qid)
                out[1].append(-negative)
                out[2].append(max(-(2**63), min(2**63 - 1, int(score))))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, asks = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows and asks:
                yield answer(rows, pa.Table.from_batches(asks).combine_chunks().to_batches()[0])

        for batch in batches:
            key = list(zip(*(batch.column(n).to_pylist() for n in ("dim", "shard", "block")), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b <= a:
                    continue
                if key[a] != at:
                    yield from flush()
                    at, rows, asks = key[a], [], []
                part = batch.slice(a, b - a)
                asking = part.column("asks").to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(asking, True))
                if cut:
                    rows.append(part.slice(0, cut))
                if cut < b - a:
                    asks.append(part.slice(cut))
        yield from flush()

    return run


def top_inner_products(vectors: DataFrame, params: TopKParams = TopKParams()) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k highest integer inner products.

    Components become floor(scale * x).  Queries are the rows whose vec_id is divisible
    by ``every``; candidates are all rows but the query's own; ties go to the smaller
    vec_id.  Rows are hashed into shards of about ``shard_rows``, queries into blocks.
    Each (shard, block) task builds the shard's tree and searches it best-first, pruned
    by the kth score among a hashed pilot of rows, which is a true lower bound of the
    final one and goes to every task with the query.  Every row is in one shard, so the
    result is exact; each task returns at most k rows a query, merged by a window.

    Vectors that are null, empty, or hold null or non-finite components take no part,
    nor do rows with a null vec_id; vectors meet only those of their own length.
    Products beyond 2**53 are computed with Python integers and cut to the range of a
    long.  Rows that share a vec_id are candidates of each other's queries only once
    (the higher score) and never of their own id.  Other columns are not read.  An empty
    table gives an empty result.
    """
    p = params
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") > 0)).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("dim", F.size("v"))
    rows = materialize(rows, "topk-rows")
    asks = materialize(rows.filter(F.pmod("id", F.lit(p.every)) == 0), "topk-queries")
    n, m = rows.count(), asks.count()
    shards, blocks = max(1, -(-n // p.shard_rows)), max(1, -(-m // p.query_rows))
    h = F.xxhash64("id", F.lit(11))
    scheme = "query_id long, vec_id long, score long"

    def searched(data: DataFrame, queries: DataFrame, n_shards: int) -> DataFrame:
        """Every (shard, block) pair once; data goes to each block and queries to each shard."""
        data = data.select("dim", F.pmod(h, F.lit(n_shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("least"))
        queries = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "id", "v", "least")
        both = data.unionByName(queries)
        both = both.repartition(max(n_shards * blocks, 1), "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "asks", "id")
        return both.mapInArrow(_search_shards(p.k, p.scale, p.leaf_rows), scheme)

    # The pilot: whole hash classes of about ``pilot_rows`` rows; it only gives bounds.
    classes = max(1, n // p.pilot_rows)
    pilot = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(classes)) == 0)
    first = materialize(searched(pilot, asks.withColumn("least", F.lit(None).cast("double")), 1), "topk-pilot")
    distinct = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = distinct.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").cast("double").alias("least")).filter(F.col("c") >= p.k)
    asks = asks.join(kth.select(F.col("query_id").alias("id"), "least"), "id", "left")
    # A bound that a double may round up is lowered by its rounding step.
    asks = asks.withColumn("least", F.when(F.abs("least") >= 2.0**53, F.col("least") - F.abs("least") * 1e-15).otherwise(F.col("least")))
    found = searched(rows, asks, shards).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= p.k)
    return out.select("query_id", "rank", "vec_id", "score")
