"""Embedding near-duplicates on a robust-pruned flat graph built over overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .components import connected_components
from .scratch import materialize


@dataclass(frozen=True)
class GraphParams:
    threshold: float = 0.95
    #: Neighbours within this cosine are expanded, though only ``threshold`` links.
    expand: float = 0.85
    #: Classes of a shard before overlap; shards a class lies in; centroids at most.
    shard_rows: int = 1500
    overlap: int = 4
    max_shards: int = 4096
    #: Rows that k-means is fitted on, at most; and its rounds.
    fit_rows: int = 40_000
    fit_rounds: int = 8
    #: Candidates before pruning, out-degree, occlusion factor, beam of the greedy search.
    candidates: int = 48
    degree: int = 24
    alpha: float = 1.2
    beam: int = 12
    #: Links in a shard above which a class is compared with the whole shard in blocks, not searched for.
    dense: int = 256
    #: Rows of a shard above which its classes are dealt to several tasks, each comparing its own with all.
    split_rows: int = 20_000
    #: Linked classes that the audit looks for, and the share of them with every link found below which the overlap doubles.
    audit_rows: int = 1000
    recall: float = 0.9999
    seed: int = 3


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision and safe against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means on unit rows; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total**2).sum(axis=1))
        c[norm > 1e-12] = total[norm > 1e-12] / norm[norm > 1e-12, None]
    return c


def pruned_graph(x: np.ndarray, p: GraphParams) -> np.ndarray:
    """Out-neighbours (n, degree), -1 where there are fewer: nearest and random candidates, robustly pruned."""
    n = len(x)
    out = np.full((n, p.degree), -1, dtype=np.int32)
    if n < 2:
        return out
    rng = np.random.default_rng(p.seed)
    near = min(p.candidates, n - 1)
    far = rng.integers(0, n, (n, 16))
    for a in range(0, n, 256):
        own = np.arange(a, min(n, a + 256))
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -2
        cand = np.concatenate([np.argpartition(-sims, near - 1, axis=1)[:, :near], far[own]], axis=1)
        s = np.take_along_axis(sims, cand, axis=1)
        dist = np.sqrt(np.maximum(0.0, 2 - 2 * s))
        open_ = s > -2
        vec = x[cand]
        between = np.sqrt(np.maximum(0.0, 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))))
        rows = np.arange(len(own))
        for slot in range(p.degree):
            pick = np.where(open_, dist, np.inf).argmin(axis=1)
            live = open_[rows, pick]
            if not live.any():
                break
            out[own[live], slot] = cand[rows[live], pick[live]]
            gone = p.alpha * between[rows, pick] <= dist
            open_ &= ~(gone & live[:, None])
            open_[rows, pick] = False
    return out


def range_search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, start: int, p: GraphParams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of cosine >= threshold: a greedy beam from ``start``, then expansion of all near nodes."""
    q, n, b = x[queries], len(x), len(queries)
    rows = np.arange(b)
    seen = np.zeros((b, n), dtype=bool)
    ids = np.full((b, p.beam), -1, dtype=np.int64)
    sim = np.full((b, p.beam), -np.inf)
    done = np.ones((b, p.beam), dtype=bool)
    ids[:, 0], sim[:, 0], done[:, 0] = start, q @ x[start], False
    seen[:, start] = True
    while True:
        pick = np.where(done, -np.inf, sim).argmax(axis=1)
        live = rows[~done[rows, pick]]
        if not len(live):
            break
        done[live, pick[live]] = True
        nb = adj[ids[live, pick[live]]]
        new = (nb >= 0) & ~seen[live[:, None], nb]
        seen[live[:, None], np.where(nb >= 0, nb, start)] = True
        s = np.where(new, np.matmul(x[nb], q[live][:, :, None])[:, :, 0], -np.inf)
        all_sim = np.concatenate([sim[live], s], axis=1)
        top = np.argpartition(-all_sim, p.beam - 1, axis=1)[:, : p.beam]
        sim[live] = np.take_along_axis(all_sim, top, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], nb], axis=1), top, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], axis=1), top, axis=1)
    # Range expansion: from the beam's near nodes and the query's own node.
    hit_q, hit_n = np.nonzero((sim >= p.expand) & (ids >= 0))
    key = np.unique(np.concatenate([hit_q * n + ids[hit_q, hit_n], rows * n + queries]))
    seen[:] = False
    seen.reshape(-1)[key] = True
    front, found = key, [key]
    while len(front):
        near = [front[:0]]
        for a in range(0, len(front), 16384):
            who, node = front[a : a + 16384] // n, front[a : a + 16384] % n
            nb = adj[node].astype(np.int64)
            key = np.unique((who[:, None] * n + nb)[nb >= 0])
            key = key[~seen.reshape(-1)[key]]
            seen.reshape(-1)[key] = True
            for i in range(0, len(key), 65536):
                part = key[i : i + 65536]
                near.append(part[np.einsum("pd,pd->p", q[part // n], x[part % n]) >= p.expand])
        front = np.concatenate(near)
        found.append(front)
    key = np.concatenate(found)
    key = key[np.einsum("pd,pd->p", q[key // n], x[key % n]) >= p.threshold]  # verified in double precision
    who, node = queries[key // n], key % n
    return who[who != node], node[who != node]


def close_pairs(x: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """(own, rows) whether the cosine reaches the threshold, but for a row and itself; near ties as the search decides them."""
    sims = x[own] @ x.T
    hit = sims >= threshold
    a, b = np.nonzero(np.abs(sims - threshold) < 1e-9)
    hit[a, b] = np.einsum("pd,pd->p", x[own[a]], x[b]) >= threshold
    hit[np.arange(len(own)), own] = False
    return hit


def missed_links(x: np.ndarray, adj: np.ndarray, p: GraphParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, later row) that link but that the search from the row does not reach, by row; and the dense rows.

    A row of more than ``dense`` links is not searched for and is in no pair.
    """
    n, out = len(x), []
    medoid = int((x @ x.mean(axis=0)).argmax())
    dense = np.zeros(n, dtype=bool)
    blocks = [np.arange(a, min(n, a + 256)) for a in range(0, n, 256)]
    for own in blocks:
        dense[own] = close_pairs(x, own, p.threshold).sum(axis=1) > p.dense
    for own in blocks:
        own = own[~dense[own]]
        if not len(own):
            continue
        hit = close_pairs(x, own, p.threshold) & ~dense
        who, node = range_search(x, adj, own, medoid, p)
        hit[np.searchsorted(own, who), node] = False
        row, late = np.nonzero(hit)
        out.append(np.stack([own[row], late])[:, late > own[row]])
    row, late = np.concatenate([np.zeros((2, 0), dtype=np.int64), *out], axis=1)
    return row, late, dense


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable node of each node, from what is known of it (``root``) and new edges."""
    while True:
        low = root.copy()
        for x, y in ((a, b), (b, a)):
            np.minimum.at(low, x, root[y])
            np.minimum.at(low, root[x], root[y])  # a whole tree moves, not the node alone
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _vectors(column: pa.Array) -> np.ndarray:
    return unit_rows(np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1))


def _assign(centroids: dict[int, np.ndarray], overlap: int):
    """Rows of one dim a batch run: each class goes to its nearest shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                c = centroids[int(d)]
                x = _vectors(part.column(2))
                k = min(overlap, len(c))
                near = np.sort(np.argpartition(-(x @ c.T), k - 1, axis=1)[:, :k], axis=1).astype(np.int32)
                take = np.repeat(np.arange(len(x)), k)
                wide = part.take(pa.array(take))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(near[take].reshape(-1)), k).cast(pa.list_(pa.int32()))
                columns = [wide.column(0), wide.column(1), pa.array(near.reshape(-1)), wide.column(2), wide.column(3), lists]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "dim", "shard", "v", "mult", "shards"])

    return run


def _by_shard(work, *more: str):
    """Gathers the rows of each (dim, shard), and ``more``, of a sorted partition and hands them to ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in ("dim", "shard", *more)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if b <= a:
                    continue
                if tuple(key[a]) != at:
                    if held:
                        yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    at, held = tuple(key[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _build(p: GraphParams):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cid, x = batch.column("cid").to_numpy(), _vectors(batch.column("v"))
        mark = np.array([-1 - batch.column("shard")[0].as_py()])  # of a row that is dense in this shard
        adj = pruned_graph(x, p)
        row, late, dense = missed_links(x, adj, p)  # these become edges, so that every link of the shard is found
        first = np.searchsorted(row, np.arange(len(cid) + 1))
        lists = [np.concatenate([cid[r[r >= 0]], cid[late[a:b]], mark[:d]]) for r, a, b, d in zip(adj, first, first[1:], dense.astype(int), strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(lists, pa.list_(pa.int64()))], ["cid", "near"])

    return _by_shard(work)


class _Shard:
    """Links and components of a shard's rows, added up block by block; only one block's pairs are held."""

    def __init__(self, batch: pa.RecordBatch, p: GraphParams):
        self.p, self.cid, self.mult = p, batch.column("cid").to_numpy(), batch.column("mult").to_numpy()
        self.x, self.n = _vectors(batch.column("v")), len(batch)
        self.shard = batch.column("shard")[0].as_py()
        self.lists = batch.column("shards").flatten().to_numpy().reshape(self.n, -1)
        self.order = np.argsort(self.cid)
        self.rank = np.empty(self.n, dtype=np.int64)
        self.rank[self.order] = np.arange(self.n)
        self.links = np.zeros(self.n, dtype=np.int64)
        self._root = np.arange(self.n)  # by rank

    def mine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether this is the first of the shards that each pair shares: it counts there only."""
        out = np.zeros(len(a), dtype=bool)
        for i in range(0, len(a), 1 << 18):
            x, y = self.lists[a[i : i + (1 << 18)]], self.lists[b[i : i + (1 << 18)]]
            both = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int32).max)
            out[i : i + (1 << 18)] = both.min(axis=1) == self.shard
        return out

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.rank[a], self.rank[b]
        new = self._root[a] != self._root[b]
        if new.any():
            self._root = _roots(self._root, a[new], b[new])

    def compared(self, rows: np.ndarray, others: np.ndarray | None = None) -> None:
        """Counts all links of ``rows``, for these and, where ``others`` holds, for the rows they link with."""
        for i in range(0, len(rows), 256):
            a, b = np.nonzero(close_pairs(self.x, rows[i : i + 256], self.p.threshold))
            a = rows[i : i + 256][a]
            self.join(a, b)
            keep = self.mine(a, b)
            a, b = a[keep], b[keep]
            np.add.at(self.links, a, self.mult[b])
            if others is not None:
                back = others[b]
                np.add.at(self.links, b[back], self.mult[a[back]])

    def result(self) -> pa.RecordBatch:
        root = self.cid[self.order][self._root[self.rank]]
        return pa.RecordBatch.from_arrays([pa.array(self.cid), pa.array(self.links), pa.array(root)], ["cid", "links", "root"])


def _search(p: GraphParams):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = _Shard(batch, p)
        n, x = s.n, s.x
        # The union's neighbours that lie in this shard, as row numbers.
        flat = batch.column("near").flatten().to_numpy()
        owner = np.repeat(np.arange(n), np.diff(batch.column("near").offsets.to_numpy()))
        dense = np.zeros(n, dtype=bool)
        dense[owner[flat == -1 - s.shard]] = True
        at = np.minimum(np.searchsorted(s.cid[s.order], flat), n - 1)
        here = s.cid[s.order][at] == flat
        owner, node = owner[here], s.order[at[here]]
        first = np.searchsorted(owner, np.arange(n))
        slot = np.arange(len(owner)) - first[owner]
        adj = np.full((n, int(slot.max()) + 1 if len(slot) else 1), -1, dtype=np.int32)
        adj[owner, slot] = node
        medoid = int((x @ x.mean(axis=0)).argmax())
        s.compared(np.flatnonzero(dense), ~dense)
        sparse, pairs = np.flatnonzero(~dense), []
        for i in range(0, len(sparse), 256):
            who, node = range_search(x, adj, sparse[i : i + 256], medoid, p)
            who, node = who[~dense[node]], node[~dense[node]]
            s.join(who, node)
            pairs.append(np.minimum(who, node) * n + np.maximum(who, node))
        key = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *pairs]))  # at most ``dense`` a row
        a, b = key // n, key % n
        keep = s.mine(a, b)
        np.add.at(s.links, a[keep], s.mult[b[keep]])
        np.add.at(s.links, b[keep], s.mult[a[keep]])
        yield s.result()

    return _by_shard(work)


def _compare(p: GraphParams):
    """A cell of a very large shard: its own rows against all rows of the shard."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = _Shard(batch, p)
        s.compared(np.flatnonzero(batch.column("own").to_numpy(zero_copy_only=False)))
        yield s.result()

    return _by_shard(work, "cell")


def _audit(queries: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    """Links of each audited class counted against all rows of its dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                if int(d) not in queries:
                    continue
                ids, q = queries[int(d)]
                part = batch.filter(pa.array(dims == d))
                x, mult = _vectors(part.column(2)), part.column(3).to_numpy()
                for i in range(0, len(x), 1024):
                    hit = (q @ x[i : i + 1024].T >= threshold + 1e-12) @ mult[i : i + 1024]  # ties are the search's own
                    for k, m in zip(ids.tolist(), hit.tolist(), strict=True):
                        total[k] = total.get(k, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["cid", "exact"])

    return run


def _by_dim(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["dim"], []).append(r)
    return {d: (np.array([r["cid"] for r in rs]), unit_rows(np.array([r["v"] for r in rs], dtype=np.float64))) for d, rs in out.items()}


def _wanted(reps: DataFrame, p: GraphParams, n: int) -> DataFrame:
    """(cid, want) of audited classes that link with others, by comparison with all rows.

    Hash buckets of about ``audit_rows`` classes, at most eight a pass, until as many
    classes with links are found or all classes are audited.
    """
    buckets = -(-n // p.audit_rows)
    hashed = reps.withColumn("bucket", F.pmod(F.xxhash64("cid", F.lit(99)), F.lit(buckets)))
    out, met, at = None, 0, 0
    while at < buckets and met < p.audit_rows:
        end = min(buckets, at + min(8, max(1, at)))
        part = hashed.filter(F.col("bucket").between(at, end - 1))
        asked = _by_dim(part.select("cid", "dim", "v").collect())
        exact = reps.mapInArrow(_audit(asked, p.threshold), "cid long, exact long").groupBy("cid").agg(F.sum("exact").alias("exact"))
        want = exact.join(part.select("cid", "mult"), "cid").select("cid", (F.col("exact") - F.col("mult")).alias("want")).filter("want > 0")
        want = materialize(want, "graph-audit")
        met += want.count()
        out = want if out is None else out.unionByName(want)
        at = end
    return out


def _linked(reps: DataFrame, p: GraphParams, n: int) -> tuple[DataFrame, int]:
    """(cid, links, root) of every class and shard; and the most shards of a length."""
    spark = reps.sparkSession
    sample = reps.orderBy(F.xxhash64("cid", F.lit(p.seed)), "cid").limit(p.fit_rows).select("cid", "dim", "v").collect()
    by_dim = _by_dim(sample)
    centroids = {}
    for d, (_, x) in by_dim.items():
        k = min(p.max_shards, max(1, -(-n // p.shard_rows)), len(x))
        centroids[d] = fit_centroids(x, k, p.fit_rounds, p.seed)
    missing = [r["dim"] for r in reps.select("dim").distinct().collect() if r["dim"] not in centroids]
    for d in missing:  # a length too rare for the sample: one shard
        centroids[d] = np.zeros((1, d))
    held = spark.sparkContext.broadcast(centroids)
    placed = reps.mapInArrow(lambda it: _assign(held.value, p.overlap)(it), "cid long, dim int, shard int, v array<double>, mult long, shards array<int>")
    placed = materialize(placed, "graph-placed")
    shards = sum(len(c) for c in centroids.values())
    key = ["dim", "shard"]
    parts = max(1, min(shards, 100_000))
    schema = "cid long, links long, root long"
    sizes = placed.groupBy(*key).count()
    large = materialize(sizes.filter(F.col("count") > p.split_rows).select(*key, F.ceil(F.col("count") / p.split_rows).cast("int").alias("cells")), "graph-large")
    crowded = not large.isEmpty()
    usual = placed.join(F.broadcast(large), key, "left_anti") if crowded else placed  # at most rows / split_rows of them
    near = usual.drop("mult", "shards").repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_build(p), "cid long, near array<long>")
    union = materialize(near.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph-union")
    block = usual.join(union, "cid").repartition(parts, *key).sortWithinPartitions(*key, "cid")
    found = block.select("cid", "dim", "shard", "v", "mult", "shards", "near").mapInArrow(_search(p), schema)
    if crowded:
        cells = placed.join(F.broadcast(large), key).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        cells = cells.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("cells")) == F.col("cell")).drop("cells")
        n_cells = large.agg(F.sum("cells")).first()[0]
        cells = cells.repartition(max(parts, n_cells), *key, "cell").sortWithinPartitions(*key, "cell", "cid")
        found = found.unionByName(cells.select("cid", "dim", "shard", "cell", "own", "v", "mult", "shards").mapInArrow(_compare(p), schema))
    return materialize(found, "graph-links"), max(len(c) for c in centroids.values())


def embedding_duplicates(vectors: DataFrame, params: GraphParams = GraphParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Exact copies form a class first, so a class of any size is one node.  Classes go to
    the ``overlap`` nearest of the cluster shards; each shard builds a robust-pruned
    graph and adds the links that a search of it misses as edges, the adjacency lists of
    all shards are united by class, and every shard is searched with the united lists: a
    greedy beam from the medoid, then an expansion of everything near.  A class of more
    than ``dense`` links in a shard, as in a ball of near copies, is compared with the
    whole shard in blocks; of a shard above ``split_rows`` several tasks do so with a part
    of its classes each.  Only one block's pairs and a tree of links are held.  Links are verified in double precision, and a pair that meets in
    several shards counts once.  An audit counts links against all rows, class by class,
    until ``audit_rows`` classes have some or all are counted; while fewer than
    ``recall`` of these have every link, each counting once however many links it has,
    the overlap is doubled, at the end to all shards, where every pair meets.  If links
    are still missing then, it is an error.  Only the bounded k-means sample, the
    centroids and the audit's queries of one pass are held by the driver.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing and are kept; vectors meet only those of their own length.  A null vec_id
    links with nothing, has a null component and is kept.  Rows that share a vec_id are
    one node, whatever their vectors; n_links is that of its vector with most, and each row
    counts in the n_links of others.  Other columns are not read.  An empty
    table gives an empty result.
    """
    p = params
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    some = rows.filter(F.col("id").isNotNull() & sound).withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(17))})
    some = materialize(some, "graph-rows")
    key = ["dim", "h1", "h2"]
    # Classes are numbered in the order of their smallest ids, as an id may be the smallest of several.
    classes = numbered(some.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("mult")), ["first", *key], "cid")
    classes = materialize(classes, "graph-classes")
    member = materialize(some.join(classes, key).select("id", "cid", "mult", "dim", F.when(F.col("id") == F.col("first"), F.col("v")).alias("v")), "graph-members")
    reps = materialize(member.filter("v is not null").dropDuplicates(["cid"]).select("cid", "dim", "v", "mult"), "graph-classes")
    n = reps.count()
    if n:
        want = _wanted(reps, p, n)
        while True:
            found, shards = _linked(reps, p, n)
            links = found.groupBy("cid").agg(F.sum("links").alias("links"))
            full = F.coalesce("links", F.lit(0)) >= F.col("want")
            audited, whole = want.join(links, "cid", "left").agg(F.count("*"), F.count(F.when(full, 1))).first()
            if whole >= p.recall * audited:
                break
            if p.overlap >= shards:
                raise RuntimeError(f"{audited - whole} of {audited} audited classes lack links though all shards were searched")
            p = replace(p, overlap=2 * p.overlap)
        edges = found.filter("root < cid").select(F.col("cid").alias("a"), F.col("root").alias("b"))
        # An id with several vectors joins their classes.
        several = member.groupBy("id").agg(F.min("cid").alias("b"), F.max("cid").alias("most")).filter("b < most")
        edges = edges.unionByName(member.join(several, "id").filter("b < cid").select(F.col("cid").alias("a"), "b"))
        comp = connected_components(edges, "graph-cc")
        comp = comp.join(classes.select(F.col("cid").alias("component"), F.col("first").alias("smallest")), "component").select("node", "smallest")
        of = links.join(comp, links["cid"] == comp["node"], "left").join(classes.select("cid", "first"), "cid")
        of = materialize(of.select("cid", "links", F.coalesce("smallest", "first").alias("component")), "graph-of")
        linked = member.join(of, "cid").select("id", (F.col("links") + F.col("mult") - 1).alias("n_links"), "component")
    else:
        linked = member.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    # Rows that share an id are one node: its links add up to the highest, its component to the smallest.
    linked = linked.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select("id").join(materialize(linked, "graph-result"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
