"""MinHash near-duplicates: universal hash minima, banding, full-set verification, star components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize
from .textbytes import mix64, shingle_sets, text_buffers
from .workers import tidy


@dataclass(frozen=True)
class MinHashParams:
    """``rows`` x ``bands`` minima.  At a similarity of 0.85 a pair shares no band with
    probability (1 - 0.85**rows)**bands = 1.7e-6; at 0.8, 2e-4.
    """

    width: int = 5
    percent: int = 80
    rows: int = 6
    bands: int = 28
    seed: int = 7


def _signatures(params: MinHashParams):
    rng = np.random.default_rng(params.seed)
    k = params.rows * params.bands
    mul = (rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    add = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def minima(h: np.ndarray) -> np.ndarray:
        least = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(h), 512):
            x = mul[:, None] * h[None, i : i + 512]
            x += add[:, None]
            np.minimum(least, x.min(axis=1), out=least)
        return least >> np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            sizes, prints, bands = [], [[], []], []
            for h in shingle_sets(data, offsets, params.width):
                sizes.append(len(h))
                prints[0].append(int(np.add.reduce(mix64(h + np.uint64(0x632BE59BD9B4E019))).astype(np.int64)))
                prints[1].append(int(np.bitwise_xor.reduce(mix64(h ^ np.uint64(0xA24BAED4963EE407))).astype(np.int64)))
                if len(h):
                    sig = minima(h).reshape(params.bands, params.rows)
                    band = np.zeros(params.bands, dtype=np.uint64)
                    for r in range(params.rows):
                        band = mix64(band * np.uint64(0xD6E8FEB86659FD93) + sig[:, r])
                    bands.append(band.astype(np.int64))
                else:
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints[0], pa.int64()), pa.array(prints[1], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            sets = [h.astype(np.int64) for h in shingle_sets(data, offsets, width)]
            for i in range(0, len(sets), 256):  # small record batches: sets are larger than their texts
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 256], pa.array(sets[i : i + 256], pa.list_(pa.int64()))], ["id", "shingles"])

    return run


#: Rows of a bucket's largest component that meet in one cell, and the largest set that rides along with them.
CHUNK = 512
SHORT = 1024


def _cross_pairs(percent: int):
    """Pairs of different components in a cell that may link, each in the first band it shares only.

    A row outside the bucket's largest component is in every cell of the bucket, so it
    meets each other row in the cell that owns that row.  Only a cell is held in memory.
    """

    def meet(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rep, n, c, comp = (t[k].to_numpy().astype(np.int64) for k in ("rep", "n_shingles", "common", "comp"))
        own, large = (t[k].to_numpy(zero_copy_only=False) for k in ("own", "large"))
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        band = t["band"][0].as_py()
        sets = t["short"].combine_chunks()
        at = sets.offsets.to_numpy()
        flat, known = sets.values.to_numpy(), sets.is_valid().to_numpy(zero_copy_only=False)
        here = np.flatnonzero(own)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for x in np.flatnonzero(~large):
            y = here[(comp[here] != comp[x]) & (large[here] | (rep[here] > rep[x]))]
            most = np.minimum(np.minimum(c[x], c[y]), np.minimum(n[x], n[y]))
            y = y[100 * most >= percent * (n[x] + n[y] - most)]
            y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
            if known[x] and len(y):
                z, y = y[~known[y]], y[known[y]]
                mine = flat[at[x] : at[x + 1]]
                theirs = np.concatenate([mine[:0], *(flat[at[k] : at[k + 1]] for k in y)])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                run = np.concatenate([[0], np.cumsum(hit)])
                ends = np.cumsum(at[y + 1] - at[y])
                # Two more than counted, for hashes that fall together in 32 bits.
                both = run[ends] - run[ends - (at[y + 1] - at[y])] + 2
                y = np.concatenate([y[100 * both >= percent * (n[x] + n[y] - both)], z])
            found.append((np.minimum(rep[y], rep[x]), np.maximum(rep[y], rep[x])))
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = meet(pa.Table.from_batches(held))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("band", "h", "cell")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if j <= i:
                    continue
                if tuple(key[i]) != at:
                    yield from flush()
                    at, held = tuple(key[i]), []
                held.append(batch.slice(i, j - i))
        yield from flush()

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    both = both.withColumn("inter", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("inter")
    return materialize(both.filter(F.lit(100) * F.col("inter") >= F.lit(percent) * union).select("a", "b"), tag)


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents whose shingle sets have 100 * |intersection| >= percent * |union|.
    Documents with one set form a class that its smallest doc_id stands for, so copies
    are never paired.  Pairs whose sizes and numbers of shared shingles (those that some
    other candidate has) rule the similarity out are left out exactly.  In each band
    bucket every class is compared with the bucket's lead first, the class with the
    smallest share of lone shingles; after components are known, only classes that share
    a bucket but not a component are compared with each other, which can be needed for a
    link but never for two members of one component.  No bucket is capped.

    A null or word-free text has an empty set and links with nothing.  A null doc_id
    links with nothing, has a null component and is kept.  Rows that share a doc_id are
    one node.  Other columns are not read.  An empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = params
    sig = materialize(base.mapInArrow(tidy(_signatures(p)), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"), "minhash-sig")
    key = ["n_shingles", "fp1", "fp2"]
    some = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(some.groupBy(*key).agg(F.min("doc_id").alias("rep")), "minhash-classes")
    member = materialize(
        some.join(classes, key).select("doc_id", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")),
        "minhash-members",
    )
    rows = member.filter("bands is not null").select("rep", "n_shingles", F.posexplode("bands").alias("band", "h"))
    full = materialize(rows.groupBy("band", "h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("band", "h"), "minhash-buckets")
    cand = materialize(rows.join(full, ["band", "h"]), "minhash-candidates")
    ids = materialize(cand.select(F.col("rep").alias("doc_id")).distinct(), "minhash-ids")
    sets = materialize(base.join(ids, "doc_id", "left_semi").mapInArrow(tidy(_sets(p.width)), "id long, shingles array<long>"), "minhash-sets")
    # Shingles that no other candidate has cannot be in an intersection.
    lone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("id").alias("rep")).filter("k = 1")
    lone = materialize(lone.groupBy("rep").agg(F.count("*").alias("lone")), "minhash-lone")
    common = F.col("n_shingles") - F.coalesce("lone", F.lit(0))
    cand = cand.join(lone, "rep", "left").withColumn("common", common).filter(F.lit(100) * F.col("common") >= F.lit(p.percent) * F.col("n_shingles"))
    cand = materialize(cand.select("band", "h", "rep", "n_shingles", "common"), "minhash-linkable")

    def can_link(x: str, y: str, cx: str, cy: str):
        """Whether sizes and common shingles allow the similarity."""
        most = F.least(cx, cy, x, y)
        return F.lit(100) * most >= F.lit(p.percent) * (F.col(x) + F.col(y) - most)

    # A bucket's lead is the class with the smallest share of lone shingles.
    lead = F.min(F.struct((F.lit(1) - F.col("common") / F.col("n_shingles")).alias("share"), "rep", "n_shingles", "common")).alias("lead")
    leads = materialize(cand.groupBy("band", "h").agg(lead).select("band", "h", F.col("lead.rep").alias("lead"), F.col("lead.n_shingles").alias("lead_n"), F.col("lead.common").alias("lead_c")), "minhash-leads")
    star = materialize(
        cand.join(leads, ["band", "h"])
        .filter(F.col("rep") != F.col("lead"))
        .filter(can_link("n_shingles", "lead_n", "common", "lead_c"))
        .select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))
        .distinct(),
        "minhash-stars",
    )
    links = _confirmed(star, sets, p.percent, "minhash-links")
    comp = materialize(connected_components(links, "minhash-cc"), "minhash-comp")
    seen = materialize(
        cand.join(comp, cand["rep"] == comp["node"], "left").select("band", "h", "rep", "n_shingles", "common", F.coalesce("component", "rep").alias("comp")),
        "minhash-seen",
    )
    # Buckets of several components: their largest one is dealt into chunks, the rest meets every chunk.
    tops = seen.groupBy("band", "h", "comp").agg(F.count("*").alias("k")).groupBy("band", "h").agg(F.sum("k").alias("m"), F.count("*").alias("comps"), F.max(F.struct("k", "comp"))["comp"].alias("big"))
    mixed = materialize(tops.filter("comps > 1").select("band", "h", "big", F.ceil(F.col("m") / CHUNK).cast("int").alias("q")), "minhash-mixed")
    part = materialize(seen.join(mixed, ["band", "h"]), "minhash-part")
    bands = member.filter("bands is not null").select("rep", "bands").dropDuplicates(["rep"]).join(part.select("rep").distinct(), "rep", "left_semi")
    # Small sets ride along in 32 bits, which rules pairs out before they are made.
    short = sets.withColumnRenamed("id", "rep").join(bands.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.count("*").alias("k"), F.first(F.when(F.size("shingles") <= SHORT, F.col("shingles"))).alias("s"))
    short = short.select("rep", F.when(F.col("k") == 1, F.array_sort(F.transform("s", lambda x: F.shiftright(x, 32).cast("int")))).alias("short"))
    part = part.join(materialize(bands.join(short, "rep", "left"), "minhash-bands"), "rep").withColumn("home", F.pmod(F.xxhash64("rep"), F.col("q")).cast("int"))
    part = part.withColumn("cell", F.explode(F.when(F.col("comp") == F.col("big"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("q") - 1))))
    cells = part.select("band", "h", "cell", (F.col("home") == F.col("cell")).alias("own"), (F.col("comp") == F.col("big")).alias("large"), "rep", "n_shingles", "common", "comp", "bands", "short")
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, "band", "h", "cell").sortWithinPartitions("band", "h", "cell")
    cross = materialize(cells.mapInArrow(tidy(_cross_pairs(p.percent)), "a long, b long").distinct(), "minhash-cross")
    more = cross.join(star, ["a", "b"], "left_anti")
    extra = _confirmed(more, sets, p.percent, "minhash-more")
    comp = materialize(connected_components(links.unionByName(extra), "minhash-cc"), "minhash-comp")
    # A class's component is that of its representative; a doc_id in several classes joins them.
    whole = member.select("doc_id", "rep")
    if not whole.groupBy("doc_id").agg(F.countDistinct("rep").alias("k")).filter("k > 1").isEmpty():
        again = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(whole.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
        comp = materialize(connected_components(again, "minhash-cc"), "minhash-comp")
    of = materialize(
        whole.distinct().join(comp, whole["rep"] == comp["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id")),
        "minhash-of",
    )
    out = sig.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
