"""Source divergence audit: how far the term shares of each source of a language are from those of every other source.

Prices come by inclusion and exclusion over supports.  Of two sources most kept terms are
in one or none, so per-source histograms of counts price the one-sided terms, a constant
covers the terms that neither has, and only terms that both have are met one by one, from
sparse postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .textbytes import blocks, lower_ascii, mix64, runs_of, slices, text_buffers, word_bounds, word_hashes


@dataclass(frozen=True)
class DivergenceParams:
    #: Documents of its language that a kept term is in, at least; ranks of terms that are returned.
    least_documents: int = 3
    term_ranks: int = 200
    scale: int = 1_000_000_000
    #: (lang, source) groups whose totals go to every task, at most; more are joined by a shuffle.
    broadcast_groups: int = 200_000
    #: Rows of counts that a task holds before it passes them on.
    held_rows: int = 1_000_000


_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_COUNTS = "lang string, source string, term string, n long, docs long"


def _block_counts(part: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, start, end, n, docs) of each distinct term of a group among these documents."""
    starts, ends, doc = word_bounds(part, offs, _TERM[part])
    h = word_hashes(part, starts, ends)
    order, first = runs_of(mix64(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    n = np.diff(np.append(first, len(order)))
    at = order[first]  # a place of each distinct term of a document
    g = group[doc[at]]
    order, first = runs_of(mix64(h[at] + mix64(g.astype(np.uint64))))
    docs = np.diff(np.append(first, len(order)))
    n = np.add.reduceat(n[order], first) if len(first) else n
    at, g = at[order[first]], g[order[first]]
    return g, starts[at], ends[at], n, docs


def term_counts(docs: DataFrame, held_rows: int) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, some rows a group and term from each task."""

    def combine(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            lang, source = (batch.column(i).cast(pa.string()) for i in (0, 1))
            keys = pa.Table.from_arrays([lang, source, pa.array(np.arange(len(lang)))], ["lang", "source", "i"]).group_by(["lang", "source"], use_threads=False).aggregate([("i", "list")])
            group = np.zeros(len(lang), dtype=np.int64)
            for k, members in enumerate(keys.column("i_list").to_pylist()):
                group[members] = k
            langs, sources = (keys.column(c).combine_chunks() for c in ("lang", "source"))
            for a, b in blocks(offsets):
                part = lower_ascii(data[offsets[a] : offsets[b]])
                g, s, e, n, d = _block_counts(part, offsets[a : b + 1] - offsets[a], group[a:b])
                if len(g):
                    at = pa.array(g)
                    held.append(pa.table([langs.take(at), sources.take(at), slices(part, s, e), pa.array(n), pa.array(d)], ["lang", "source", "term", "n", "docs"]))
                    rows += len(g)
                if rows > held_rows:
                    held = [combine(held)]
                    rows = held[0].num_rows
                    if rows > held_rows // 2:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from combine(held).to_batches(max_chunksize=50_000)

    return docs.select("lang", "source", "text").mapInArrow(run, _COUNTS)


def _div(a: Column, b: Column) -> Column:
    """The whole part of a / b as a long, exact also for decimals."""
    return F.call_function("div", a, b)


def _share(count: Column, room: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / room), in decimals, as a count times the scale may pass 64 bits."""
    return F.lit(1) + _div((count + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(11,0)"), room.cast("decimal(20,0)"))


def _cost(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _total(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)"))


def _postings(counts: DataFrame, params: DivergenceParams) -> DataFrame:
    """(lang, term, c, posts) of each kept term: its occurrences, and (source, n) of every source that has it.

    One shuffle by language and term; both groupings are then local to its partitions.
    """
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("c"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return kept.filter(F.col("docs") >= params.least_documents).drop("docs")


def _groups(docs: DataFrame, kept: DataFrame, hist: DataFrame, scale: int) -> DataFrame:
    """(lang, source, support, room, zero, vocab, lang_room) of every group that occurs; room is the divisor of its shares."""
    vocab = kept.groupBy("lang").agg(F.count("*").alias("vocab"), F.sum("c").alias("lang_n"))
    own = hist.groupBy("lang", "source").agg(F.sum("terms").alias("support"), F.sum(F.col("n") * F.col("terms")).alias("total"))
    out = docs.select("lang", "source").distinct().join(vocab, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0)
    out = out.withColumn("room", F.col("total") + F.col("vocab"))
    zero = F.when(F.col("room") > 0, _share(F.lit(0), F.col("room"), scale)).otherwise(1)
    return out.select("lang", "source", "support", "room", zero.alias("zero"), "vocab", (F.col("lang_n") + F.col("vocab")).alias("lang_room"))


def _chunks(more: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of elements with about ``most`` pairs, ``more`` of each."""
    ends = np.cumsum(more)
    a, done = 0, 0
    while a < len(more):
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield a, b
        a, done = b, int(ends[b - 1])


def _meet(group: np.ndarray, p: np.ndarray, zero: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, terms, fix of a against b, fix of b against a): sums over the terms that both groups have.

    ``sizes`` are the lengths of the posting lists; pairs are made and summed in runs of
    bounded length.  A fix replaces the two one-sided prices of a term by its true one.
    """
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(group))
    more = ends - at - 1
    cost = lambda x, y: (x - y) * (x - y) // y
    for lo, hi in _chunks(more, 1_000_000):
        n = more[lo:hi]
        i = np.repeat(at[lo:hi], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        swap = group[i] > group[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pi, pj, zi, zj = p[i], p[j], zero[i], zero[j]
        there = cost(pi, pj) - cost(pi, zj) - cost(zi, pj)
        back = cost(pj, pi) - cost(pj, zi) - cost(zj, pi)
        order, first = runs_of((group[i].astype(np.uint64) << np.uint64(32)) | group[j].astype(np.uint64))
        if len(first):
            lead = order[first]
            yield group[i][lead], group[j][lead], np.diff(np.append(first, len(order))), np.add.reduceat(there[order], first), np.add.reduceat(back[order], first)


def _overlaps(kept: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    """(lang, source, item, both, fix) of groups that share kept terms, some rows a pair from each task.

    ``groups`` is a table of checked size: its rows go to every task.
    """
    rows = groups.select("lang", "source", "room", "zero").collect()
    held = kept.sparkSession.sparkContext.broadcast(
        ({(r["lang"], r["source"]): i for i, r in enumerate(rows)}, np.array([r["room"] for r in rows], dtype=np.int64), np.array([r["zero"] for r in rows], dtype=np.int64))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, room, zero = held.value
        names = list(index)

        def out(parts: list) -> pa.RecordBatch:
            a, b, n, there, back = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first = runs_of((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            a, b = a[order[first]], b[order[first]]
            n, there, back = (np.add.reduceat(x[order], first) for x in (n, there, back))
            parts[:] = [(a, b, n, there, back)]
            lang, left, right = pa.array([names[k][0] for k in a]), pa.array([names[k][1] for k in a]), pa.array([names[k][1] for k in b])
            ways = [pa.concat_arrays(x) for x in ((lang, lang), (left, right), (right, left))]
            return pa.RecordBatch.from_arrays([*ways, pa.array(np.concatenate([n, n])), pa.array(np.concatenate([there, back]))], ["lang", "source", "item", "both", "fix"])

        parts, rows = [], 0
        for batch in batches:
            posts = batch.column(1)
            sizes = np.diff(posts.offsets.to_numpy())
            flat = posts.flatten()
            lang, source = batch.column(0).dictionary_encode(), flat.field("source").dictionary_encode()
            pair = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes) << 32 | source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            seen, back = np.unique(pair, return_inverse=True)
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            group = np.array([index[langs[int(x) >> 32], sources[int(x) & 0xFFFFFFFF]] for x in seen], dtype=np.int64)[back]
            # scale * (n + 1) in two steps, so that 64 bits do: scale = 31,250 * (scale / 31,250).
            n, d = flat.field("n").to_numpy(zero_copy_only=False) + 1, room[group]
            head = n * 31_250
            p = 1 + head // d * (scale // 31_250) + head % d * (scale // 31_250) // d
            for part in _meet(group, p, zero[group], sizes):
                parts.append(part)
                rows += len(part[0])
                if rows > 500_000:
                    found = out(parts)
                    rows = len(parts[0][0])
                    if rows > 250_000:
                        yield found
                        parts, rows = [], 0
        if parts:
            yield out(parts)

    return kept.select("lang", "posts").mapInArrow(run, "lang string, source string, item string, both long, fix long")


def _joined_overlaps(posts: DataFrame) -> DataFrame:
    """The same rows for any number of groups, from the postings (lang, term, source, p, zero) joined with themselves."""
    a, b = posts.alias("a"), posts.withColumnsRenamed({"source": "item", "p": "q", "zero": "zero_q"}).alias("b")
    both = a.join(b, ["lang", "term"]).filter("source <> item")
    fix = _cost(F.col("p"), F.col("q")) - _cost(F.col("p"), F.col("zero_q")) - _cost(F.col("zero"), F.col("q"))
    return both.groupBy("lang", "source", "item").agg(F.count("*").alias("both"), _total(fix).alias("fix"))


def source_divergence(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """lang, source, part, item, value, rank: divergences between sources of a language, and the terms that mark each source.

    A row of ``docs`` is a document, also where a doc_id is null or repeats.  Null text,
    lang and source count as empty; a group without terms takes part with counts of zero.
    Whole texts are read.  Ties of value are ranked by the item's UTF-8 bytes.  Columns other
    than text, lang and source are not read.  An empty table gives an empty result.

    The sums are exact while a language keeps fewer than a thousand million terms and a
    group has fewer than 2.9e14 occurrences of them.
    """
    scale = params.scale
    if scale % 31_250:
        raise ValueError("the scale must be a multiple of 31,250")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialize(_postings(term_counts(docs, params.held_rows), params), "divergence-kept")
    flat = kept.select("lang", "term", "c", F.explode("posts").alias("post")).select("lang", "term", "c", "post.*")
    hist = materialize(flat.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "divergence-hist")
    groups = materialize(_groups(docs, kept, hist, scale), "divergence-groups")
    few = groups.count() <= params.broadcast_groups
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    priced = flat.join(small(groups.select("lang", "source", "room", "zero", "lang_room")), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("room"), scale))
    shared = _overlaps(kept, groups, scale) if few else _joined_overlaps(priced)
    shared = shared.groupBy("lang", "source", "item").agg(F.sum("both").alias("both"), _total(F.col("fix")).alias("fix"))

    # Every pair of sources of a language is a row of the result.
    other = groups.select("lang", F.col("source").alias("item"), F.col("support").alias("support_q"), F.col("zero").alias("zero_q"))
    pairs = groups.select("lang", "source", "support", "zero", "vocab").join(other, "lang").filter("source <> item")
    bins = hist.join(small(groups.select("lang", "source", "room")), ["lang", "source"]).select("lang", "source", "terms", _share(F.col("n"), F.col("room"), scale).alias("p"))
    mine = bins.join(small(other.select("lang", "item", "zero_q")), "lang").filter("source <> item")
    mine = mine.groupBy("lang", "source", "item").agg(_total(F.col("terms").cast("decimal(20,0)") * _cost(F.col("p"), F.col("zero_q"))).alias("mine"))
    theirs = bins.select("lang", F.col("source").alias("item"), "terms", F.col("p").alias("q")).join(small(groups.select("lang", "source", "zero")), "lang").filter("source <> item")
    theirs = theirs.groupBy("lang", "source", "item").agg(_total(F.col("terms").cast("decimal(20,0)") * _cost(F.col("zero"), F.col("q"))).alias("theirs"))
    by = ["lang", "source", "item"]
    wide = pairs.join(mine, by, "left").join(theirs, by, "left").join(shared, by, "left")
    wide = wide.na.fill(0, ["mine", "theirs", "both", "fix"])
    neither = (F.col("vocab") - F.col("support") - F.col("support_q") + F.col("both")).cast("decimal(20,0)") * _cost(F.col("zero"), F.col("zero_q")).cast("decimal(18,0)")
    value = (F.col("mine") + F.col("theirs") + F.col("fix") + neither).cast("long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = wide.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))

    q = _share(F.col("c"), F.col("lang_room"), scale)
    term = priced.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _cost(F.col("p"), F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= params.term_ranks)
    return pair.unionByName(term)
