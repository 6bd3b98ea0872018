"""Spelling variants: words one edit apart, found by a rare-first bigram prefix filter, and the form each one points to.

Positional bigrams of a word are ordered by how rare the bigram is over all words, then by
place.  One edit touches two bigrams at most, so two words one edit apart share one of the
three rarest of each, at the same place or, where the lengths differ, one further on.  Words
meet on such a bigram only where they also agree outside a short run of letters that holds the
edit; this splits frequent bigrams without losing a pair.  Every meeting is verified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textbytes import blocks, lower_ascii, mix64, runs_of, slices, text_buffers, word_bounds, word_hashes


@dataclass(frozen=True)
class VariantParams:
    least_letters: int = 5
    least_count: int = 3
    #: A form is this many times as frequent as its variant, at least.
    ratio: int = 2
    #: One occurrence in ``damage`` loses a letter, by the checksum of its document and itself; 0 for none.
    damage: int = 97
    #: Letters of the run that may hold the edit of two words that meet.
    run: int = 4
    held_rows: int = 1_000_000


#: Bigrams of one word that meet others: two that an edit may touch, and one more.
_RAREST = 3
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each slice of ``data``, carried on from the crc32 ``before`` it: one byte of all slices at a time."""
    out = np.empty(len(starts), dtype=np.uint32)
    size = ends - starts
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(size <= 64)
    order = short[np.argsort(-size[short], kind="stable")]
    at, left = starts[order], size[order]
    c = ~before[order].astype(np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -k, side="left"))  # those longer than k
        c[:m] = _CRC[(c[:m] ^ data[at[:m] + k]) & 0xFF] ^ (c[:m] >> np.uint32(8))
    out[order] = ~c
    return out


def _block_words(part: np.ndarray, offs: np.ndarray, ids: list[str], p: VariantParams) -> tuple[pa.Array, np.ndarray]:
    """(words, counts) of a block of lower-cased texts; a word may come twice."""
    solid = _LETTER[part]
    solid[1:] |= part[:-1] == 0xC3
    starts, ends, doc = word_bounds(part, offs, solid)
    points = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum((part & 0xC0) != 0x80, out=points[1:])
    letters = points[ends] - points[starts]
    long = letters >= p.least_letters
    starts, ends, doc, letters = starts[long], ends[long], doc[long], letters[long]
    damaged: list[str] = []
    if p.damage:
        head = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
        h = checksums(part, starts, ends, head[doc])
        hit = h % np.uint32(p.damage) == 0
        for i in np.flatnonzero(hit & (letters > p.least_letters)):
            word, k = part[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(letters[i])
            damaged.append(word[:k] + word[k + 1 :])
        starts, ends = starts[~hit], ends[~hit]
    order, first = runs_of(word_hashes(part, starts, ends))
    lead = order[first]
    words = pa.concat_arrays([slices(part, starts[lead], ends[lead]), pa.array(damaged, pa.string())])
    return words, np.concatenate([np.diff(np.append(first, len(order))), np.ones(len(damaged), dtype=np.int64)])


def count_words(docs: DataFrame, params: VariantParams) -> DataFrame:
    """(word, n) of all words of enough letters and occurrences; each task sums its own first."""

    def combine(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in blocks(offsets):
                words, n = _block_words(lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], ids[a:b], params)
                if len(words):
                    held.append(pa.table([words, pa.array(n)], ["word", "n"]))
                    rows += len(words)
                if rows > params.held_rows:
                    held = [combine(held)]
                    rows = held[0].num_rows
                    if rows > params.held_rows // 2:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from combine(held).to_batches(max_chunksize=50_000)

    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= params.least_count)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters, offsets): one byte a letter, as no word has one beyond U+00FF."""
    data, offsets = text_buffers(words)
    wide = np.zeros(len(data), dtype=bool)
    wide[1:] = data[:-1] == 0xC3
    lead = data == 0xC3
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~lead, out=points[1:])
    return (data + np.where(wide, np.uint8(0x40), np.uint8(0)))[~lead], points[offsets]


def _bigrams(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, word, place) of every bigram."""
    if len(b) < 2:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inner = np.ones(len(b) - 1, dtype=bool)
    inner[offs[1:-1] - 1] = False
    at = np.flatnonzero(inner)
    word = np.searchsorted(offs, at, side="right") - 1
    return b[at].astype(np.int64) << 8 | b[at + 1], word, at - offs[word]


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The place of each bigram code by (words' occurrences, code), rarest first; there are at most 90 * 90 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            n += np.bincount(_bigrams(*_letters(batch.column(0)))[0], minlength=1 << 16)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()
    rank = np.zeros(1 << 16, dtype=np.int64)
    rank[[r["gram"] for r in rows]] = np.arange(len(rows))
    return rank


def meeting_keys(b: np.ndarray, offs: np.ndarray, rank: np.ndarray, p: VariantParams) -> tuple[np.ndarray, ...]:
    """(word, key, place, longer) of each word's rare bigrams with each run of letters that may hold the edit.

    A word of L letters meets others of L letters and the longer ones by runs of L
    letters; as the longer one (``longer``) it meets those of L - 1 letters by their runs.
    """
    code, word, place = _bigrams(b, offs)
    order = np.argsort(word << 40 | rank[code] << 24 | np.minimum(place, (1 << 24) - 1))
    size = np.diff(offs)
    first = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))])[:-1]
    out = []
    for longer in (False, True):
        m = size - longer  # letters of the shorter word
        who = np.flatnonzero(m >= p.least_letters)
        runs = -(-m[who] // p.run)
        w = np.repeat(who, runs)
        s = np.arange(len(w)) - np.repeat(np.cumsum(runs) - runs, runs)
        lo, hi = s * p.run, np.minimum(m[w], (s + 1) * p.run)
        outside = mix64(word_hashes(b, offs[w], offs[w] + lo)) + word_hashes(b, offs[w + 1] - (m[w] - hi), offs[w + 1])
        outside = mix64(outside + (m[w].astype(np.uint64) << np.uint64(32)) + s.astype(np.uint64))
        for k in range(_RAREST):
            gram = order[first[w] + k]
            key = mix64(outside ^ mix64(code[gram].astype(np.uint64) + np.uint64(1)))
            out.append((w, key.view(np.int64), place[gram], np.full(len(w), longer)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_words(words: DataFrame, params: VariantParams) -> DataFrame:
    """(word, n, other, other_n): pairs of words one edit apart, from both sides, some of them repeated."""
    held = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, key, place, longer = meeting_keys(*_letters(batch.column(0)), held.value, params)
            for i in range(0, len(at), 100_000):
                part = slice(i, i + 100_000)
                rows = pa.array(at[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[part]), pa.array(place[part]), pa.array(longer[part]), batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "place", "longer", "word", "n"]
                )

    keyed = words.select("word", "n").mapInArrow(run, "key long, place long, longer boolean, word string, n long")
    other = keyed.withColumnsRenamed({"word": "other", "n": "other_n", "place": "there"})
    # Spark takes the keys' size for that of the words, and would broadcast all of them through the driver.
    met = keyed.filter("not longer").drop("longer").join(other.hint("merge"), "key")
    met = met.filter(F.when(F.col("longer"), F.col("there").between(F.col("place"), F.col("place") + 1)).otherwise((F.col("there") == F.col("place")) & (F.col("word") < F.col("other"))))
    met = met.filter(F.levenshtein("word", "other", 1) == 1)
    sides = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return met.select(F.explode(sides).alias("s")).select("s.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the end of each chain, by pointer jumping.

    The count doubles at each step of a chain, so that a chain has 63 steps at most and
    seven rounds of jumps end all of them.
    """
    cur = materialize(forms.select("word", F.col("form").alias("root")), "variants-forms")
    while True:
        step = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        cur = materialize(cur.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        if not cur.filter("moved").head(1):
            return cur.drop("moved")


def spelling_variants(docs: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least 5 letters that occurs 3 times or more.

    A row of ``docs`` is a document; rows that repeat count each time.  Null and empty
    texts have no words; a null doc_id counts as empty in the checksum that damages words.
    Whole texts and runs of any length are read.  Of near words of one count the smallest
    in code-point order is the form.  Columns other than doc_id and text are not read.  An
    empty table gives an empty result.
    """
    words = materialize(count_words(docs, params), "variants-words")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    rows = near_words(words, params).unionByName(alone).repartition("word").dropDuplicates(["word", "other"])
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))))
    near = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    fits = -F.col("best.n") >= params.ratio * F.col("n")
    found = materialize(
        near.select("word", F.when(fits, F.col("best.w")).alias("form"), "n", "n_near", F.when(fits, -F.col("best.n")).alias("form_n")), "variants-found"
    )
    roots = _roots(found.filter("form is not null"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
