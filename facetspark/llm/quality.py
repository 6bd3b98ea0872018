"""Quality classifier: averaged embeddings of hashed word and character n-grams, softmax output, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import blocks, mix64, text_buffers, word_bounds, word_hashes
from .workers import tidy


#: Bytes of text whose features are held at once, about a hundred bytes each.
_BLOCK = 1 << 18


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    rate: float = 0.4
    seed: int = 5
    #: Labelled rows that the model is fitted on, at most, and the longest text among them in characters.
    fit_rows: int = 4000
    fit_chars: int = 20_000
    threshold: float = 0.3


def doc_features(data: np.ndarray, offsets: np.ndarray, p: QualityParams) -> Iterator[tuple[list, list, np.ndarray]]:
    """Of each block of texts: buckets of words, of their repeats and of character n-grams, each document's first ones, and offsets.

    N-grams are taken at every character; the last g - 1 of a document reach into the next one
    and are left out by those who read them.
    """
    mask = np.uint64(p.buckets - 1)
    for a, b in blocks(offsets, _BLOCK):
        lo, hi = offsets[a], offsets[b]
        part, offs = data[lo:hi], offsets[a : b + 1] - lo
        starts, ends, doc = word_bounds(part, offs)
        words = word_hashes(part, starts, ends)
        at = np.searchsorted(starts, offs)
        # Which of the three words before it in its document a word repeats, as one more word feature.
        again = np.zeros(len(words), dtype=np.int64)
        for k in (1, 2, 3):
            if len(words) > k:
                again[k:] += ((words[k:] == words[:-k]) & (doc[k:] == doc[:-k])) * (1 << (k - 1))
        feats = [(mix64(words) & mask).astype(np.int64), again * 977 % p.buckets]
        cuts = [at, at]
        # Characters as numbers of their one to four bytes.
        first = np.flatnonzero((part & 0xC0) != 0x80)
        size = np.diff(np.append(first, len(part)))
        wide = part[first].astype(np.uint64) + np.uint64(1)
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            wide[more] = wide[more] * np.uint64(256) + part[first[more] + k]
        chars = np.searchsorted(first, offs)
        for g in p.grams:
            m = max(0, len(wide) - g + 1)
            h = np.full(m, g, dtype=np.uint64)
            for k in range(g):
                h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + m]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            f = (h >> np.uint64(40)) & mask
            feats.append(f.astype(np.int64))
            cuts.append(chars)
        yield feats, cuts, offs


class QualityModel:
    """Scores of documents; for scoring each bucket is collapsed to one number, as averaging is linear."""

    def __init__(self, emb: np.ndarray, out: np.ndarray, bias: np.ndarray, params: QualityParams):
        self.params = params
        self.value = (emb @ (out[:, 1] - out[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for feats, cuts, offs in doc_features(data, offsets, self.params):
            total, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
            for f, c, g in zip(feats, cuts, (1, 1, *self.params.grams), strict=True):
                start = np.minimum(c[:-1], len(f))
                stop = np.maximum(start, c[1:] - (g - 1))
                # Each document is summed by itself, so that its score does not depend on its place in a block.
                each = np.add.reduceat(np.append(self.value[f].astype(np.float64), 0.0), np.stack([start, stop], 1).ravel())[::2]
                total += np.where(stop > start, each, 0.0)
                count += stop - start
            out.append(np.where(count > 0, total / np.maximum(count, 1), 0.0))
        return np.concatenate(out) + self.bias if out else np.zeros(0)


def _bags(texts: list[str], p: QualityParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their shares of all its features."""
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        offsets = np.array([0, len(data)], dtype=np.int64)
        got = [f for feats, _, _ in doc_features(data, offsets, p) for f in feats]
        ids, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, dtype=np.int64), np.zeros(0))
        out.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train_quality(texts: list[str], labels: list[int], params: QualityParams) -> QualityModel:
    """Softmax regression on averaged n-gram embeddings by stochastic gradient descent.

    Each labelled text counts once, whatever its class.  Without labels, or with one
    class only, every score is the smoothed share of label 1 (0.5 without labels).
    """
    p = params
    rng = np.random.default_rng(p.seed)
    emb = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    out = np.zeros((p.dim, 2), dtype=np.float64)
    y = np.array(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = np.array([np.log(1 - share), np.log(share)])
    if len(y) and 0 < y.sum() < len(y):
        bags = _bags(texts, p)
        total = p.epochs * len(y)
        for epoch in range(p.epochs):
            for k, i in enumerate(rng.permutation(len(y))):
                ids, share_of = bags[i]
                if not len(ids):
                    continue
                rate = p.rate * (1 - (epoch * len(y) + k) / total)
                rows = emb[ids]
                h = share_of @ rows
                z = h @ out + bias
                e = np.exp(z - z.max())
                g = e / e.sum()
                g[y[i]] -= 1
                back = out @ g
                out -= rate * np.outer(h, g) * p.dim
                bias -= 0.05 * rate * g
                emb[ids] = rows - (rate * len(ids) ** 0.5) * share_of[:, None] * back
    return QualityModel(emb, out, bias, p)


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """A model of ``labels.quality``, from at most ``fit_rows`` labelled rows of the training side.

    Training rows have crc32(doc_id as text) mod 5 not 0, a label of 0 or 1 and a text of
    at most ``fit_chars`` characters; of more, those with the smallest hash are taken.
    A doc_id with several labels counts as 1 if most of them are; one with several texts
    is learned by the first of them.
    """
    p = params
    own = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    own = own.filter(~_held_out("doc_id"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.filter(F.char_length("text") <= p.fit_chars)
    # First the ids, so that only the chosen rows' texts are moved.
    ids = text.select("doc_id").distinct().join(own, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.fit_rows)
    chosen = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, quality int")
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train_quality([r["text"] for r in rows], [r["quality"] for r in rows], p)


def _held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1) of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        at = names.index("text")
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            score = 1 / (1 + np.exp(-np.clip(m.margins(data, offsets), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    A null text counts as empty; an empty text has the score of the bias alone.  A score
    depends on the row's text and the model only, so repeated rows score alike; a null
    doc_id is not held out.  Columns other than doc_id and text
    are not read.  An empty table gives an empty result.
    """
    model = fit_quality(docs, labels, params)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score_quality(base, model)
    return out.select(
        "doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= params.threshold).cast("int").alias("predicted"),
    )
