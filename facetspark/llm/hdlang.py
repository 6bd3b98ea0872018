"""Language ID by hyperdimensional profiles: permuted letter vectors bound to trigrams, bundled, compared by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mix64

#: Code of everything that is not a letter; runs of it count once.
_GAP = 0
#: Characters counted together; a longer text is counted alone and whole.
_BLOCK_CHARS = 1 << 20


@dataclass(frozen=True)
class LangParams:
    dim: int = 1024
    seed: int = 9


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, runs of anything else as one gap, gaps at both ends."""
    low = text.lower()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return code if not len(code) else _gapped(code)


_letters: dict[int, bool] = {}


def _gapped(code: np.ndarray) -> np.ndarray:
    top = int(code.max())
    if top < 0x3000:
        present, place = np.flatnonzero(np.bincount(code)), None
    else:
        present, place = np.unique(code, return_inverse=True)
    for c in present.tolist():
        if c not in _letters:
            _letters[c] = chr(c).isalpha()
    letters = np.where([_letters[c] for c in present.tolist()], present, _GAP)
    if place is None:
        table = np.zeros(top + 1, dtype=np.int64)
        table[present] = letters
        out = table[code]
    else:
        out = letters[place]
    out = np.concatenate([[_GAP], out, [_GAP]])
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != _GAP) | (out[:-1] != _GAP)
    return out[keep]


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three code points of 21 bits each in a number) of a whole text and their counts."""
    code = letter_codes(text or "")
    if not (code != _GAP).any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    tri = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
    return np.unique(tri, return_counts=True)


def _signs(code: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """A random vector of +1 and -1 for each letter, from a hash of the letter alone."""
    words = mix64(code.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim // 64, dtype=np.uint64) + np.uint64(seed << 32))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def trigram_vectors(tri: np.ndarray, p: LangParams) -> np.ndarray:
    """Bound vectors: the first letter permuted twice, the second once, multiplied with the third."""
    mask = (1 << 21) - 1
    letters, inverse = np.unique(np.concatenate([tri >> 42, (tri >> 21) & mask, tri & mask]), return_inverse=True)
    base = _signs(letters, p.dim, p.seed)
    a, b, c = inverse.reshape(3, -1)
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def _bundles(counts: list[tuple[np.ndarray, np.ndarray]], p: LangParams) -> np.ndarray:
    """Document vectors: counts times trigram vectors, in blocks of trigrams."""
    out = np.zeros((len(counts), p.dim), dtype=np.float32)
    if not counts:
        return out
    every = np.unique(np.concatenate([t for t, _ in counts]))
    at = [np.searchsorted(every, t) for t, _ in counts]
    for lo in range(0, len(every), 8192):
        vec = trigram_vectors(every[lo : lo + 8192], p)
        dense = np.zeros((len(counts), len(vec)), dtype=np.float32)
        for row, pos, (_, n) in zip(dense, at, counts, strict=True):
            a, b = np.searchsorted(pos, [lo, lo + len(vec)])
            row[pos[a:b] - lo] = n[a:b]
        out += dense @ vec
    return out


def _grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        if held and (size + len(t or "") > _BLOCK_CHARS or len(held) >= 256):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def fit_profiles(docs: DataFrame, params: LangParams = LangParams()) -> dict[str, np.ndarray]:
    """The prototype of each language: the bundle of all its training documents' trigrams.

    Training rows have a non-null lang and crc32(doc_id as text) mod 4 other than 2.
    Tasks add up trigram counts and send one vector a language; sums are of whole
    numbers, so they are the same in any order.  One vector a language reaches the driver.
    """
    p = params
    train = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        vectors: dict[str, np.ndarray] = {}

        def fold(lang: str) -> None:
            parts = total.pop(lang)
            tri, inverse = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([c for _, c in parts]).astype(np.float64))
            for lo in range(0, len(tri), 8192):
                vectors[lang] = vectors.get(lang, 0) + n[lo : lo + 8192] @ trigram_vectors(tri[lo : lo + 8192], p).astype(np.float64)

        held: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tri, n = trigram_counts(text)
                if len(tri):
                    total.setdefault(lang, []).append((tri, n))
                    held[lang] = held.get(lang, 0) + len(tri)
                    if held[lang] > 1_000_000:
                        fold(lang)
                        held[lang] = 0
        for lang in list(total):
            fold(lang)
        langs = [x for x, v in vectors.items() for _ in range(p.dim)]
        pos = np.tile(np.arange(p.dim, dtype=np.int32), len(vectors))
        value = np.concatenate([*vectors.values(), np.zeros(0)])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pos), pa.array(value)], ["lang", "pos", "value"])

    sums = train.mapInArrow(run, "lang string, pos int, value double").groupBy("lang", "pos").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # dim numbers a language
        out.setdefault(r["lang"], np.zeros(p.dim))[r["pos"]] = r["value"]
    return {k: out[k] / max(np.sqrt((out[k] ** 2).sum()), 1e-300) for k in sorted(out)}


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame, params: LangParams = LangParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    Each whole text is one bundle of bound letter trigrams; the prediction is the
    prototype of highest cosine (the first by name of equal ones), and the score that
    cosine, at least 0.  A null text, or one without a letter, and every text when
    nothing could be learned, is ``und`` with score 0.  A null doc_id is not held out;
    repeated rows are predicted alike.  Columns other than doc_id, text and, for
    learning, lang are not read.  An empty table gives an empty result.
    """
    p = params
    profiles = fit_profiles(docs, p)
    names = list(profiles)
    held = docs.sparkSession.sparkContext.broadcast(np.array([profiles[x] for x in names], dtype=np.float32).reshape(len(names), p.dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto = held.value
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            for texts in _grouped(batch.column(2).to_pylist()):
                counts = [trigram_counts(t) for t in texts]
                vec = _bundles(counts, p)
                norm = np.sqrt((vec.astype(np.float64) ** 2).sum(axis=1))
                for (tri, _), v, n in zip(counts, vec, norm, strict=True):
                    if not len(tri) or not names or n == 0:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    cos = proto @ v / n
                    best = int(cos.argmax())
                    pred.append(names[best])
                    score.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
