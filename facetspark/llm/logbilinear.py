"""Language-model scores: a log-bilinear model of token classes, trained by noise-contrastive estimation.

The most frequent tokens are classes of their own; the others share classes by their first and
last letters, and within such a class a token has its share of the class's counts.  A context is
the two tokens before.  Its prediction is a sum of two linear maps of their vectors, so the
logits of all contexts are sums of two matrices and all normalisers are one matrix product:
every probability is normalised over the known tokens and one unknown token a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textbytes import blocks, lower_ascii, mix64, runs_of, text_buffers, word_bounds, word_hashes


@dataclass(frozen=True)
class LmParams:
    #: Tokens that are classes of their own, and classes that the others share.
    words: int = 511
    shared: int = 512
    dim: int = 16
    #: Passes over the training side; after each the tasks' models are averaged.
    rounds: int = 2
    rate: float = 0.05
    batch: int = 8192
    #: Noise classes drawn for each batch.
    noise: int = 32
    seed: int = 11
    #: Most frequent tokens whose counts go to every task; the others' are joined.
    head: int = 1 << 18
    fan_in: int = 32
    held_rows: int = 1_000_000


#: The token after the last word; hashes of words are of 64 bits, so that V distinct tokens collide with a chance of V * V / 2**65.
END = np.int64(-0x61C8864680B583EB)


def _held_out(column: str) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray, shared: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, offsets of their tokens, token hashes, shared classes) of each block of texts; each document closes with END."""
    for a, b in blocks(offsets):
        part = lower_ascii(data[offsets[a] : offsets[b]])
        offs = offsets[a : b + 1] - offsets[a]
        starts, ends, doc = word_bounds(part, offs)
        n = np.bincount(doc, minlength=b - a) + 1
        at = np.concatenate([[0], np.cumsum(n)])
        h = np.full(at[-1], END, dtype=np.int64)
        cls = np.zeros(at[-1], dtype=np.int64)
        spot = np.arange(len(starts)) + doc
        if len(starts):
            h[spot] = word_hashes(part, starts, ends).view(np.int64)
            second, last, fore = part[np.minimum(starts + 1, ends - 1)], part[ends - 1], part[np.maximum(ends - 2, starts)]
            look = part[starts].astype(np.uint64)
            for x in (second, last, fore):
                look = look << np.uint64(8) | x
            cls[spot] = (mix64(look + np.uint64(1)) % np.uint64(shared)).astype(np.int64)
        yield b - a, at, h, cls


def _token_counts(docs: DataFrame, p: LmParams) -> DataFrame:
    """(h, shared, n) of every token of the texts."""

    def combine(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = runs_of(h)
        return h[order[first]], c[order[first]], np.add.reduceat(n[order], first)

    def send(held: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in held], ["h", "shared", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for _, _, h, c in _tokens(*text_buffers(batch.column(0)), p.shared):
                order, first = runs_of(h)
                held.append((h[order[first]], c[order[first]], np.diff(np.append(first, len(h)))))
                rows += len(first)
                if rows > p.held_rows:
                    held = [combine(held)]
                    rows = len(held[0][0])
                    if rows > p.held_rows // 2:
                        yield from send(held[0])
                        held, rows = [], 0
        if held:
            yield from send(combine(held))

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, shared long, n long")
    return rows.groupBy("h", "shared").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Classes:
    """Counts that every task holds: the most frequent tokens by hash, and the mass of each class."""

    head: np.ndarray
    head_n: np.ndarray
    head_class: np.ndarray
    #: Class 0 is END; then the words; then the shared classes.
    words: int
    mass: np.ndarray
    total: int
    distinct: int

    def look_up(self, h: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of each token; a count of -1 is not in the head."""
        if not len(self.head):
            return np.where(h == END, 0, 1 + self.words + shared), np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        hit = self.head[at] == h
        own = np.where(hit, self.head_class[at], -1)
        return np.where(h == END, 0, np.where(own >= 0, own, 1 + self.words + shared)), np.where(hit, self.head_n[at], -1)


def _classes(counts: DataFrame, p: LmParams) -> Classes:
    """The head has a bounded number of rows, and so have the shared classes.

    The head is all tokens above a count, the least of those (by sixteenths of a power of
    two) that leaves no more than ``head`` of them.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    least, rows = 0, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 1,024 levels
        rows += r["count"]
        if rows > p.head:
            least = r["level"] + 1
            break
    top = counts.filter(level >= least).select("h", "shared", "n").toPandas().sort_values(["n", "h"], ascending=[False, True])
    per = counts.filter(F.col("h") != F.lit(int(END))).groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    ends = counts.filter(F.col("h") == F.lit(int(END))).first()
    h, shared, n = (top[c].to_numpy(dtype=np.int64) for c in ("h", "shared", "n"))
    order = np.argsort(h)
    cls = np.full(len(h), -1, dtype=np.int64)
    own = np.flatnonzero(h != END)[: p.words]
    cls[own] = 1 + np.arange(len(own))
    cls[h == END] = 0
    size, kinds = np.zeros(p.shared, dtype=np.int64), np.zeros(p.shared, dtype=np.int64)
    size[per["shared"].to_numpy(dtype=np.int64)] = per["n"].to_numpy(dtype=np.int64)
    kinds[per["shared"].to_numpy(dtype=np.int64)] = per["v"].to_numpy(dtype=np.int64)
    end_n = ends["n"] if ends else 0
    total, distinct = int(size.sum()) + end_n, int(kinds.sum()) + (end_n > 0)
    np.subtract.at(size, shared[own], n[own])
    np.subtract.at(kinds, shared[own], 1)
    mass = np.concatenate([[end_n + 0.5], n[own] + 0.5, size + 0.5 * (kinds + 1)])
    return Classes(h[order], n[order], cls[order], len(own), mass, total, distinct)


class Bilinear:
    """Vectors r of context classes, a map for each place before, vectors s and biases b of predicted classes."""

    def __init__(self, r: np.ndarray, maps: np.ndarray, s: np.ndarray, b: np.ndarray):
        self.r, self.maps, self.s, self.b = r, maps, s, b

    @staticmethod
    def start(mass: np.ndarray, p: LmParams) -> "Bilinear":
        """Near the classes' own shares, whatever the context."""
        rng = np.random.default_rng(p.seed)
        m = len(mass)
        maps = np.stack([np.eye(p.dim), np.eye(p.dim)]) * 0.5
        return Bilinear(rng.normal(0, 0.1, (m, p.dim)), maps, rng.normal(0, 0.1, (m, p.dim)), np.log(mass / mass.sum()))

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.maps, self.s, self.b)])

    @staticmethod
    def unpack(flat: np.ndarray, classes: int, dim: int) -> "Bilinear":
        cuts = np.cumsum([classes * dim, 2 * dim * dim, classes * dim])
        r, maps, s, b = np.split(flat, cuts)
        return Bilinear(r.reshape(classes, dim), maps.reshape(2, dim, dim), s.reshape(classes, dim), b)

    def log_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one, two, norm): ln p(w | c1, c2) = one[c1, w] + two[c2, w] - norm[c1, c2], where c1 is just before w."""
        one = self.r @ self.maps[0] @ self.s.T + self.b
        two = self.r @ self.maps[1] @ self.s.T
        top, over = one.max(axis=1), two.max(axis=1)
        norm = np.log(np.exp(one - top[:, None]) @ np.exp(two - over[:, None]).T) + top[:, None] + over[None, :]
        return one, two, norm


def _contexts(at: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the two tokens before each token; END stands before a document."""
    one, two = np.zeros_like(cls), np.zeros_like(cls)
    one[1:] = cls[:-1]
    two[2:] = cls[:-2]
    two[at[:-1]] = 0  # the one before is another document's END
    return one, two


class _Trainer:
    """Noise-contrastive steps with AdaGrad on a task's own copy of the model."""

    def __init__(self, model: Bilinear, mass: np.ndarray, p: LmParams, seed: list[int], rate: float):
        self.p, self.rate, self.rng = p, rate, np.random.default_rng(seed)
        self.r, self.maps, self.s, self.b = (x.astype(np.float32) for x in (model.r, model.maps, model.s, model.b))
        self.seen = [np.full(x.shape, 1e-8, dtype=np.float32) for x in (self.r, self.maps, self.s, self.b)]
        share = mass / mass.sum()
        self.upto, self.log_noise = np.cumsum(share), np.log(p.noise * share).astype(np.float32)
        self.tokens = 0

    def _move(self, k: int, x: np.ndarray, g: np.ndarray) -> None:
        self.seen[k] += g * g
        x += self.rate * g / np.sqrt(self.seen[k])

    def step(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> None:
        m, t = len(self.b), len(w)
        drawn = np.minimum(np.searchsorted(self.upto, self.rng.random(self.p.noise)), m - 1)
        # A context's prediction is a sum of two mapped vectors, so both maps work on the classes' table.
        first, second = self.r @ self.maps[0], self.r @ self.maps[1]
        pred, own = first.take(one, axis=0) + second.take(two, axis=0), self.s.take(w, axis=0)
        true = np.einsum("ij,ij->i", pred, own) + (self.b - self.log_noise)[w]
        fake = pred @ self.s[drawn].T + (self.b - self.log_noise)[drawn]
        up = 1 / (1 + np.exp(np.minimum(true, 30)))
        down = -1 / (1 + np.exp(np.minimum(-fake, 30)))
        back = up[:, None] * own + down @ self.s[drawn]
        gs, g1, g2 = (np.zeros_like(self.r) for _ in range(3))
        gb = np.bincount(w, up, m).astype(np.float32)
        _add_rows(gs, w, up[:, None] * pred)
        np.add.at(gs, drawn, down.T @ pred)
        np.add.at(gb, drawn, down.sum(axis=0))
        _add_rows(g1, one, back)
        _add_rows(g2, two, back)
        gr = g1 @ self.maps[0].T + g2 @ self.maps[1].T
        gm = np.stack([self.r.T @ g1, self.r.T @ g2])
        for k, (x, g) in enumerate(((self.r, gr), (self.maps, gm), (self.s, gs), (self.b, gb))):
            self._move(k, x, g / t)
        self.tokens += t

    def model(self) -> Bilinear:
        return Bilinear(*(x.astype(np.float64) for x in (self.r, self.maps, self.s, self.b)))


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order, first = runs_of(at)
    to[at[order[first]]] += np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def train_pass(docs: DataFrame, classes: Classes, model: Bilinear, p: LmParams, k: int) -> Bilinear:
    """The average of the models that the tasks reach over their own texts, weighed by tokens.

    Averages are taken over a tree of ``fan_in`` models a node, so that neither a task nor
    the driver holds more of them.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((classes, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = held.value
        task = TaskContext.get().partitionId()
        trainer = _Trainer(start, own.mass, p, [p.seed, k, task], p.rate / (k + 1))
        left: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for batch in batches:
            for _, at, h, shared in _tokens(*text_buffers(batch.column(0)), p.shared):
                cls, _ = own.look_up(h, shared)
                left.append((*_contexts(at, cls), cls))
                waiting += len(cls)
                if waiting >= 16 * p.batch:
                    rows = [np.concatenate(x) for x in zip(*left, strict=True)]
                    mixed = trainer.rng.permutation(waiting)
                    for i in range(0, waiting, p.batch):
                        trainer.step(*(x[mixed[i : i + p.batch]] for x in rows))
                    left, waiting = [], 0
        if waiting:
            rows = [np.concatenate(x) for x in zip(*left, strict=True)]
            mixed = trainer.rng.permutation(waiting)
            for i in range(0, waiting, p.batch):
                trainer.step(*(x[mixed[i : i + p.batch]] for x in rows))
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int64()), pa.array([float(trainer.tokens)]), pa.array([trainer.model().pack().tobytes()], pa.binary())], ["node", "weight", "model"]
            )

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = pdf["weight"].to_numpy()
        total = sum(np.frombuffer(m) * w for m, w in zip(pdf["model"], weight, strict=True)) / weight.sum()
        return pd.DataFrame({"node": [int(pdf["node"].iloc[0]) // p.fan_in], "weight": [weight.sum()], "model": [total.tobytes()]})

    schema = "node long, weight double, model binary"
    nodes = materialize(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "lm-models")
    while nodes.count() > 1:
        nodes = materialize(nodes.groupBy(F.floor(F.col("node") / p.fan_in).alias("up")).applyInPandas(average, schema), "lm-models")
    last = nodes.first()
    return Bilinear.unpack(np.frombuffer(last["model"]), len(classes.mass), p.dim) if last else model


@dataclass(frozen=True)
class LanguageModel:
    counts: DataFrame
    classes: Classes
    model: Bilinear
    params: LmParams


def fit_language_model(docs: DataFrame, params: LmParams = LmParams()) -> LanguageModel:
    """Counts and a model of all texts of ``docs`` that are not held out."""
    train = docs.filter(~_held_out("doc_id"))
    counts = materialize(_token_counts(train, params), "lm-counts")
    classes = _classes(counts, params)
    model = Bilinear.start(classes.mass, params)
    for k in range(params.rounds):
        model = train_pass(train, classes, model, params, k)
    return LanguageModel(counts, classes, model, params)


def score_texts(docs: DataFrame, lm: LanguageModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Counts of the most frequent tokens are with every task; each row's other tokens are
    written beside it and joined to the table of counts by hash.
    """
    p, classes = lm.params, lm.classes
    held = docs.sparkSession.sparkContext.broadcast((classes, *(t.astype(np.float32) for t in lm.model.log_tables())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, second, norm = held.value
        log_all = np.log10(own.total + 0.5 * (own.distinct + 1))
        log_mass = np.log10(own.mass)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for docs_in, at, h, shared in _tokens(*text_buffers(batch.column(2)), p.shared):
                cls, n = own.look_up(h, shared)
                c1, c2 = _contexts(at, cls)
                model = (first[c1, cls].astype(np.float64) + second[c2, cls] - norm[c1, c2]) / np.log(10)
                alone = cls <= own.words
                tail = n < 0
                # An unknown token's share; a join adds what a known one has more.
                share = np.log10(np.maximum(n, 0) + 0.5)
                base, score = share - log_all, model + np.where(alone, 0.0, share - log_mass[cls])
                doc = np.repeat(np.arange(docs_in), np.diff(at))[tail]
                order, lead = runs_of(mix64(h[tail].view(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                lead_at = order[lead]
                again = np.argsort(doc[lead_at], kind="stable")
                cuts = np.searchsorted(doc[lead_at][again], np.arange(docs_in + 1))
                times = np.diff(np.append(lead, len(order)))[again]
                rare = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(h[tail][lead_at][again]), pa.array(times)], ["h", "times"]))
                add = lambda x: pa.array(np.add.reduceat(x, at[:-1]))
                part = [pa.array(number + np.arange(docs_in)), *(batch.column(i).slice(done, docs_in) for i in (0, 1)), pa.array(np.diff(at)), add((n > 0).astype(np.int64)), add(base), add(score), rare]
                yield pa.RecordBatch.from_arrays(part, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])
                number += docs_in
                done += docs_in

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<h: bigint, times: bigint>>"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = materialize(base.mapInArrow(run, schema), "lm-rows")
    more = (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5))) * F.col("times")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(lm.counts.select("h", "n"), "h")
    rare = rare.groupBy("row").agg(F.sum("times").alias("known"), F.sum(more).alias("more"))
    out = rows.drop("rare").join(rare, "row", "left").na.fill(0, ["known"]).na.fill(0.0, ["more"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(classes.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("more")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
    )


def lm_scores(docs: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out; all whole texts of the others
    are counted and trained on, repeated rows each time.  A null text is empty and has the
    end token alone; a null doc_id is not held out.  A score depends on the row's text and the
    model only.  Columns other than doc_id and text are not read.  An empty table gives an
    empty result; without training texts both scores rest on unknown tokens.
    """
    return score_texts(docs, fit_language_model(docs, params))
