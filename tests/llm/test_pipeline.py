"""The stages over small tables, each held against a plain version of what it must do."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from facetspark.llm import pii
from facetspark.llm.minhash import MinHashParams, near_duplicates
from facetspark.llm.quality import QualityParams, fit_quality
from facetspark.llm.tokens import WordTokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality_score", "__copies", "tie", "copies", "n", "component_id"]


@pytest.fixture(scope="module")
def odd(spark, sf):
    """Real rows with nulls in every column, empty and long texts, repeated rows and clashing names."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [rows[3], rows[3], (rows[4][0], rows[4][1], "xx", rows[4][3], 1), (9001, None, None, None, None), (9002, "", "en", None, 0), (None, "a text of no id", None, "s", None)]
    rows += [(None, None, None, None, None), (9003, " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)), "en", "s", 1), (9004, "mail me@host.example.org or 10.1.2.3", "en", "s", 36)]
    return spark.createDataFrame([(*r, 1.5, "c", 7, 8, 9, 10) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, quality_score double, __copies string, tie long, copies int, n int, component_id long")


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def test_quality_keeps_what_scores_high(spark, sf, odd):
    out = corpus_pipeline.quality(spark, odd, sf)
    assert out.columns == COLUMNS
    p = QualityParams()
    model = fit_quality(odd, spark.read.parquet(f"{sf}/labels.parquet"), p)

    def score(text):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        return 1 / (1 + np.exp(-model.margins(data, np.array([0, len(data)]))[0]))

    assert plain(out.collect()) == plain(r for r in odd.collect() if score(r["text"]) >= p.threshold)


def test_dedup_keeps_the_first_of_each_group(spark, sf, odd):
    out = corpus_pipeline.dedup(spark, odd, sf)
    assert out.columns == COLUMNS

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    rows = odd.collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows if r["doc_id"] is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert plain(out.collect()) == plain(r for r in rows if r["doc_id"] is None or find(r["doc_id"]) == r["doc_id"])
    assert near_duplicates(odd, MinHashParams()).count() == len(rows)


def test_pii_changes_nothing_but_spans(spark, sf, odd):
    out = corpus_pipeline.pii(spark, odd, sf)
    assert out.columns == COLUMNS and out.count() == odd.count()
    crf = pii.train_crf()
    want = []
    for r in odd.collect():
        new = r["text"]
        if new:
            data = np.frombuffer(new.encode(), dtype=np.uint8)
            _, every = next(pii.all_spans([new], data, np.array([0, len(data)]), crf))
            new = pii.redact(new, every)
        want.append((r[0], new, r[2], r[3], r[4] if new == r["text"] else len(new), *r[5:]))
    assert plain(out.collect()) == plain(want)
    assert [r["text"] for r in out.filter("doc_id = 9004").collect()] == ["mail [EMAIL] or [IP]"]


def test_mix_takes_rows_as_often_as_the_operator_says(spark, sf, odd):
    from facetspark.llm.mixing import mix_sources

    out = corpus_pipeline.mix(spark, odd, sf).collect()
    assert list(out[0].asDict()) == COLUMNS
    assert plain(out) == plain(corpus_pipeline.mix(spark, odd, sf).collect())
    assert set(map(tuple, out)) <= set(map(tuple, odd.collect()))
    want = {}
    for r in mix_sources(odd).collect():
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["copies"]
    have = dict.fromkeys(want, 0)
    for r in out:
        have[r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))] += 1
    assert have == want


def test_pack_places_every_id(spark, sf, odd):
    lib = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in odd.collect():
        ids = lib.ids(r["text"]) + bytes(4)
        want += [(r["doc_id"], k // 8192, k // 4, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])) for k in range(0, len(ids), 8192)]
    got = corpus_pipeline.pack(spark, odd, sf).collect()
    assert plain(r[:5] for r in got) == plain(want)
    rooms: dict = {}
    for r in got:
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in rooms.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, sf, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.filter("false"), sf)
        assert out.count() == 0 and (name == "pack" or out.columns == COLUMNS)


def test_run_joins_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test-stage")
    assert plain(corpus_pipeline.run(spark, sf).collect()) == plain(docs.collect())
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
