"""Each operator against a plain version, with nulls, empty and long texts, repeated rows, clashing columns and no rows."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from facetspark.llm import pii
from facetspark.llm.dac import Segment, TokenFileParams, encode_segment, token_round_trip
from facetspark.llm.flatgraph import GraphParams, embedding_duplicates, missed_links, pruned_graph, range_search, unit_rows
from facetspark.llm.hdlang import identify_language
from facetspark.llm.kdtree import TopKParams, top_inner_products
from facetspark.llm.minhash import MinHashParams, near_duplicates
from facetspark.llm.mixing import MixParams, mix_sources, mixed_documents
from facetspark.llm.packing import PackParams, fit_repeats, pack_documents, plan_runs
from facetspark.llm.quality import QualityModel, QualityParams, quality_scores
from facetspark.llm.tokens import WordTokenizer
from facetspark.llm.urlrules import UrlRuleParams, judge_urls

BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source): odd texts, copies, near copies and a source with most rows."""
    rng = random.Random(5)
    texts = [None, "", "   ", "one", "one two", "ONE Two", "!!! 123", "é\u0301 ß İ ﬁ\x1c x", words(rng, 3000), "1" * 5000, "a" * 3000 + "@" + "b" * 3000]
    base = words(rng, 120)
    texts += [base, base, base.upper(), " ".join(base.split()[:-1]), base + " tail end"]
    texts += [words(rng, rng.randint(1, 200)) for _ in range(60)]
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3], None if i % 11 == 0 else ("hot" if i % 3 else f"s{i % 4}")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside, and one row repeated."""
    df = spark.createDataFrame([*rows, rows[20]], "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "component_id": F.lit(1), "size": F.lit("x"), "rank": F.lit(0), "__x": F.lit(1)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(n, links):
    root = {i: i for i in n}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_minhash(docs, none, rows):
    sets = {r[0]: shingles(r[1], 3) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = near_duplicates(docs, MinHashParams(width=3, percent=85)).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert near_duplicates(none).count() == 0


def test_pii_base_is_the_plain_patterns():
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {
            "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
            "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15,
        }[kind]

    rng = random.Random(6)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@@+- (20.9.") for _ in range(rng.randint(0, 45)))
        want = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if ok(k, m.group())]
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(spark, docs, none):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert got[0]["spans"] == "" and got[0]["n_email"] == 0
    text = 'Write to ann.lee@mail.example.com from 10.0.0.1 now token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here\nand a calm line.'
    one = spark.createDataFrame([(1, text, len(text)), (2, None, None)], "doc_id long, text string, n_chars long")
    r = pii.find_pii(one).filter("doc_id = 1").first()
    assert (r["n_email"], r["n_ip"], r["n_secret"]) == (1, 1, 1)
    out = {r["doc_id"]: r for r in pii.redact_pii(one).collect()}
    assert out[1]["text"] == 'Write to [EMAIL] from [IP] now token = "[SECRET]" here\nand a calm line.' and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None
    assert pii.find_pii(none).count() == 0


def spans_of(text, crf):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    _, every = next(pii.all_spans([text], data, np.array([0, len(data)]), crf))
    return [(k, text[a:b]) for k, a, b in every]


def test_pii_finds_forms_that_the_table_does_not_have():
    crf = pii.train_crf()
    hexa = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    found = {
        "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY": ("secret", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
        "the password is swordfish42": ("secret", "swordfish42"),
        "'password': 'correct horse battery staple'": ("secret", "correct horse battery staple"),
        f'the file token = "{hexa}" was left': ("secret", hexa),
        f'in%%% token$$$ =%%% "{hexa}"### and&&&': ("secret", hexa),
        f'ABC!! TOKEN!! =!! "{hexa.upper()}"!! DEF': ("secret", hexa.upper()),
        "Dear Mrs. Eleanor Whitfield, thank you": ("person", "Eleanor Whitfield"),
        "naïve – set SECRET=hunter2!longpass99; done": ("secret", "hunter2!longpass99"),
    }
    for text, span in found.items():
        assert spans_of(text, crf) == [span], text
    for text in ("commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixed it", "The key was under the mat. Margaret knew the secret.", "version 3.1.4 of the token ring"):
        assert spans_of(text, crf) == []


def test_pii_spans_by_a_table_of_ones_own():
    lines = ["the code [[secret:{}]] is old".format(w) for w in ("a1b2c3", "z9y8x7", "k5m6n7")] + ["the code word is old", "nothing here"]
    assert spans_of("the code q3w4e5 is old", pii.train_crf(tuple(lines))) == [("secret", "q3w4e5")]
    pii.train_crf.cache_clear()


def test_viterbi_is_the_best_of_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    step = rng.normal(size=(pii._LABELS, pii._LABELS)) + pii._step_mask()
    sizes = [1, 2, 3, 4, 4]
    seq = np.repeat(np.arange(len(sizes)), sizes)
    emit = rng.normal(size=(len(seq), pii._LABELS))
    got, sure = pii.viterbi(emit, seq, step), pii.decode(emit, seq, step)
    assert (got == sure).all()
    for k in range(len(sizes)):
        e = emit[seq == k]
        paths = [p for p in itertools.product(range(pii._LABELS), repeat=len(e)) if p[0] == 0 or p[0] % 2]
        best = max(paths, key=lambda p: sum(e[t, p[t]] for t in range(len(e))) + sum(step[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(got[seq == k]) == best


def test_sequences_that_are_surely_outside_need_no_decoding():
    rng = np.random.default_rng(4)
    step = rng.normal(size=(pii._LABELS, pii._LABELS)) + pii._step_mask()
    seq = np.repeat(np.arange(300), rng.integers(1, 30, 300))
    emit = rng.normal(size=(len(seq), pii._LABELS))
    emit[:, 0] += rng.uniform(0, 9, 300)[seq]
    assert (pii.viterbi(emit, seq, step) == pii.decode(emit, seq, step)).all()


def test_crf_gradient():
    rng = np.random.default_rng(5)
    rows = np.repeat([0, 1, 2], [3, 1, 4])
    y = np.array([0, 1, 2, 3, 0, 5, 6, 0])
    emit, step = rng.normal(size=(8, pii._LABELS)), rng.normal(size=(pii._LABELS, pii._LABELS)) + pii._step_mask()
    total, by_emit, by_step = pii.log_likelihood(emit, step, y, rows)
    for i, k in ((0, 0), (2, 2), (4, 3), (7, 1)):
        moved = emit.copy()
        moved[i, k] += 1e-5
        assert (pii.log_likelihood(moved, step, y, rows)[0] - total) / 1e-5 == pytest.approx(by_emit[i, k], abs=1e-3)
    for a, b in ((0, 0), (1, 2), (5, 6), (0, 5)):
        moved = step.copy()
        moved[a, b] += 1e-5
        assert (pii.log_likelihood(emit, moved, y, rows)[0] - total) / 1e-5 == pytest.approx(by_step[a, b], abs=1e-3)


def test_pii_spans_and_digest(spark):
    import hashlib

    texts = ["é me@a.example.org, pwd: hunter27 and 10.0.0.1", None, "", "plain words"]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["spans"] == "email:2:18,secret:25:33,ip:38:46"
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:2:18,ip:38:46").hexdigest()
    assert {got[i]["base_sha256"] for i in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()} and {got[i]["spans"] for i in (1, 2, 3)} == {""}


def test_pii_time_is_linear():
    import time

    crf = pii.train_crf()
    part = 'mail a@b.example.org or token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é '
    took = []
    for n in (500, 4000):
        start = time.process_time()
        assert len(spans_of(part * n, crf)) == 2 * n
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0] + 1


def test_urls(spark):
    rng = random.Random(7)
    hosts = ["org", "example.org", "x.example.org", "notexample.org", "a.com", "com", "x.net", "ORG", "a..org", "", "org.", "-.org"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['/', '/es/1', '/en/12?x', '/fr/', '/de/#t', '', '?q', '/en/2'])}" for _ in range(300)] + [None, "", "org/es/", "a://b://c/d"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("x.example.org", "/", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, key string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [(h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit, key=lambda r: len(r[0])) if fit else (None, "allow")))

    for block in (200_000, 2):  # in one sweep and in several
        got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, table, UrlRuleParams(block=block)).collect()}
        assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert judge_urls(pages.filter("false"), table).count() == 0
    assert judge_urls(pages, table.filter("false")).filter("rule is not null").count() == 0


def test_mix(docs, none, rows):
    p = MixParams(leaf=7, fan_in=3)
    got = mix_sources(docs, p).collect()
    again = mix_sources(docs, p).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by: dict = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = 1.5 * sum(r["size"] for r in got)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
    out = mixed_documents(docs, p)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mix_sources(none).count() == 0


def test_tokens_match_the_library(rows):
    w = WordTokenizer(BPE, memo_entries=500)
    texts = [r[1] for r in rows] + ["don't x's 'll a_b ^`{ <|endoftext|> ﬁ ＡＢ x%%% É.", "a b\u3000c\x85d", '"\'S "\'re ÀÉ\'s ª² ½x µ× Œuf l\'Été ÿŸ \xad- a\xa0b \x7f ẞ']
    texts += ["".join(map(chr, range(k, k + 64))) for k in range(0, 640, 64)] + [" ".join(chr(k) + "a" + chr(k) for k in range(33, 700))]
    for t in [*texts, *texts]:
        assert np.frombuffer(w.ids(t), dtype="<u4").tolist() == w._model.encode(t or "", add_special_tokens=False).ids


def test_long_texts_are_split_at_spaces_only(monkeypatch):
    from facetspark.llm import tokens

    text = words(random.Random(3), 3000)
    whole = WordTokenizer(BPE).ids(text)
    monkeypatch.setattr(tokens, "SLICE_CHARS", 37)
    assert WordTokenizer(BPE).ids(text) == whole


def test_pack(docs, none, rows):
    got = pack_documents(docs, PackParams(BPE, capacity=64), with_ids=True).collect()
    lib = WordTokenizer(BPE)
    want = {}
    for r in [*rows, rows[20]]:
        ids = lib.ids(r[1]) + (0).to_bytes(4, "little")
        for k in range(0, len(ids), 256):
            key = (r[0], k // 256, k // 4, len(ids[k : k + 256]) // 4, zlib.crc32(ids[k : k + 256]))
            want[key] = want.get(key, 0) + 1
    have: dict = {}
    sequences: dict = {}
    for r in got:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        have[key] = have.get(key, 0) + 1
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.1 * sum(r["length"] for r in got) / 64 + 1
    assert pack_documents(none, PackParams(BPE)).count() == 0


@pytest.mark.parametrize("n", [1, 30, 1000, 20000])
def test_patterns_place_the_pieces(n):
    rng = np.random.default_rng(n)
    p = PackParams(BPE)
    h = np.bincount(np.minimum(rng.lognormal(6.2, 0.9, n).astype(int) + 1, 2048), minlength=2049)
    runs, residual = plan_runs(h, p)
    placed = np.zeros(2049, dtype=int)
    for pattern, k in runs:
        assert sum(pattern) <= 2048 and k > 0
        np.add.at(placed, list(pattern), k)
    assert (placed == h).all()
    assert sum(k for _, k in runs) <= 1.01 * -(-(np.arange(2049) * h).sum() // 2048) + 1
    assert residual <= max(30, 0.1 * n)


def test_repeats_are_the_least_squares():
    h = np.array([0, 4, 2, 0, 3, 0])
    patterns = np.array([[4, 1, 0], [2, 2, 1], [2, 1, 1]])
    a = np.array([[(row == v).sum() for row in patterns] for v in (1, 2, 4)], dtype=float)
    grid = np.stack(np.meshgrid(*[np.arange(0, 4.01, 0.05)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    best = ((grid @ a.T - h[[1, 2, 4]]) ** 2).sum(axis=1).min()
    x = fit_repeats(h, patterns, 3000)
    assert (x >= 0).all() and ((a @ x - h[[1, 2, 4]]) ** 2).sum() <= best + 1e-3


def test_dac_round_trip():
    rng = np.random.default_rng(8)
    for n in (0, 1, 511, 512, 5000):
        ids = np.concatenate([rng.integers(0, 1 << b, n // 4 + 1) for b in (4, 10, 17, 32)])[:n].astype(np.uint32)
        s = Segment(encode_segment(ids))
        assert (s.all() == ids).all() and len(s) == n
        for i in rng.integers(0, max(n, 1), min(n, 40)):
            assert s[int(i)] == ids[i]


def test_token_files(docs, none, rows):
    got = sorted(token_round_trip(docs, TokenFileParams(BPE, segment_ids=500)).collect(), key=lambda r: r["start"])
    lib, at = WordTokenizer(BPE), 0
    for r, (i, text, *_) in zip(got, sorted([*rows, rows[20]], key=lambda r: r[0]), strict=True):
        ids = lib.ids(text) + (1).to_bytes(4, "little")
        assert tuple(r) == (i, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert token_round_trip(none, TokenFileParams(BPE)).count() == 0


def test_language(spark, sf, docs, none):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in identify_language(table).collect()}
    lang = {r["doc_id"]: r["lang"] for r in table.select("doc_id", "lang").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r for r in identify_language(docs).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[6]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in odd.values())
    assert identify_language(none).count() == 0


def test_language_is_the_nearest_profile(spark):
    from facetspark.llm.hdlang import LangParams, trigram_vectors

    p = LangParams(dim=256)
    rng = random.Random(12)
    texts = [words(rng, 30, a) for a in ("abcde", "efghi", "éüñaß") for _ in range(12)] + [None, "", "12 !", "x\U00020000y A\u0130b"]
    langs = ["p"] * 12 + ["q"] * 12 + ["r"] * 12 + ["p", "q", None, None]
    rows = list(enumerate(zip(texts, langs, strict=True)))
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in rows], "doc_id long, text string, lang string")

    def bundle(text):
        out = [""]
        for c in (text or "").lower():
            out.append(c if c.isalpha() else "")
        code = [0]
        for c in [*out[1:], ""]:
            if c or code[-1]:
                code.append(ord(c) if c else 0)
        total = np.zeros(p.dim)
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            total += trigram_vectors(np.array([(a << 42) | (b << 21) | c]), p)[0]
        return total

    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows}
    own = {i: bundle(t) for i, (t, _) in rows}
    protos = {}
    for i, (t, x) in rows:
        if x and t and not held[i]:
            protos[x] = protos.get(x, 0) + own[i]
    for r in identify_language(df, p).collect():
        v = own[r["doc_id"]]
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cos = {x: v @ w / np.linalg.norm(v) / np.linalg.norm(w) for x, w in protos.items()}
        best = max(sorted(cos), key=cos.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(max(0.0, cos[best]), abs=1e-5) and r["held_out"] == held[r["doc_id"]]


def test_quality_grams_are_of_characters():
    p = QualityParams(grams=(2,))
    rng = np.random.default_rng(2)
    model = QualityModel(rng.normal(size=(p.buckets, 4)), rng.normal(size=(4, 2)), np.zeros(2), p)
    from facetspark.llm.quality import doc_features

    def grams(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        feats, _, _ = next(doc_features(data, np.array([0, len(data)]), p))
        return feats[2].tolist()

    assert len(grams("é😀ab")) == 3 and grams("éab")[1:] == grams("😀ab")[1:] and grams("éab")[0] != grams("èab")[0]
    assert np.isfinite(model.margins(np.frombuffer("é".encode(), dtype=np.uint8), np.array([0, 2]))).all()


def test_source_targets_fill_like_water(spark):
    from facetspark.llm.mixing import source_targets

    rng = random.Random(13)
    for n in (1, 3, 40):
        sizes = {f"s{k:02d}": int(rng.lognormvariate(4, 2)) for k in range(n - 1)} | {None: 5}
        p = MixParams()
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: p.weights[k % 3] for k, s in enumerate(order)}
        total, level = 1.5 * sum(sizes.values()), [0.0, 1e12]
        for _ in range(200):  # the level at which the caps let all of the total in
            mid = sum(level) / 2
            level[sum(min(2 * sizes[s], mid * weight[s]) for s in order) >= total] = mid
        df = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
        got = {r["source"]: r for r in source_targets(df, p).collect()}
        for s in order:
            assert got[s]["source_size"] == sizes[s] and got[s]["target"] == pytest.approx(min(2.0 * sizes[s], level[1] * weight[s]), rel=1e-6)


def test_top_k_with_repeated_rows(spark):
    rows = [(0, [2.0, 1.0])] * 8 + [(7, [9.0, 9.0])] * 9 + [(8, [8.0, 8.0])] * 9 + [(i, [1.0, i / 10]) for i in range(11, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    best = sorted((-int(q[0] @ q[i]), i) for i in q if i)[:5]
    for p in (TopKParams(leaf_rows=200), TopKParams(leaf_rows=4)):
        assert sorted(map(tuple, top_inner_products(df, p).distinct().collect())) == [(0, k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_quality_does_not_depend_on_the_place_in_a_block():
    p = QualityParams()
    rng = np.random.default_rng(1)
    model = QualityModel(rng.normal(size=(p.buckets, 4)), rng.normal(size=(4, 2)), np.zeros(2), p)
    texts = [b"one two", b"abc", b"", b"x", b"one two", b"abc", b"x", b"", b"one two"]
    offsets = np.cumsum([0, *map(len, texts)])
    got = dict.fromkeys(texts)
    for t, m in zip(texts, model.margins(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets), strict=True):
        alone = model.margins(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))[0]
        assert m == pytest.approx(alone) and got[t] in (None, pytest.approx(m))
        got[t] = m


def test_quality_holds_features_of_little_text_at_once():
    import tracemalloc

    model = QualityModel(np.ones((1 << 17, 2)), np.ones((2, 2)), np.zeros(2), QualityParams())
    data = np.frombuffer(b"some words of a text " * 100_000, dtype=np.uint8)
    offsets = np.arange(0, len(data) + 1, 2100)
    tracemalloc.start()
    try:
        model.margins(data, offsets)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_pii_holds_tokens_of_little_text_at_once():
    import tracemalloc

    crf = pii.train_crf()
    data = np.frombuffer(b"my password is hunter2 of a text " * 60_000, dtype=np.uint8)
    offsets = np.arange(0, len(data) + 1, 3300)
    tracemalloc.start()
    try:
        found = pii.added_spans(data, offsets, crf)
        assert tracemalloc.get_traced_memory()[1] < 35 << 20
    finally:
        tracemalloc.stop()
    assert len(found) == len(offsets) - 1


def test_workers_keep_no_tokenizer_for_other_stages():
    from facetspark.llm import tokens
    from facetspark.llm.workers import tidy

    tokens.tokenizer(BPE)
    assert list(tidy(lambda batches: batches, tokenizes=True)(iter([1, 2]))) == [1, 2] and tokens._held
    assert list(tidy(lambda batches: batches)(iter([1, 2]))) == [1, 2] and not tokens._held


def test_quality(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    held = [r for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in held) >= 0.93 * len(held)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    odd = quality_scores(docs, labels.filter("false")).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_scores(none, labels).count() == 0


def vectors(seed=9):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 8))
    x = [list(map(float, v)) for v in [*base, *(base[:40] + rng.normal(0, 0.12, (40, 8))), *base[:5]]]
    return [*x, None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [float("inf")] * 8, [1.0, 2.0]]


def test_embedding_links(spark):
    rows = [(i, v) for i, v in enumerate(vectors())]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, cid string")
    ok = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    link = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95]
    comp = components([i for i, _ in rows], link)
    n = {i: sum(i in pair for pair in link) for i, _ in rows}
    got = embedding_duplicates(df, GraphParams(shard_rows=40, overlap=2)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}
    assert embedding_duplicates(df.filter("false")).count() == 0


def test_embedding_links_beside_a_hot_group(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(41, 8))
    x = np.concatenate([base, base + np.concatenate([rng.normal(0, 0.2, (40, 8)), np.full((1, 8), 0.001)])])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    copies = np.where(np.arange(82) % 41 == 40, 200_000, 1)
    df = spark.createDataFrame([(i, v.tolist(), int(copies[i])) for i, v in enumerate(x)], "i long, embedding array<double>, n int")
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).selectExpr("100 * k + i AS vec_id", "embedding")
    got = embedding_duplicates(df, GraphParams(shard_rows=8, overlap=1)).selectExpr("vec_id % 100 AS i", "n_links").distinct()
    assert sorted(map(tuple, got.collect())) == list(enumerate((hit @ copies - 1).tolist()))


@pytest.mark.parametrize("dense, split", [(256, 20_000), (20, 20_000), (20, 150)])
def test_embedding_ball_of_near_copies(spark, dense, split):
    rng = np.random.default_rng(31)
    x = np.concatenate([rng.normal(size=16) + rng.normal(0, 0.02, (1000, 16)), rng.normal(size=(200, 16))])
    x[1000:1030] = x[0] + rng.normal(0, 0.33, (30, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    comp = components(range(1200), np.argwhere(np.triu(hit)).tolist())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_duplicates(df, GraphParams(shard_rows=400, overlap=2, dense=dense, split_rows=split)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (int(hit[i].sum()), comp[i]) for i in range(1200)}


def test_every_link_of_a_shard_is_an_edge_or_reached():
    rng = np.random.default_rng(4)
    base = unit_rows(rng.normal(size=(20, 16)))
    side = unit_rows(base + 0.32 * unit_rows(rng.normal(size=(20, 16))))
    x = unit_rows(np.concatenate([c + rng.normal(0, 0.003, (60, 16)) for c in np.concatenate([base, side])]))
    p = GraphParams(candidates=6, degree=3, beam=2)
    adj = pruned_graph(x, p)
    row, late, dense = missed_links(x, adj, p)
    assert len(row) and not dense.any()
    wide = np.full((len(x), adj.shape[1] + np.bincount(row).max()), -1)
    wide[:, : adj.shape[1]] = adj
    wide[row, adj.shape[1] + np.arange(len(row)) - np.searchsorted(row, row)] = late
    who, node = range_search(x, wide, np.arange(len(x)), 0, p)
    hit = np.argwhere(np.triu(x @ x.T >= p.threshold, 1))
    assert {(min(k), max(k)) for k in zip(who.tolist(), node.tolist())} == set(map(tuple, hit.tolist()))


def test_top_k(spark):
    rows = [(i, v) for i, v in enumerate(vectors(10))]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    ok = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))[:5]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    for p in (TopKParams(), TopKParams(shard_rows=30, leaf_rows=4, query_rows=2, pilot_rows=20)):
        assert {tuple(r) for r in top_inner_products(df, p).collect()} == want
    assert top_inner_products(df.filter("false")).count() == 0


def test_ids_with_several_vectors_lose_no_link(spark):
    """Both vectors of id 1 must be searched, and join what they link with."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0, 0.0]), (3, [0.01, 1.0, 0.0, 0.0]), (5, [0.0, 0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    got = sorted(embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r) for r in got] == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (5, 0, 5, True), (None, 0, None, True)]


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_viterbi_of_pieces_equals_viterbi_of_whole_lines(monkeypatch, piece):
    rng = np.random.default_rng(piece)
    step = rng.normal(size=(pii._LABELS, pii._LABELS)) + pii._step_mask()
    seq = np.repeat(np.arange(30), rng.integers(1, 60, 30))
    emit = rng.normal(size=(len(seq), pii._LABELS))
    monkeypatch.setattr(pii, "_PIECE", 10_000)
    whole = pii.viterbi(emit, seq, step)
    monkeypatch.setattr(pii, "_PIECE", piece)
    assert (pii.viterbi(emit, seq, step) == whole).all()


def test_pii_spans_do_not_depend_on_their_place_in_a_line():
    crf = pii.train_crf()
    secret = "'password': 'correct horse battery staple'"
    lengths = [len(spans_of("filler " * n + secret, crf)) for n in [*range(245, 262), *range(495, 520), 2000]]
    assert set(lengths) == {1}


def test_pii_spans_do_not_depend_on_other_documents():
    crf = pii.train_crf()
    texts = ["token", "token = hunter27", "hunter27 hunter27", "Margaret", "Margaret Thatcher wrote", "", "wrote pwd: hunter27"] * 3
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    together = pii.added_spans(data, offsets, crf)
    assert [together.get(i, []) for i in range(len(texts))] == [pii.added_spans(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t)]), crf).get(0, []) for t in texts]


def test_quality_scores_do_not_depend_on_the_rows_beside_them(spark):
    """The same short text thrice, and real texts in another order: equal to the last bit."""
    p = QualityParams()
    rng = np.random.default_rng(4)
    model = QualityModel(rng.normal(size=(p.buckets, 4)), rng.normal(size=(4, 2)), np.zeros(2), p)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["river", "river", "river"]

    def margins(some):
        raw = [t.encode() for t in some]
        return model.margins(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))

    first, other = margins(texts), margins(texts[::-1])[::-1]
    assert (first == other).all() and len(set(first[-3:])) == 1


def plain_quality(texts, labels, new, p):
    """Features in dictionaries, one document at a time, and the same gradient steps without tables."""
    from facetspark.llm.textbytes import mix64, word_hashes

    def features(text):
        raw = text.encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        out, hashes = [], []
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
            h = word_hashes(data, np.array([m.start()]), np.array([m.end()]))
            hashes.append(int(h[0]))
            out.append(int(mix64(h)[0]) & (p.buckets - 1))
        for i, h in enumerate(hashes):
            out.append(sum(1 << (k - 1) for k in (1, 2, 3) if i >= k and hashes[i - k] == h) * 977 % p.buckets)
        chars = []
        for c in text:
            b = c.encode()
            v = b[0] + 1
            for x in b[1:]:
                v = v * 256 + x
            chars.append(v)
        for g in p.grams:
            for i in range(len(chars) - g + 1):
                h = g
                for v in chars[i : i + g]:
                    h = (h * 0x9E3779B97F4A7C15 + v) % 2**64
                h ^= h >> 29
                h = h * 0xBF58476D1CE4E5B9 % 2**64
                out.append((h >> 40) & (p.buckets - 1))
        return out

    rng = np.random.default_rng(p.seed)
    emb = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim))
    out = np.zeros((p.dim, 2))
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias = np.array([np.log(1 - share), np.log(share)])
    bags = [features(t) for t in texts]
    step = 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(texts)):
            rate = p.rate * (1 - step / (p.epochs * len(texts)))
            step += 1
            if not bags[i]:
                continue
            h = sum(emb[f] for f in bags[i]) / len(bags[i])
            z = h @ out + bias
            e = np.exp(z - z.max())
            g = e / e.sum() - np.eye(2)[labels[i]]
            kinds = sorted(set(bags[i]))
            back = out @ g
            for f in kinds:
                emb[f] -= rate * len(kinds) ** 0.5 * bags[i].count(f) / len(bags[i]) * back
            out -= rate * np.outer(h, g) * p.dim
            bias -= 0.05 * rate * g
    scores = []
    for t in new:
        f = features(t)
        z = (sum(emb[x] for x in f) / len(f) if f else np.zeros(p.dim)) @ out + bias
        scores.append(1 / (1 + np.exp(z[0] - z[1])))
    return scores


def test_quality_equals_a_plain_version():
    from facetspark.llm.quality import train_quality

    rng = random.Random(4)
    p = QualityParams(buckets=1 << 10, dim=4, epochs=3)
    texts = [words(rng, rng.randint(0, 25), "abcdé" if i % 2 else "xyzé") for i in range(40)] + ["buy buy now now now"] * 3
    labels = [i % 2 for i in range(40)] + [0, 0, 1]
    new = ["", "abc abc abc", words(rng, 30, "abcdé"), "xx yy zz xx", "é", "buy buy"]
    model = train_quality(texts, labels, p)
    raw = [t.encode() for t in new]
    margins = model.margins(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    assert 1 / (1 + np.exp(-margins)) == pytest.approx(plain_quality(texts, labels, new, p), abs=1e-4)


def test_null_ids_have_defined_results(spark):
    """A null id is a row like others, or links with nothing; no operator drops it."""
    rows = [(None, "me@example.org a b c d e f", "en", "s"), (None, None, None, None), (4, "me@example.org a b c d e f", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.find_pii(docs).collect()) == [(0, 0), (0, 1), (4, 1)]
    assert judge_urls(spark.createDataFrame([(None, "http://a.org/x"), (1, None)], "page_id long, url string"), spark.createDataFrame([("org", "/", "allow")], "host string, path string, verdict string")).count() == 2
    assert mix_sources(docs).count() == 3
    assert pack_documents(docs, PackParams(BPE)).filter("doc_id is null").count() == 2
    assert token_round_trip(docs, TokenFileParams(BPE)).filter("doc_id is null").count() == 2
    assert identify_language(docs).filter("doc_id is null and not held_out").count() == 2
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert quality_scores(docs, labels).filter("doc_id is null and not held_out").count() == 2
    vecs = spark.createDataFrame([(None, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in top_inner_products(vecs).collect()} == {(50, 1)}
    near = near_duplicates(docs, MinHashParams()).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in near) == [(0, True), (0, True), (4, True)]
