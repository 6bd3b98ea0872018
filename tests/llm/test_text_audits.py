"""Language-model scores, spelling variants and source divergence against plain versions, with odd input."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.llm import divergence, logbilinear, variants
from facetspark.llm.divergence import DivergenceParams, source_divergence
from facetspark.llm.logbilinear import LmParams, fit_language_model, lm_scores, score_texts
from facetspark.llm.variants import VariantParams, spelling_variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
END = "\0end"


def low(text):
    return (text or "").translate(LOWER)


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source): odd texts, repeated rows, null ids, one source with most rows."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(2, 9))) for _ in range(120)]

    def variant(w):
        k, c = rng.randrange(len(w)), rng.choice("abcdeé")
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w, w, w])

    def text(n):
        return " ".join(variant(rng.choice(stems)) + rng.choice(["", "", ",", "."]) for _ in range(n))

    texts = [None, "", "  \t ", "one", "ÉCOLE École école", "x×y÷z", "a" * 5000, "z" * 70 + " " + "z" * 69, "\x00\x1f中文 中文字 中文", "aaaaaaaa aaaaaaa aaaaaaaa aaaaaaa aaaaaaaa aaaaaaa"]
    texts += [text(rng.randint(1, 150)) for _ in range(70)] + [text(4000), "kettel " * 4 + "ketteln " * 9 + "kettelnd " * 30]
    out = [(i, t, ["en", "de", None, "en"][i % 4], None if i % 13 == 0 else ("hot" if i % 3 else f"s{i % 5}")) for i, t in enumerate(texts)]
    out += [out[20], out[20], (None, texts[12], "en", "hot"), (None, None, None, None), (7777, "", "xx", "bare"), (7778, "only words here", "xx", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    return df.withColumns({c: F.lit(1) for c in ("n", "row", "word", "term", "h", "score", "key", "held_out", "rank", "value", "item", "p")})


# --- spelling variants -------------------------------------------------------------------------


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    links = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(links[w]), n[form[w]] if form[w] else -1) for w in n)


def test_variants_equal_a_plain_version(docs, rows):
    got = spelling_variants(docs).collect()
    want = plain_variants(rows)
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == want
    assert sum(w[4] for w in want) > 100 and any(w[1] and w[2] != w[1] for w in want)  # links, and a chain


@pytest.mark.parametrize("run", [1, 3, 50])
def test_variants_do_not_depend_on_the_length_of_a_run(docs, rows, run):
    got = spelling_variants(docs, VariantParams(run=run, held_rows=10))
    assert sorted((r.word, r.n_near) for r in got.collect()) == [(w[0], w[4]) for w in plain_variants(rows)]


def test_rarest_bigrams_find_every_near_pair():
    """Words of few letters, with repeated bigrams: the hardest case of the prefix filter."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(400)})
    import pyarrow as pa

    b, offs = variants._letters(pa.array(words))
    code, _, _ = variants._bigrams(b, offs)
    seen = np.bincount(code, minlength=1 << 16)
    rank = np.zeros(1 << 16, dtype=np.int64)
    rank[np.lexsort((np.arange(1 << 16), seen))] = np.arange(1 << 16)
    who, key, place, longer = variants.meeting_keys(b, offs, rank, VariantParams())
    at = defaultdict(list)
    for w, k, p, more in zip(who, key, place, longer, strict=True):
        at[k].append((w, p, more))
    met = set()
    for group in at.values():
        for a, p, more in group:
            if not more:
                for c, q, longer_one in group:
                    if (p <= q <= p + 1) if longer_one else (p == q and a < c):
                        met.add(frozenset((a, c)))
    want = {frozenset((i, j)) for i in range(len(words)) for j in range(i) if near(words[i], words[j])}
    assert want and want <= met


def test_variants_broadcast_no_table(spark):
    words = spark.createDataFrame([("houses", 5), ("horses", 9)], "word string, n long")
    for df in (variants.near_words(words, VariantParams()), spelling_variants(spark.createDataFrame([(1, "houses horses")], "doc_id long, text string"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_checksums_carry_on():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 200)
    ends = starts + rng.integers(0, 100, 200)
    before = np.array([zlib.crc32(str(i).encode()) for i in range(200)], dtype=np.uint32)
    got = variants.checksums(data, starts, ends, before)
    assert [int(x) for x in got] == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before, strict=True)]


def test_variants_of_no_rows(docs):
    out = spelling_variants(docs.filter("doc_id < 0"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


# --- source divergence -------------------------------------------------------------------------


def plain_divergence(rows, scale=10**9, least=3, ranks=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, df, groups = defaultdict(Counter), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall(low(text))
        n[lang, source].update(found)
        df.update((lang, t) for t in set(found))
    kept = defaultdict(list)
    for (lang, t), k in df.items():
        if k >= least:
            kept[lang].append(t)

    def shares(counts, terms):
        room = sum(counts[t] for t in terms) + len(terms)
        return {t: 1 + scale * (counts[t] + 1) // room for t in terms}

    out = []
    for lang, source in groups:
        terms = kept[lang]
        p = shares(n[lang, source], terms)
        every = Counter()
        for g in groups:
            if g[0] == lang:
                every.update({t: n[g][t] for t in terms})
        pairs = []
        for other in sorted(s for g, s in groups if g == lang and s != source):
            q = shares(n[lang, other], terms)
            pairs.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in terms)))
        q = shares(every, terms)
        marks = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in terms if n[lang, source][t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", marks, ranks)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("params", [DivergenceParams(), DivergenceParams(broadcast_groups=0, held_rows=20), DivergenceParams(term_ranks=3)])
def test_divergence_equals_a_plain_version(docs, rows, params):
    got = source_divergence(docs, params).collect()
    want = plain_divergence(rows, ranks=params.term_ranks)
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got) == want
    assert sum(r[2] == "pair" and r[4] > 0 for r in want) > 20 and ("xx", "bare") in {r[:2] for r in want}


def test_meetings_come_in_bounded_runs(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.array([1, 0, 7, 30, 2])
    group = np.concatenate([rng.permutation(40)[:k] for k in sizes]).astype(np.int64)
    p, zero = rng.integers(1, 1000, len(group)), rng.integers(1, 50, len(group))
    whole = Counter()
    for a, b, n, *_ in divergence._meet(group, p, zero, sizes):
        whole.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
    chunks = divergence._chunks
    monkeypatch.setattr(divergence, "_chunks", lambda more, most: chunks(more, 10))
    parts = Counter()
    for a, b, n, *_ in divergence._meet(group, p, zero, sizes):
        assert n.sum() <= 30 + 10
        parts.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
    assert whole == parts and sum(whole.values()) == sum(k * (k - 1) // 2 for k in sizes)


def test_divergence_of_no_rows(docs):
    out = source_divergence(docs.filter("doc_id < 0"))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


# --- language-model scores ---------------------------------------------------------------------


SMALL = LmParams(words=20, shared=16, dim=8, head=40, batch=256, noise=16)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def plain_counts(rows):
    c = Counter()
    for i, text, *_ in rows:
        if not held(i):
            c.update([*WORD.findall(low(text)), END])
    return c


@pytest.fixture(scope="module")
def lm(docs):
    return fit_language_model(docs, SMALL)


def test_base_scores_equal_a_plain_version(docs, rows, lm):
    c = plain_counts(rows)
    total, distinct = sum(c.values()), len(c)
    want = []
    for i, text, *_ in rows:
        tokens = [*WORD.findall(low(text)), END]
        base = sum(math.log10((c[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        want.append((str(i), held(i), len(tokens), sum(c[t] > 0 for t in tokens), total, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score_texts(docs, lm).collect()]
    assert sorted(got) == sorted(want)


def shared_class(token, params):
    b = token.encode()
    look = np.uint64(int.from_bytes(bytes([b[0], b[min(1, len(b) - 1)], b[-1], b[max(0, len(b) - 2)]]), "big"))
    return int(logbilinear.mix64(np.array([look + np.uint64(1)]))[0] % np.uint64(params.shared))


def plain_scores(rows, lm):
    """Each token's probability from the model's vectors, one context at a time."""
    c, p, m = plain_counts(rows), lm.params, lm.model
    top = {int(h): int(k) for h, k in zip(lm.classes.head, lm.classes.head_class, strict=True)}

    def hashed(token):
        data = np.frombuffer(token.encode(), dtype=np.uint8)
        return int(logbilinear.word_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])

    cls = {t: 0 if t == END else (k if (k := top.get(hashed(t), -1)) >= 0 else 1 + lm.classes.words + shared_class(t, p)) for t in {x for _, s, *_ in rows for x in WORD.findall(low(s))} | {END}}
    mass = Counter()
    for t, k in cls.items():
        mass[k] += (c[t] + 0.5) if c[t] else 0
    out = []
    for i, text, *_ in rows:
        tokens = [*WORD.findall(low(text)), END]
        score, before = 0.0, [0, 0]
        for t in tokens:
            logits = (m.r[before[0]] @ m.maps[0] + m.r[before[1]] @ m.maps[1]) @ m.s.T + m.b
            score += logits[cls[t]] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
            if cls[t] > lm.classes.words:
                score += math.log((c[t] + 0.5) / (mass[cls[t]] + 0.5))
            before = [cls[t], before[0]]
        out.append((str(i), round(score / math.log(10), 2)))
    return out


def test_scores_equal_a_plain_version(docs, rows, lm):
    got = {(str(r.doc_id), r.n_tokens): r.score for r in score_texts(docs, lm).collect()}
    want = plain_scores(rows, lm)
    assert sorted(v for v in got.values()) == pytest.approx(sorted({k: v for (k, v), (_, t, *_) in zip(want, rows, strict=True) for k in [(k, t)]}.values()), rel=1e-4, abs=0.02)


def test_probabilities_are_normalised(lm):
    one, two, norm = lm.model.log_tables()
    for a, b in ((0, 0), (3, 7), (25, 1)):
        assert np.exp(one[a] + two[b] - norm[a, b]).sum() == pytest.approx(1.0)
    # Within a shared class the known tokens and one unknown token share all of it.
    own = lm.counts.toPandas()
    head = dict(zip(lm.classes.head.tolist(), lm.classes.head_class.tolist(), strict=True))
    rest = own[[head.get(h, -1) < 0 and h != int(logbilinear.END) for h in own["h"]]]
    for k, part in rest.groupby("shared"):
        assert (part["n"] + 0.5).sum() + 0.5 == pytest.approx(lm.classes.mass[1 + lm.classes.words + k])


def test_noise_contrast_raises_held_out_scores(spark):
    """Texts in which the next word follows from the one before: the model must see more than counts."""
    rng = random.Random(8)
    names = [f"w{i}" for i in range(30)]

    def text():
        k, out = rng.randrange(30), []
        for _ in range(200):
            k = (k * 7 + rng.choice([1, 2])) % 30
            out.append(names[k])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(150)], "doc_id long, text string").repartition(2)
    params = LmParams(words=40, shared=4, dim=16, batch=512, noise=30, rate=0.1)
    got = [r for r in lm_scores(df, params).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    assert (sum(r.score for r in got) - sum(r.base_score for r in got)) / tokens > 0.15
    again = {r.doc_id: r.score for r in lm_scores(df, params).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_scores_do_not_depend_on_neighbours(docs, lm):
    whole = {(r.doc_id, r.n_tokens): (r.base_score, r.score) for r in score_texts(docs, lm).collect()}
    for k in (0, 1):
        for r in score_texts(docs.filter(F.coalesce("doc_id", F.lit(0)) % 2 == k).coalesce(1).orderBy(F.desc("doc_id")), lm).collect():
            assert whole[r.doc_id, r.n_tokens] == pytest.approx((r.base_score, r.score), rel=1e-12)


def test_scores_without_rows_or_training(spark, docs):
    out = lm_scores(docs.filter("doc_id < 0"), SMALL)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and out.count() == 0
    only = next(i for i in range(100) if held(i))
    r = lm_scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string"), SMALL).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == 0 and r.score < 0
