"""The thin queries op1 ... op13 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word_bpe() -> str:
    """The public tokenizer file that ops 5 and 6 name; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flatgraph import embedding_duplicates

    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


#: host, path, verdict
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import PackParams, pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), PackParams(_word_bpe()))


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import TokenFileParams, token_round_trip

    return token_round_trip(_table(spark, sf_dir, "documents"), TokenFileParams(_word_bpe()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hdlang import identify_language

    return identify_language(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdtree import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import MinHashParams, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), MinHashParams(width=3, percent=85))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .logbilinear import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_embedding_dedup, op2_pii_crf, op3_url_rules, op4_source_mix, op5_pattern_packing,
    op6_token_codes, op7_language_id, op8_quality, op9_exact_topk, op10_minhash_dedup,
    op11_lm_scoring, op12_spelling_variants, op13_source_divergence,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


_OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS s, vec_id AS t FROM embeddings
  UNION
  SELECT reach.s, link.b FROM reach JOIN link ON reach.t = link.a
), comp AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp ON comp.s = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

_OP3_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(h, w, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fit AS (
  SELECT q.page_id, q.host, q.path, r.h || r.w AS rule, r.verdict,
    row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.h || r.w) DESC) AS k
  FROM q LEFT JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.w)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""

_OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS s, doc_id AS t FROM documents
  UNION
  SELECT reach.s, e.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) e ON reach.t = e.a
), comp AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d JOIN comp ON comp.s = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, o: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents
), bytes AS (
  SELECT w, flatten(list_transform(string_split(head || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b
  FROM run WHERE length(w) >= 5
), hashed AS (
  SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc
), word AS (
  SELECT w, count(*) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS w FROM hashed
  ) WHERE length(w) >= 5 GROUP BY w HAVING count(*) >= 3
), variant AS (
  SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS v FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM word)
), near AS (
  SELECT DISTINCT a.w, a.n, b.w AS o, b.n AS m FROM variant a JOIN variant b ON a.v = b.v AND a.i = b.i AND a.w <> b.w
  UNION
  SELECT a.w, a.n, b.w, b.n FROM variant a JOIN word b ON a.v = b.w
  UNION
  SELECT b.w, b.n, a.w, a.n FROM variant a JOIN word b ON a.v = b.w
), best AS (SELECT w, n, count(*) AS n_near, arg_min(o, (-m, o)) AS o, max(m) AS m FROM near GROUP BY w, n),
form AS (
  SELECT word.w, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 2 * word.n THEN best.o END AS form, CASE WHEN best.m >= 2 * word.n THEN best.m END AS form_n
  FROM word LEFT JOIN best ON best.w = word.w
), walk AS (
  SELECT w, w AS here, 0 AS k FROM form
  UNION ALL
  SELECT walk.w, form.form, k + 1 FROM walk JOIN form ON form.w = walk.here WHERE form.form IS NOT NULL
), root AS (SELECT w, arg_max(here, k) AS root FROM walk GROUP BY w)
SELECT form.w AS word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM form JOIN root ON root.w = form.w
"""

_OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(c) AS total FROM n GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 1)) // (coalesce(own.total, 0) + v.v) AS p,
    1 + (1000000000::HUGEINT * (kept.c + 1)) // (v.n + v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": _OP1_SQL, "op3_url_rules": _OP3_SQL, "op9_exact_topk": _OP9_SQL, "op10_minhash_dedup": _OP10_SQL, "op12_spelling_variants": _OP12_SQL, "op13_source_divergence": _OP13_SQL}
