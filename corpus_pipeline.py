"""From raw documents to packed training sequences: five stages, each a table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.llm.minhash import MinHashParams, near_duplicates
from facetspark.llm.mixing import mixed_documents
from facetspark.llm.packing import PackParams, pack_documents
from facetspark.llm.pii import redact_pii
from facetspark.llm.quality import QualityParams, fit_quality, score_quality
from facetspark.llm.scratch import free_name, materialize
from facetspark.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: those of a score of at least the threshold.

    A null or empty text has the score of the bias alone; long texts are scored whole; rows
    that repeat score alike and stay or go together; a null doc_id is scored like any other
    row.  Columns keep their names and values, whatever they are called.  An empty table
    gives an empty result; without labels every score is 0.5 and all documents stay.
    """
    ship_package(spark)
    params = QualityParams()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = free_name(docs.columns, "quality_score")
    scored = score_quality(docs, fit_quality(docs, labels, params), score)
    return scored.filter(F.col(score) >= params.threshold).drop(score)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by doc_id) of each group of near duplicates: five words, a similarity of 0.8.

    Null, empty and word-free texts are near nothing and stay, as do rows with a null
    doc_id; rows that share a doc_id are one document and stay or go together.  Whole texts
    count, however long.  Other columns are not looked at.  An empty table gives an empty
    result.
    """
    ship_package(spark)
    gone = near_duplicates(docs, MinHashParams()).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars counted anew where a text changed.

    A null text stays null and an empty one empty; long texts are read whole; rows that
    repeat are changed alike; all other columns, null ids too, stay as they are.  An empty
    table gives an empty result.
    """
    ship_package(spark)
    return redact_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: each row 0, 1, 2 or more times.

    A null or empty text has no words and is taken as often as the whole part of its
    source's ratio says; a null source is a source of its own, last in order; a null
    doc_id is a document like others.  Rows that repeat share their copies.  Columns keep
    their names and values, whatever they are called.  An empty table gives an empty result.
    """
    ship_package(spark)
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their places in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a longer document than a sequence is cut
    and nothing of it is lost.  Each row is packed, also where rows repeat; a null doc_id
    stays null.  Other columns are not read.  An empty table gives an empty result.
    """
    import public_tokenizers

    ship_package(spark)
    return pack_documents(docs, PackParams(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("dedup", dedup), ("pii", pii), ("mix", mix), ("pack", pack)]

#: Trained scores and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
