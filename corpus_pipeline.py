"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept and returns the columns of documents, but for the last, which
returns packed pieces. n_chars follows the text where a stage changes it.

All stages take null and empty texts (no words, lines, sets or personal data; one piece of the end id), null and repeated
doc_ids, empty tables, texts of any length, and further columns of any names, which they hand on as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import common, line_dedup, ngram_join, packing, pii, quality

#: Tables in the shared folder that the stage before has written; its result is on disk once the next stage starts.
_spent: list = []


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    own = common.guarded(docs, "text", "n_chars")
    return own.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).toDF(*docs.columns)


def _stage(fn):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if run is not STAGES[0][1]:  # there another run begins, and the last one's result may yet be read: its tables go at exit
            common.delete(_spent, docs)
        _spent.clear()
        before = common.tables()
        out = fn(spark, docs, sf_dir)
        _spent.extend(t for t in common.tables() if t not in before)
        return out

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


@_stage
def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier, trained on labels, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_lines(spark, docs, sf_dir):
    """Documents without the lines that repeat an earlier one; those that lose all their lines go."""
    out = line_dedup.dedup_lines(common.guarded(docs, "doc_id", "text")).filter("n_kept > 0 or n_lines = 0")
    return _recounted(out.drop("n_lines", "n_kept").toDF(*docs.columns))


@_stage
def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return ngram_join.one_each(docs, 5, 80, 100)


@_stage
def redact(spark, docs, sf_dir):
    """Documents with personal data replaced by its kind."""
    return _recounted(pii.redact(docs))


@_stage
def pack(spark, docs, sf_dir):
    """Token pieces of all documents, packed into sequences of 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: SQL has no trained models; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.keep(docs, f"stage{k + 1}")
    return docs
