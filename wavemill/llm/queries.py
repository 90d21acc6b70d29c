"""The operators' registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import bpe, common, exact_dedup, line_dedup, ngram_join, packing, pii, quality, sharding, token_files, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), 4, 85, 100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept, kept_sha256 (of the text that is left; null text as empty)."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/wavemill-{uuid.uuid4().hex}-tokens"
    common.forget_at_exit(spark, path)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_pii": op5_pii,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_token_files": op9_token_files,
    "op10_best_fit_packing": op10_best_fit_packing,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op2_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, n, trim(line, ' \t\r') AS form
            FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n
                  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
        ), d AS (
            SELECT form, min((doc_id, n)) AS first, string_split(form, ' ') AS words FROM l WHERE form <> '' GROUP BY form
        ), v AS (
            SELECT form, first, i, CASE WHEN i = 0 THEN words ELSE list_concat(words[:i - 1], words[i + 1:]) END AS rest
            FROM (SELECT *, unnest(range(len(words) + 1)) AS i FROM d WHERE len(words) >= {line_dedup.MIN_WORDS})
        ), near AS (
            SELECT a.form FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i WHERE a.i > 0 AND b.first < a.first
            UNION
            SELECT a.form FROM v a JOIN v b ON a.rest = b.rest WHERE (a.i = 0) <> (b.i = 0) AND b.first < a.first
        ), kept AS (
            SELECT l.doc_id, l.n, l.form, l.form = '' OR ((l.doc_id, l.n) = d.first AND near.form IS NULL) AS stays
            FROM l LEFT JOIN d ON l.form = d.form LEFT JOIN near ON l.form = near.form
        ), counts AS (
            SELECT doc_id, count(*) FILTER (form <> '') AS n_lines, count(*) FILTER (form <> '' AND stays) AS n_kept, list(n ORDER BY n) FILTER (stays) AS ns
            FROM kept GROUP BY doc_id
        )
        SELECT t.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_kept, 0) AS n_kept,
               sha256(coalesce(array_to_string(list_transform(c.ns, lambda n: string_split(t.text, chr(10))[n + 1]), chr(10)), '')) AS kept_sha256
        FROM documents t LEFT JOIN counts c ON t.doc_id = c.doc_id""",
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
}
