"""Queries of this subpackage and the SQL to which their results are held."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir, table

#: Batches in which documents arrive at the sharded store.
ARRIVALS = 12


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import crc_is, identify

    return identify(table(spark, sf_dir, "documents"), crc_is(2)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    path = f"{shared_dir(spark)}/kinweave-warc-{uuid.uuid4().hex}"
    return archive(table(spark, sf_dir, "pages"), path).drop("target_uri")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    arrival = F.coalesce(F.pmod("doc_id", F.lit(ARRIVALS)), F.lit(0))
    docs = table(spark, sf_dir, "documents").withColumn("arrival", arrival)
    rows = shard(docs, f"{shared_dir(spark)}/kinweave-shards-{uuid.uuid4().hex}", F.col("arrival"))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", "n_chars", "arrival", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_byte_bpe": op6_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op1_language_id": op1_language_id,
    "op10_warc": op10_warc,
    "op3_sharding": op3_sharding,
    "op7_lm_scoring": op7_lm_scoring,
    "op9_licences": op9_licences,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op2_near_duplicates": op2_near_duplicates,
    "op4_decontamination": op4_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS newest FROM p),
        g AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(h, (k * 5 + 1)::INT, 5))::BIGINT) AS fives FROM d)
        SELECT page_id, payload_bytes,
            list_aggregate(flatten(list_transform(fives, lambda v: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)))), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> newest THEN newest END AS refers_to
        FROM g
    """,
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        ip AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS win FROM ip),
        sizes AS (SELECT DISTINCT size FROM iw),
        dp AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
        dw AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS win FROM dp),
        hit AS (SELECT doc_id, s, dw.size, item_id FROM dw JOIN iw USING (win)),
        hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
    """,
    "op3_sharding": """
        SELECT doc_id, lang, source, n_chars, coalesce(doc_id % 12, 0)::BIGINT AS arrival, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
