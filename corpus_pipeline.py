"""From raw documents to token ids: language ID, near-duplicate removal, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next; all but the last return the columns of docs. Rows are judged, and removed, by doc_id and text together: rows of
one id with different texts, and rows without an id, go or stay each by its own text; rows that repeat id and text are one
document and stay together.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.base import shared_dir, table
from kinweave.llm.bpe import encode_decode
from kinweave.llm.decontam import decontaminate
from kinweave.llm.langid import crc_is, identify
from kinweave.llm.neardup import near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that no language claims, null and letterless ones; fill a missing lang with the prediction."""
    own = [f"own_{k}" for k in range(len(docs.columns))]
    copies = docs.select("doc_id", "lang", "text", *[docs[c].alias(o) for c, o in zip(docs.columns, own, strict=True)])
    found = identify(copies, crc_is(2), keep=tuple(own)).where("lang_pred <> 'und'")
    back = {c: F.col(o) for c, o in zip(docs.columns, own, strict=True)}
    back["lang"] = F.coalesce(back["lang"], F.col("lang_pred"))
    return found.select(*[x.alias(c) for c, x in back.items()])


#: Removed rows up to which they are broadcast rather than texts shuffled: some 10 MB.
BROADCAST_GONE = 300_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (doc_id, text_hash)."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct().checkpoint()
    few = gone.limit(BROADCAST_GONE + 1).count() <= BROADCAST_GONE
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_hash")), "left_anti")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group linked by 80 % of five-word shingles the document with the smallest id; of several rows with
    that id, or of a group without ids, one text."""
    shared_dir(spark)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("text_hash"))
    gone = near_duplicates(docs.select(key.alias("key"), "text"), n=5, percent=80, id_col="key").where("NOT kept")
    return without(docs, gone.select("key.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which ten consecutive words of a benchmark item occur, or a whole shorter one."""
    shared_dir(spark)
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark"), with_hash=True).where("contaminated"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: lang, source, doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"), with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicate),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_bpe),
]

#: The stages learn, hash and merge in ways that SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/kinweave-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
