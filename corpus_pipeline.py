"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

quality        documents scored under 0.7 by the nearest-neighbour classifier go
line_dedup     later copies of repeated runs of lines go, and documents of which nothing else is left
near_dedup     one document, of the smallest id, stays of each group linked by 5-word shingles at 0.8 or more
decontaminate  documents that hold a window of a benchmark item go
bpe            token ids of what is left, and the hash of what they decode to

Every stage takes (spark, docs, sf_dir), with docs the rows its predecessor kept, and works on all of them. Null texts
are empty texts throughout; rows of null doc_id are kept by the deduplicating stages; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.llm.bpe import bpe_encode
from margrave.llm.common import free_name, materialize, ship
from margrave.llm.decontaminate import decontaminate
from margrave.llm.line_dedup import line_dedup
from margrave.llm.ngram_join import ngram_join
from margrave.llm.quality_knn import fit_quality, score_quality

GOOD, MIN_LINES, SHINGLE, PERCENT, WINDOW = 0.7, 2, 5, 80, 8
#: Ids of documents to drop are broadcast up to this number (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    gone = materialize(gone.select(on).distinct(), "dropped")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, on, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    voters = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name("score", docs.columns)
    return score_quality(docs, voters, out=score).where(F.col(score) >= GOOD).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    own = {c: free_name(f"{c}_own", docs.columns) for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup(docs.withColumnsRenamed(own), MIN_LINES).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({new: old for old, new in own.items()}).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _without(docs, ngram_join(docs, SHINGLE, PERCENT).where("doc_id <> component_id"), "doc_id").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    key = free_name("key", docs.columns)
    keyed = docs.withColumn(key, F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")))
    hit = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW, id_col=key).where("n_items > 0")
    return _without(keyed, hit.withColumnRenamed("doc_id", key), key).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", drop_contaminated), ("bpe", encode)]

#: The classifier's votes can't be said in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
