"""Token counts behind a digest cache.

A cache row is (content_digest, version_digest, n_tokens). Texts are joined to it by the digest of their normalised
content; only distinct texts without a row are encoded, and their rows are appended. The texts that miss are reduced
to one for each digest before they are shuffled, so a text that a third of all rows share is sent once by each task.
Digests that one row in ``HOT_SHARE`` has, at most ``HOT_SHARE`` of them, get their counts by broadcast, so that the
join by digest deals no hot key.

Defined cases: null and empty text count 0 tokens; repeated rows each get a row; an empty table gives an empty result;
further columns of any name are ignored; cache rows written twice, as by two runs at once, count once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_path, written
from .tokenizers import folds_white_space, version_digest, vocabulary_path, word_ids
from .words import slices

CACHE_SCHEMA = "content_digest binary, version_digest string, n_tokens long"
HOT_SHARE, HOT_LEAST = 1000, 100
WHITE_SPACE = ("\t", "\n", "\x0b", "\f", "\r")


def normalised(text, path: str):
    """The text up to differences that this tokenizer can't see."""
    text = F.coalesce(text, F.lit(""))
    if folds_white_space(path):
        for c in WHITE_SPACE:
            text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _encode(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            bounds = [ids_of(texts)[1] for texts in slices(batch.column("text"))]
            counts = np.concatenate([np.diff(b) for b in bounds]) if bounds else []
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([version] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "version_digest", "n_tokens"])

    return encode


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; none if there is no cache yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("version_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str | None = None, tokenizer: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. ``cache_path`` lasts as long as its owner keeps it; without one, a new cache is made in the shared folder."""
    spark = docs.sparkSession
    path = tokenizer or vocabulary_path()
    version = version_digest(path)
    cache_path = cache_path or fresh_path(spark, "token-counts")
    content = normalised(F.col(text), path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), content.alias("text"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes")).withColumn("content_digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    distinct = rows.groupBy("content_digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache_path, version), "content_digest", "left_anti")
    misses.select("content_digest", "text").mapInArrow(_encode(path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    keyed = written(rows.select("doc_id", "n_bytes", "content_digest"), "digests")
    counts = read_cache(spark, cache_path, version)
    least = max(HOT_LEAST, -(-keyed.count() // HOT_SHARE))
    hot = keyed.groupBy("content_digest").agg(F.count("*").alias("copies")).where(F.col("copies") >= least).select("content_digest")
    hot = counts.join(F.broadcast(hot), "content_digest", "left_semi").select(F.col("content_digest").alias("_hot"), F.col("n_tokens").alias("n_hot"))
    near = keyed.join(F.broadcast(hot), F.col("content_digest") == F.col("_hot"), "left")
    # rows that have their count stay where they are: no digest equals the hash of an id
    near = near.withColumn("_key", F.when(F.col("n_hot").isNull(), F.col("content_digest")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id")))))
    found = near.join(counts.select(F.col("content_digest").alias("_key"), F.col("n_tokens").alias("n_cold")).hint("merge"), "_key", "left")
    return found.select("doc_id", "n_bytes", F.coalesce("n_hot", "n_cold").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
