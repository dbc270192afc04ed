"""The training-data pipeline: quality classifier, line dedup, near-dedup, decontamination, packing.

Each stage takes and returns the documents that are left, with the columns that they came with; the last returns the
pieces of the packed sequences. ``run`` writes each stage's documents to the shared folder before the next begins.

Defined cases: those of the operators. Rows that share an id are one document for the near-dedup and stay or go
together; a document that loses all its lines stays with an empty text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juriloom.llm.decontaminate import drop_leaks
from juriloom.llm.line_dedup import remove_repeated_lines
from juriloom.llm.minhash_dedup import near_duplicates
from juriloom.llm.packing import pack
from juriloom.llm.quality_cnn import fit_on, keep_good
from juriloom.llm.scratch import Temporary, written
from juriloom.shipping import ship

#: Runs of one or two lines are removed from so many words on, and single lines of any length that stand in so many places.
LINE_WORDS, LINE_PLACES = 5, 100


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_good(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    left = remove_repeated_lines(docs, n_lines="_n_lines", n_removed="_n_removed", words=LINE_WORDS, often=LINE_PLACES)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = written(near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct(), "kept")
    return docs.join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
#: SQL can't express the classifier; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Temporary(spark) as temporary:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        temporary.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
