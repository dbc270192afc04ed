"""Streams: documents that arrive as files become nodes, and keyed rows overwrite a table batch by batch."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from juriloom.operators import parser
from juriloom.sources.files import latest


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of each text file that arrives."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def ingest(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse each document of a stream and append its nodes to a Parquet table, once."""
    return parser.parsed(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_stream(rows: DataFrame, keys: list[str], order: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key. A batch writes a new version folder, named by its number, so a batch that is run again leaves the same table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, order)
        if number:
            old = spark.read.schema(new.schema).parquet(f"{folder}/v{number - 1}")
            new = latest(old.unionByName(new), keys, order)
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, with late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
