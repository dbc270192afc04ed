"""Reading and writing: text, DOCX, JSON lines, snapshots, key overwrites, logs."""
from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats in order of preference, and the XML names of a DOCX body.
PREFERENCE = ["docx", "doc", "pdf", "txt"]
WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LEAST_BYTES = 100
LEAST_TEXT = 50


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all .txt files below a folder; bytes that are no UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return raw.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "").alias("text"))


def docx_text(raw: bytes) -> str:
    """Paragraphs, then table rows with ' | ' between cells; a cell that repeats the one before it is dropped."""
    body = ElementTree.fromstring(zipfile.ZipFile(BytesIO(raw)).read("word/document.xml")).find(f"{WORD_XML}body")
    words = lambda x: "".join(t.text or "" for t in x.iter(f"{WORD_XML}t")).strip()
    out = [words(p) for p in body.findall(f"{WORD_XML}p")]
    for row in body.iter(f"{WORD_XML}tr"):
        cells = [words(c) for c in row.findall(f"{WORD_XML}tc")]
        out.append(" | ".join(c for i, c in enumerate(cells) if c and (i == 0 or c != cells[i - 1])))
    return "\n".join(x for x in out if x)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): a file that can't be read has its error and no text, and stops nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for raw in batch.column("content").to_pylist():
                try:
                    texts.append(docx_text(raw))
                    errors.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    texts.append(None)
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return raw.select("path", "content").mapInArrow(run, "path string, text string, error string")


def needs_ocr(text: str = "text", least: int = LEAST_TEXT):
    """True where so little text came out of a file that it is a scan; recognising it is a step outside Spark."""
    return F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < least


def preferred(listing: DataFrame, path: str = "path") -> DataFrame:
    """One file for each stem, by format, then name."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    keyed = listing.withColumn("stem", F.lower(F.regexp_replace(name, r"\.[^.]+$", ""))).withColumn("kind", kind)
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("kind")), F.lit(0)), F.lit(99))
    return keyed.withColumn("_k", F.row_number().over(Window.partitionBy("stem").orderBy(order, F.lower(name)))).where("_k = 1").drop("_k")


def pending(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose stem has no output of LEAST_BYTES or more yet. done: (stem, length)."""
    return listing.join(done.where(F.col("length") >= LEAST_BYTES).select("stem").distinct(), "stem", "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; maxima are combined before the shuffle, so a key of any size costs one row for each task."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    packed = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return packed.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, by document; everything else is derived on load."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def sample(docs: DataFrame, n: int = 20, seed: int = 1) -> DataFrame:
    return docs.orderBy(F.rand(seed)).limit(n)
