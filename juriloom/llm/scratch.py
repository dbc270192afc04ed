"""Tables in the cluster's shared folder, and how finely work is dealt out."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BLOCK_BYTES = 6 << 20
UNKNOWN = 1 << 60  # Spark's size of what it knows nothing about is larger


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where it is unset, as in tests, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="juriloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


class Temporary:
    """Tables written inside a ``with`` block are deleted at its end, but for those that are kept.

    Whatever a frame that lives on still reads has to be kept. Where the block fails, its tables stay.
    """

    _open: list[Temporary] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Temporary:
        self._open.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        self._open.remove(self)
        for path in self.paths if kind is None else []:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def keep(self, *tables: DataFrame) -> None:
        """Leave these tables to the block around this one, or for good."""
        place = self._open.index(self)
        for path in {getattr(table, "written_to", None) for table in tables} & set(self.paths):
            self.paths.remove(path)
            if place:
                self._open[place - 1].paths.append(path)


def written(df: DataFrame, label: str, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    if Temporary._open:
        Temporary._open[-1].paths.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """About how many bytes of text there are: a plain scan's file sizes, without a job; else they are added up."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if plan.collectLeaves().size() == 1 and size < UNKNOWN:
        return 2 * size
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def block_count(docs: DataFrame, bytes_per_block: int = TARGET_BLOCK_BYTES, text: str = "text") -> int:
    """How many blocks of bounded size the rows are dealt into; it follows the input's size alone."""
    return max(2, -(-text_bytes(docs, text) // bytes_per_block))


def in_block(column, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def in_block_column(column, blocks: str):
    """The same for a number of blocks that stands in a column."""
    return F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")


def column_or_null(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
