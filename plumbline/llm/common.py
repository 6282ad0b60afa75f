"""Shared helpers: table access, the shared workspace, Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch for Python workers.  Bounds a worker's memory when rows hold whole texts.
ARROW_ROWS = 250
#: Narrow rows in a file of a table whose number of rows is known.
FILE_ROWS = 100_000
#: A setting of Spark: a query's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


class Workspace:
    """Written tables in the folder of ``spark.checkpoint.dir``, which every executor shares.

    A written table cuts lineage the way ``checkpoint()`` does, but stays columnar and
    survives the loss of any executor.  Where the setting is absent a local session (tests, a
    laptop) uses a folder under its warehouse; on a cluster that is an error, for executors
    would write where no one reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``df`` as it is read again; narrow tables of about ``rows`` rows come in one file for each ``FILE_ROWS``."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        with self._shuffles_end():
            (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
        self._paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def _shuffles_end(self):
        """Deletes shuffle files with the write that made them; Spark else waits for the driver's garbage collection."""
        return self._set(SHUFFLE_CLEANUP, "true")

    def dealt(self, rows: int, each: int):
        """Shuffles inside have a partition for every ``each`` of about ``rows`` rows, and no more than the session's.

        Every task opens and reads a piece for each partition, which costs more than the rows of a small table.
        """
        return self._set(SHUFFLE_PARTITIONS, str(self.parts(rows, each)))

    def sorted_shuffles(self):
        """Shuffles inside sort their rows by partition instead of writing a file for each, which Spark does up to a number of partitions.

        Shuffles of few partitions stay as they are.
        """
        n, files = int(self.spark.conf.get(SHUFFLE_PARTITIONS)), int(self.spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
        return self._set(SHUFFLE_PARTITIONS, str(files + 1 if files / 2 < n <= files else n))

    def parts(self, rows: int, each: int) -> int:
        return min(int(self.spark.conf.get(SHUFFLE_PARTITIONS)), 1 + rows // each)

    @contextmanager
    def _set(self, key: str, value: str) -> Iterator[None]:
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, value)
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, before)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that was written here."""
        self._delete(df._workspace_path)

    def keep_only(self, *kept: DataFrame) -> None:
        """Deletes all tables but those that a result still reads."""
        for path in set(self._paths) - {df._workspace_path for df in kept}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._paths.remove(path)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by :data:`ARROW_ROWS`."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def each_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield b


def text_column(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the text column cast to string (an all-null column has no type)."""
    return df.withColumn(column, F.col(column).cast("string"))
