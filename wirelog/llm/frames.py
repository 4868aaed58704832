"""Small helpers shared by the operators: column names, scratch tables, words."""

from __future__ import annotations

import gc
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelog.session import scratch_path

#: A word is a run of characters other than these six.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def named(name: str, of: str | None = None) -> Column:
    """A column by its exact name, dots and back quotes included."""
    quoted = f"`{name.replace('`', '``')}`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def packed(df: DataFrame, **columns: Column | str) -> DataFrame:
    """The row as one struct ``_row`` beside the columns asked for, so that no name can clash."""
    chosen = [(named(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return df.select(F.struct(*[named(c).alias(c) for c in df.columns]).alias("_row"), *chosen)


def unpacked(df: DataFrame, names: Sequence[str], added: Sequence[str] = ()) -> DataFrame:
    """Undo ``packed``: the named columns of ``_row``, then ``added``, which win over namesakes."""
    taken = {a.lower() for a in added}
    kept = [named(c, "_row").alias(c) for c in names if c.lower() not in taken]
    return df.select(*kept, *[named(a) for a in added])


def settled(df: DataFrame) -> DataFrame:
    """``df``, its columns computed once.

    The optimizer copies a column's expression into filters that read it, and into the
    lambdas of whoever reads it next; it doesn't copy anything through a generator.
    """
    row = F.explode(F.array(F.struct(*[named(c).alias(c) for c in df.columns]))).alias("_settled")
    return df.select(row).select(*[named(c, "_settled").alias(c) for c in df.columns])


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Scratch:
    """Tables below the folder that all executors share, each written once and read many times."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = scratch_path(spark, name)
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.folder}/{self._count}-{name}"

    def store(self, df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
        """``df``, written and read again; few ``rows_per_file`` where a row is megabytes large."""
        path = self.path(name)
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored._scratch_path = path
        return stored

    def drop(self, stored: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(stored._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Let Spark see which shuffles are over, so that it deletes their files now and not at the end.

        The first collection frees what Python let go, the second what only that held.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)
