"""What the operators share: the words of a text, keys of rows, tables in the shared folder."""
from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SPACE = r"[ \t-\r]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(c: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """The number of words between blanks (space, tab to carriage return)."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text in joins and groups."""
    return F.unhex(F.md5(text))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names; every task and the driver see it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/annolytics-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read from there: lineage ends here, lost executors cost a read."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder this package made, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A map over batches that gives its memory back when it ends: workers live on and serve the next stage."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return mapped
