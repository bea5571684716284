"""Tables written whole: the commit protocol shows a reader the old files or the new ones."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), sort_by: list[str] = ()) -> DataFrame:
    """Overwrites the table at ``path`` and returns it as read back. Rows are shuffled to the partition columns only where
    ``sort_by`` asks for order inside the files."""
    if sort_by:
        df = df.repartitionByRange(*partition_by, *sort_by).sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return read_table(df.sparkSession, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_listing(lines: DataFrame, path: str, keys: list[str], column: str = "line") -> None:
    """Numbered listing lines as sorted text files."""
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(column).write.mode("overwrite").text(path)
