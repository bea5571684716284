"""Files read by ranges of bytes: the lines that grew since an offset, and fingerprints of files of any size."""
from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20      # the bytes one range covers
PIECE_BYTES = 4 << 20       # the bytes of lines that are handed over at once


def open_file(path: str) -> io.BufferedReader:
    """A file that every executor can reach, by its path or URI."""
    local = re.sub(r"^file:/+", "/", path)
    if local.startswith("/"):
        return open(local, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of files; their contents are not read. The listing leaves empty files out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def byte_ranges(files: DataFrame, offsets: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Ranges (``path, start, stop``) that cover the bytes of files (``path, length``) behind their ``offset``, each of at most ``block``
    bytes. A file without an offset, or one that is shorter than it and so was written anew, is covered from its start."""
    known = offsets.groupBy("path").agg(F.max("offset").alias("offset"))
    since = F.when(F.col("offset").between(0, F.col("length")), F.col("offset")).otherwise(F.lit(0)).cast("long")
    rows = files.join(known, "path", "left").withColumn("since", since).filter(F.col("since") < F.col("length"))
    starts = F.sequence("since", F.col("length") - 1, F.lit(block).cast("long"))
    return rows.select("path", "length", F.explode(starts).alias("start")).select(
        "path", "start", F.least(F.col("start") + block, F.col("length")).alias("stop"))


def lines_between(stream: io.BufferedReader, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Where they begin and the bytes of the lines that begin from ``start`` to before ``stop``. A line that has no end yet is left for later."""
    at = start
    if start:
        stream.seek(start - 1)      # a line begins at the start only if one ends before it
        at += len(stream.readline(stop - start + 1)) - 1
    while at < stop:
        line = stream.readline()
        if not line.endswith(b"\n"):
            return
        yield at, line
        at += len(line)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def made(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "at", "next", "raw"])

    for batch in batches:
        for path, start, stop in batch[["path", "start", "stop"]].itertuples(index=False):
            rows, size = [], 0
            with open_file(path) as stream:
                for at, line in lines_between(stream, start, stop):
                    rows.append((path, at, at + len(line), line.rstrip(b"\r\n").decode("utf-8", "replace")))
                    size += len(line)
                    if size >= PIECE_BYTES:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)


def new_file_lines(spark: SparkSession, path: str, offsets: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """The finished lines of files that begin at or behind their offset (``path, offset``): ``path, at, next, raw`` with the bytes where a line
    begins and where the next one does. Only these bytes are read, a large file by many tasks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))     # a number, or the small table of ranges would become one task
    ranges = byte_ranges(list_files(spark, path), offsets, block).repartition(n, "path", "start")
    return ranges.mapInPandas(_read, "path string, at long, next long, raw string")


def next_offsets(lines: DataFrame) -> DataFrame:
    """Where reading goes on: per file the end of its last finished line."""
    return lines.groupBy("path").agg(F.max("next").alias("offset"))


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for path, length in batch[["path", "length"]].itertuples(index=False):
            digest = hashlib.sha256()
            with open_file(path) as stream:
                while piece := stream.read(1 << 20):
                    digest.update(piece)
            made.append((path, length, digest.hexdigest()))
        yield pd.DataFrame(made, columns=["path", "length", "sha256"])


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of files, read in pieces, so that no file's content is a row."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return list_files(spark, path).repartition(n, "path").mapInPandas(_hash, "path string, length long, sha256 string")
