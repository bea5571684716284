"""Token counts kept by content: only texts that no run has counted yet are encoded."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, text_of

ROWS = "digest string, n_tokens long"
CACHE = "version string, digest string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file and of the library that reads it: counts of another version are never reused."""
    with open(path, "rb") as file:
        data = file.read()
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(data + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def _counter(path: str) -> Callable[[str], int]:
    """Tokens of one text, as the library counts them, without begin, end or added special tokens, cut or padding."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one version, once per digest even where two runs have appended the same text."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ROWS)
    return (spark.read.schema(CACHE).parquet(folder).where(F.col("version") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def encode_misses(docs: DataFrame, cache: str, model: str, normal: Callable[[Column], Column] = text_of) -> str:
    """Counts the distinct texts of ``docs`` that the cache does not hold and appends them to it; returns the version.

    Copies of a text are dropped inside each task before the shuffle, so that a text a third of all rows hold moves once per
    task; the cache, partitioned by the same digest, is joined where the distinct texts then are."""
    spark = docs.sparkSession
    version = tokenizer_version(model)
    text = normal(F.col("text"))
    distinct = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text")).dropDuplicates(["digest"])
    misses = distinct.join(read_cache(spark, cache, version), "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(model)
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": [count(t) for t in batch["text"]]})

    counted = misses.mapInPandas(lean(encode), ROWS).select(F.lit(version).alias("version"), "digest", "n_tokens")
    counted.write.mode("append").partitionBy("version").parquet(cache)
    return version


def count_tokens(docs: DataFrame, cache: str, model: str, *, limit: int = 4096, normal: Callable[[Column], Column] = text_of) -> DataFrame:
    """Every row of ``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``cache`` is a table in shared storage, ``model`` the path of a vocabulary file that every executor has. ``normal`` brings a text
    to the form that is digested and encoded; by default null becomes empty and nothing else changes, as any other change would
    alter the counts of a tokenizer that keeps blanks. Empty texts have the tokens that the library gives them, none. Repeated rows
    each get the count. Input columns named like an output are replaced. No documents: no rows, the cache is not touched.

    A run that stops before its append loses its counts, one that stops later finds them; two runs at once may append a text
    twice, which reading evens out.
    """
    version = encode_misses(docs, cache, model, normal)
    columns = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    text = normal(F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text, 256).alias("digest"))
    r, c = rows.alias("r"), read_cache(docs.sparkSession, cache, version).alias("c")
    return r.join(c, F.col("r.digest") == F.col("c.digest"), "left").select(
        "r.row.*", "r.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
