"""Listings of annotations and notes, positions, fingerprints and guarded caches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

OWN_CHARS, OTHER_CHARS = 2000, 80
POSITION = "pageIndex int, rects array<array<double>>, fontSize double, rotation int, paths array<array<double>>"


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Library items from JSON lines under a given schema; a broken line gives nulls, nothing is inferred."""
    return spark.read.schema(schema).json(path)


def list_annotations(annotations: DataFrame, own_tags: tuple[str, ...] = R.OWN_TAGS) -> DataFrame:
    """A listing: the tool's own texts and comments long, others' short."""
    cut = F.when(R.is_own("tags", own_tags), OWN_CHARS).otherwise(OTHER_CHARS)
    return annotations.withColumns({c: F.substring(F.coalesce(c, F.lit("")), F.lit(1), cut) for c in ("text", "comment")})


def list_notes(notes: DataFrame, own_tags: tuple[str, ...] = R.OWN_TAGS) -> DataFrame:
    """Notes with their titles; only the tool's own keep their markup."""
    return notes.withColumns({"title": T.note_title("html"), "html": F.when(R.is_own("tags", own_tags), F.col("html"))})


def parse_position(c: str | Column) -> Column:
    """A position given as JSON text; bad input is an empty one, and only rectangles of four numbers stay."""
    p = F.from_json(T.col(c), POSITION)
    rects = F.filter(F.coalesce(p["rects"], F.array().cast("array<array<double>>")), lambda r: (F.size(r) == 4) & ~F.exists(r, lambda v: v.isNull()))
    return F.struct(p["pageIndex"].alias("page_index"), F.transform(rects, lambda r: F.struct(
        r[0].alias("x0"), r[1].alias("y0"), r[2].alias("x1"), r[3].alias("y1"))).alias("rects"),
        p["fontSize"].alias("font_size"), p["rotation"].alias("rotation"), p["paths"].alias("paths"))


def content_fingerprint(c: str | Column) -> Column:
    return F.sha2(T.col(c), 256)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are new, gone or different."""
    a, b = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    return a.join(b, "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))


def fresh_rows(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Cached rows (``doc_id, sha256``) whose document is still the one they were made from."""
    return cache.join(current.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_semi")


def stale_documents(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Documents whose cache is missing, without a fingerprint or of other content: to be made again."""
    return current.select("doc_id", "sha256").join(cache.select("doc_id", "sha256").distinct(), ["doc_id", "sha256"], "left_anti")
