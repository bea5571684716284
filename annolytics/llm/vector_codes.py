"""Product codes of vectors in whole numbers, with an equal-average search for the nearest codebook entry."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, lean, scratch, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 27   # of a scaled component: squares and their sums stay within 64 bits


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the whole-number entries of part p, an array of (entries, components). ``width``: components of a vector."""

    entries: tuple[np.ndarray, ...]
    width: int

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for x in part.ravel()).encode()).hexdigest()


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null where the vector is null, or holds a component that is null, not finite or
    beyond what 64-bit sums of squares can take (``LARGEST`` / scale)."""
    x = embedding.cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    return F.when(usable, F.transform(x, lambda v: F.floor(v * scale).cast("int")))


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the index of its nearest entry, the lowest of equally near ones, and the squared distance.

    Equal-average search: entries lie sorted by the sum of their components. From where a point's own sum falls, the next entry to
    the left or right, whichever sum is closer, is tried. The squared gap of sums over the dimension bounds the squared distance from
    below, so a point is done once that of its next entry strictly exceeds its best. All points step together, done ones leave."""
    size, dim = entries.shape
    order = np.argsort(entries.sum(1), kind="stable")
    sums = entries.sum(1)[order]
    own = points.sum(1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best = np.full(len(points), (1 << 62) // max(dim, 1), np.int64)
    index = np.full(len(points), size, np.int64)
    at = np.arange(len(points))
    while len(at):
        l, r = left[at], right[at]
        to_left = np.where(l >= 0, own[at] - sums[np.maximum(l, 0)], -1)
        to_right = np.where(r < size, sums[np.minimum(r, size - 1)] - own[at], -1)
        go_left = (to_left >= 0) & ((to_right < 0) | (to_left <= to_right))
        gap = np.where(go_left, to_left, to_right)
        open_ = (gap >= 0) & (gap * gap <= best[at] * dim)
        at, go_left, l, r = at[open_], go_left[open_], l[open_], r[open_]
        entry = order[np.where(go_left, l, r)]
        gaps = points[at] - entries[entry]
        distance = (gaps * gaps).sum(1)
        better = (distance < best[at]) | ((distance == best[at]) & (entry < index[at]))
        best[at[better]], index[at[better]] = distance[better], entry[better]
        left[at[go_left]] -= 1
        right[at[~go_left]] += 1
    return index, best


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v[:width]
    return out


def _parts(vectors: pd.Series, books: Codebooks) -> list[np.ndarray]:
    return np.split(_matrix(vectors, books.width), len(books.entries), axis=1)


def _sums(books: Codebooks):
    """Per task, part and entry: how many parts chose the entry, and their sums by component."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            for part, points in enumerate(_parts(batch["x"], books)):
                index, _ = nearest(points, books.entries[part])
                counts[part] += np.bincount(index, minlength=len(counts[part]))
                np.add.at(sums[part], index, points)
        rows = [(p, e, int(n), sums[p][e]) for p, own in enumerate(counts) for e, n in enumerate(own) if n]
        yield pd.DataFrame(rows, columns=["part", "entry", "n", "sums"])

    return run


def _rounded(books: Codebooks, rows: list) -> Codebooks:
    """Entries replaced by the floor of their parts' mean, component by component; unused ones stay."""
    new = [e.copy() for e in books.entries]
    for r in rows:
        new[r["part"]][r["entry"]] = [int(s) // int(r["n"]) for s in r["sums"]]
    return Codebooks(tuple(new), books.width)


def fit_codebooks(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``vectors`` (vec_id, embedding) after so many rounds over all usable rows; None without any.

    Each part's codebook starts as that part of the first ``entries`` vectors by vec_id (nulls last, then by components). A round is one
    pass: every task sums the parts of its rows by their nearest entry, and of these at most parts * entries rows a task are added
    up. Integer sums do not depend on the order of rows or tasks, so reruns and lost executors change nothing. Vectors of unequal length count as filled
    up with zeros to the longest, rounded up to a multiple of ``parts``. Only codebooks come to the driver."""
    spark = vectors.sparkSession
    folder = scratch(spark, "codes")
    rows = stored(vectors.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("x")).where("x is not null"), folder)
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        drop_folder(spark, folder)
        return None
    width = -(-max(longest, 1) // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).toPandas()
    books = Codebooks(tuple(np.split(_matrix(first["x"], width), parts, axis=1)), width)
    dim = width // parts
    for _ in range(rounds):
        added = (rows.select("x").mapInPandas(lean(_sums(books)), "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
                 .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")))
        books = _rounded(books, added.collect())
    drop_folder(spark, folder)
    return books


def encode(vectors: DataFrame, books: Codebooks, *, scale: int = SCALE) -> DataFrame:
    """Every usable row of ``vectors`` with ``code`` (two hex digits a part) and ``error`` (squared distances summed over parts), in one narrow pass."""
    @F.pandas_udf("code string, error long")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xs in batches:
            found = [nearest(points, books.entries[part]) for part, points in enumerate(_parts(xs, books))]
            marks = np.stack([index for index, _ in found], axis=1).astype(np.uint8) if len(xs) else np.zeros((0, 1), np.uint8)
            yield pd.DataFrame({"code": [m.tobytes().hex() for m in marks], "error": sum(d for _, d in found)})

    columns = [c for c in vectors.columns if c.lower() not in ("code", "error")]
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), whole_numbers(F.col("embedding"), scale).alias("x")).where("x is not null")
    return rows.select("row", coded("x").alias("c")).select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "c.code", "c.error")


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable row of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null, or holds null, non-finite or huge components (see ``whole_numbers``), are dropped. label_error sums the errors
    of equal labels, nulls together: one sum a task and label is moved, and joined back. Null and repeated vec_ids are rows like
    others, an empty vector is all zeros. With fewer rows than ``entries`` the codebooks are that much smaller; ``entries`` is at most 256. Columns other
    than the three are not looked at. No usable row: no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256: a code has two hex digits a part")
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)
    vectors = vectors.select("vec_id", "embedding", "label")
    books = fit_codebooks(vectors, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if books is None:
        return spark.createDataFrame([], f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode(vectors, books, scale=scale).drop("embedding"), scratch(spark, "coded"))
    c, s = coded.alias("c"), coded.groupBy("label").agg(F.sum("error").alias("label_error")).alias("s")
    return c.join(s, F.col("c.label").eqNullSafe(F.col("s.label"))).select("c.*", "s.label_error", F.lit(books.digest()).alias("codebooks_sha256"))
