"""Running values over an ordered key without one task per key.

A plain window function over ``partitionBy(key)`` sorts a whole key in one task, so a document, session or user holding a
third of all rows makes that task the job. Here every key is cut into chunks along its order. Rows are windowed inside
``(key, chunk)``, one small row per chunk carries the chunk's totals, the totals are windowed per key, and the result is
joined back on ``(key, chunk)``. The rows are shuffled once, on ``(key, chunk)``, and stay so partitioned, so consecutive
scans over the same chunk column need no further exchange of the rows.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 4096


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max, min, last (ignoring nulls), lag or total."""

    kind: str
    expr: Column
    before: bool = False      # up to the row before, not the row itself


def running_sum(expr, before: bool = False) -> Running:
    return Running("sum", expr if isinstance(expr, Column) else F.lit(expr), before)


def running_count(condition: Column | None = None, before: bool = False) -> Running:
    one = F.lit(1).cast("long") if condition is None else F.when(condition, 1).otherwise(0).cast("long")
    return Running("sum", one, before)


def running_max(expr: Column, before: bool = False) -> Running:
    return Running("max", expr, before)


def running_min(expr: Column, before: bool = False) -> Running:
    return Running("min", expr, before)


def last_known(expr: Column, before: bool = False) -> Running:
    return Running("last", expr, before)


def previous(expr: Column) -> Running:
    return Running("lag", expr, True)


def group_total(expr: Column) -> Running:
    return Running("total", expr)


def chunk_of(position: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """The chunk of a dense row number."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(rows)).cast("long")


def time_chunk(df: DataFrame, ts: str, seconds: int = 3600) -> Column:
    """The chunk of an event time: a hot key is cut by time. A time without zone is counted as it reads, so that no session
    zone can make it fall."""
    c = F.col(ts)
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        at = F.datediff(F.to_date(c), F.lit("1970-01-01")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    else:
        at = F.floor(F.unix_micros(c) / F.lit(1_000_000))
    return F.floor(at / F.lit(seconds)).cast("long")


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], chunk: str | Column, reverse: bool = False,
                 **values: Running) -> DataFrame:
    """``df`` with one column per running value.

    ``order`` must order the rows of a key totally and ``chunk`` must not fall along it. ``reverse`` runs from the last
    row to the first, which makes ``previous`` the next row.
    """
    own_chunk = not isinstance(chunk, str)
    at = "__chunk" if own_chunk else chunk
    if own_chunk:
        df = df.withColumn(at, chunk)
    inputs = {n: F.struct(v.expr.alias("v")) if v.kind == "lag" else v.expr for n, v in values.items()}
    narrow = df.withColumns({f"__in_{n}": e for n, e in inputs.items()})
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    chunk_sort = F.col(at).desc() if reverse else F.col(at).asc()
    inside = Window.partitionBy(*keys, at).orderBy(*sort)
    across = Window.partitionBy(*keys).orderBy(chunk_sort).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    position = F.struct(*[F.col(c) for c in order])
    edge = F.min_by if reverse else F.max_by

    local, totals, offsets, final = {}, [], {}, {}
    for name, v in values.items():
        x = F.col(f"__in_{name}")
        frame = inside.rowsBetween(Window.unboundedPreceding, -1 if v.before else 0)
        off, loc, tot = f"__off_{name}", f"__loc_{name}", f"__tot_{name}"
        if v.kind == "sum":
            local[loc] = F.sum(x).over(frame)
            totals.append(F.sum(x).alias(tot))
            offsets[off] = F.sum(tot).over(across)
            final[name] = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(off), F.lit(0))
        elif v.kind in ("max", "min"):
            fn, pick = (F.max, F.greatest) if v.kind == "max" else (F.min, F.least)
            local[loc] = fn(x).over(frame)
            totals.append(fn(x).alias(tot))
            offsets[off] = fn(tot).over(across)
            final[name] = pick(F.col(loc), F.col(off))
        elif v.kind in ("last", "lag"):
            local[loc] = F.last(x, ignorenulls=True).over(frame)
            totals.append(edge(x, F.when(x.isNotNull(), position)).alias(tot))
            offsets[off] = F.last(tot, ignorenulls=True).over(across)
            merged = F.coalesce(F.col(loc), F.col(off))
            final[name] = merged.getField("v") if v.kind == "lag" else merged
        elif v.kind == "total":
            totals.append(F.sum(x).alias(tot))
            offsets[off] = F.sum(tot).over(whole)
            final[name] = F.col(off)
        else:
            raise ValueError(f"unknown running value {v.kind}")

    chunks = narrow.groupBy(*keys, at).agg(*totals).withColumns(offsets).select(*keys, at, *offsets)
    out = narrow.withColumns(local).join(chunks, [*keys, at], "left").withColumns(final)
    scratch = [c for c in out.columns if c.startswith(("__in_", "__loc_", "__off_"))]
    return out.drop(*scratch, *(["__chunk"] if own_chunk else []))


def join_facts(df: DataFrame, facts: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """``df`` left joined with one fact row per key, through the key's chunks, so that a hot key's rows stay spread."""
    spread = df.select(*keys, chunk).distinct().join(facts, keys, "left")
    return df.join(spread, [*keys, chunk], "left")


def histogram(df: DataFrame, keys: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """Per key and value the total weight and the weight up to and including the value. Pre-aggregated, so that the
    window runs over distinct values, not rows."""
    counts = df.groupBy(*keys, value.alias("value")).agg(
        F.sum(F.lit(1).cast("long") if weight is None else weight).alias("weight"))
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"upto": F.sum("weight").over(upto),
                               "total": F.sum("weight").over(Window.partitionBy(*keys))})


def element_at_index(df: DataFrame, keys: list[str], value: Column, index: Column, name: str) -> DataFrame:
    """Per key the element ``index`` (from 0; an expression over ``total``) of its sorted values, exactly: the first value
    with more than ``index`` elements up to it."""
    h = histogram(df.filter(value.isNotNull()), keys, value)
    return h.filter(F.col("upto") > index).groupBy(*keys).agg(F.min("value").alias(name))


def upper_median(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``sorted[n // 2]`` per key."""
    return element_at_index(df, keys, value, F.floor(F.col("total") / 2), name)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``. Every salted part of a key gives its own first ``k``, and only those
    meet, so a key with most of all rows is ranked in parts."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    few = salted.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k).drop("__salt", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once. A filter on a plain computed column is pushed below it and computes it a
    second time; it is not pushed below a generated one."""
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small file read by one task leaves the others idle in
    work that is all computing. Where the scan has enough partitions, as on any large table, nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_rows(df: DataFrame, *keys: str, rows: int = 1 << 17) -> DataFrame:
    """A table, whose rows are counted, by keys over as many partitions as shuffles have, or one for each ``rows`` if these are more: a number that
    adaptive execution keeps, so that the rows of a task, and its memory, do not grow with the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // rows)), *keys)


def by_chunks(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys and chunk over as many partitions as shuffles have, a number that adaptive execution keeps: rows of a few bytes are not put into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
