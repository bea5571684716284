"""Scores of runs and their comparison with a baseline."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDITIVE = ("cost_usd", "wall_s", "duration_s", "turns", "input_tokens", "cache_read", "cache_write", "output_tokens", "highlights", "core",
            "margin_notes", "sticky_notes")


def scorecard(parts: list[DataFrame], key: str = "run") -> DataFrame:
    """One wide row per run from tables of one row per run."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), parts)


def score_rows(scores: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """A score card as rows ``run, metric, value``, with a total row (null run) for the additive metrics."""
    rows = scores.unpivot([key], metrics, "metric", "value")
    total = rows.filter(F.col("metric").isin(*ADDITIVE) & F.col("value").isNotNull()).groupBy("metric").agg(F.bround(F.sum("value"), 4).alias("value"))
    return rows.unionByName(total.select(F.lit(None).cast(rows.schema[key].dataType).alias(key), "metric", "value"))


def score_table(scores: DataFrame, key: str, metrics: list[str], runs: list) -> DataFrame:
    """Metric by run for a few named runs."""
    return score_rows(scores, key, metrics).filter(F.col(key).isin(*runs)).groupBy("metric").pivot(key, runs).agg(F.first("value"))


def first_of_paper(runs: DataFrame, paper: str, order: str) -> DataFrame:
    rest = [c for c in runs.columns if c != paper]
    return runs.groupBy(paper).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(paper, "r.*")


def compare(now: DataFrame, before: DataFrame, paper: str, order: str, metrics: list[str], key: str = "run") -> DataFrame:
    """Each run's metrics against the baseline's first run of the same paper: difference, percent and whether they are equal."""
    old = first_of_paper(before, paper, order).select(paper, F.col(key).alias("baseline_run"), *[F.col(m).alias(f"b_{m}") for m in metrics])
    rows = now.join(old, paper, "left")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").cast("double").alias("before"), F.col(m).cast("double").alias("after")) for m in metrics])
    out = rows.select(key, paper, "baseline_run", F.inline(cells))
    d = F.col("after") - F.col("before")
    return out.withColumns({"delta": F.bround(d, 4), "percent": F.when(F.col("before") != 0, F.bround(d / F.col("before") * 100, 0)),
                            "equal": F.col("after") == F.col("before")})


def copied_comments(annotations: DataFrame, limit: float = 0.6) -> DataFrame:
    """Comments that copy the marked text: without wide characters, or more alike than the limit. Only pairs whose lengths allow
    the ratio are compared."""
    from ..functions import text as T
    from .anchor import sequence_ratio
    a, b = F.lower("comment"), F.lower(F.coalesce("text", F.lit("")))
    bound = 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))
    rows = annotations.filter(F.trim(F.coalesce("comment", F.lit(""))) != "").withColumn("wide", T.count_matches("comment", T.CJK) > 0)
    plain = rows.filter(~F.col("wide"))
    close = rows.filter(F.col("wide") & (bound > limit)).withColumn("ratio", sequence_ratio(a, b)).filter(F.col("ratio") > limit).drop("ratio")
    return plain.unionByName(close).drop("wide")


