"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, stored, text_of, word_count

BLOCK = 256
MAX_COPIES = 3
CYCLE = (5, 2, 1)


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(source, source_size, weight): sources in the order of their code points, null last, weigh as the cycle says."""
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1
    return sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]),
                                                              (rank % len(cycle) + 1).cast("int")).alias("weight"))


def targets(weighted: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, weight, target): shares of the total by weight, none above ``max_copies`` times its source.

    What a source cannot take is shared again by weight until none is above. The result has a closed form: sources whose
    ratio of limit to weight is smallest are the full ones; the level of the others, what remains over their weights, falls from the first of them on.
    One row per source goes through the window; documents do not.
    """
    limit = F.lit(float(max_copies)) * F.col("source_size")
    order = W.orderBy(F.when(F.col("weight") > 0, F.try_divide(limit, F.col("weight"))).otherwise(F.lit(float("inf"))), F.col("source").isNull(), "source")
    everything = W.partitionBy()
    ranked = weighted.select(
        "*", F.sum("source_size").over(everything).cast("double").alias("total"),
        F.coalesce(F.sum(limit).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("below"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open"))
    level = F.try_divide(F.col("total") - F.col("below"), F.col("open"))
    ranked = ranked.withColumn("full", F.coalesce(level * F.col("weight") >= limit, F.lit(False))).withColumn("level", level)
    ranked = ranked.withColumn("at", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return ranked.select("source", "source_size", "weight", F.when(F.col("full"), limit).otherwise(F.least(F.coalesce(F.col("at"), F.lit(0.0)) * F.col("weight"), limit)).alias("target"))


def _uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) * F.lit(2.0 ** -53)


# One step of the rounding, over a held unit i and the next unit j with sizes a and probabilities p. ``up`` is the mass that can
# move to i before one of them is whole, ``down`` the mass that can move to j; each direction is taken with the chance that
# keeps both expectations, and sizes times probabilities keep their sum.
_STEP = """
aggregate(units, named_struct('held', cast(null as struct<id: binary, a: double, p: double, u: double>),
                              'done', cast(array() as array<struct<id: binary, up: int>>)), (s, j) ->
  if(s.held is null, named_struct('held', j, 'done', s.done),
    transform(array(named_struct('up', least((1 - s.held.p) * s.held.a, j.p * j.a),
                                 'down', least(s.held.p * s.held.a, (1 - j.p) * j.a))), m ->
      transform(array(if(m.up + m.down <= 0, 0D, if(j.u * (m.up + m.down) < m.down, m.up, -m.down))), t ->
        transform(array(named_struct('pi', s.held.p + t / s.held.a, 'pj', j.p - t / j.a)), q ->
          if(least(q.pi, 1 - q.pi) <= least(q.pj, 1 - q.pj),
            named_struct('held', named_struct('id', j.id, 'a', j.a, 'p', greatest(0D, least(1D, q.pj)), 'u', j.u),
                         'done', array_append(s.done, named_struct('id', s.held.id, 'up', if(q.pi >= 0.5, 1, 0)))),
            named_struct('held', named_struct('id', s.held.id, 'a', s.held.a, 'p', greatest(0D, least(1D, q.pi)), 'u', s.held.u),
                         'done', array_append(s.done, named_struct('id', j.id, 'up', if(q.pj >= 0.5, 1, 0)))))
        )[0])[0])[0]))
"""


def pivotal_rounding(units: DataFrame, *, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Rounds ``units`` (group, id binary, a: size over 0, p: probability) to (id, up): 1 for those that are chosen, 0 for others.

    In a group the chosen sizes sum to the expected sum, but for the one unit that is rounded last; each unit is chosen with its
    own probability. Ids are unique. Units of a group are dealt by hash into blocks of about ``block``, so that a group with a
    third of all units is as many tasks as it needs. Each block is folded to one fractional unit; those are dealt into blocks
    again, a tree whose every level is a table in the shared folder, until one unit is left in each group and is rounded by
    its probability. Random numbers depend on seed, level and id alone: reruns agree.
    """
    spark = units.sparkSession
    folder = scratch(spark, "mix")
    level, parts = stored(units.select("group", "id", F.col("a").cast("double").alias("a"), F.col("p").cast("double").alias("p")), f"{folder}/units"), []
    n = 0
    while True:
        counts = level.groupBy("group").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        c, r = counts.alias("c"), level.alias("r")
        dealt = r.join(c, F.col("r.group").eqNullSafe(F.col("c.group"))).select(
            "r.group", "id", "a", "p", F.pmod(F.xxhash64(F.lit(seed + 101 * n), "id"), F.ceil(F.col("n") / block)).alias("block"))
        folded = (dealt.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct(
            _uniform(seed + 101 * n + 1, "id").alias("o"), "id", "a", "p", _uniform(seed + 101 * n + 2, "id").alias("u")))).alias("x"))
            .select("group", F.expr("transform(x, y -> struct(y.id, y.a, y.p, y.u))").alias("units"))
            .select("group", F.expr(_STEP).alias("s")).select("group", "s.held", "s.done"))
        folded = stored(folded, f"{folder}/level{n}")
        parts.append(folded.select(F.explode("done").alias("x")).select("x.id", "x.up"))
        level = folded.select("group", "held.id", "held.a", "held.p")
        n += 1
    out = level.select("id", (_uniform(seed + 7, "id") < F.col("p")).cast("int").alias("up"))
    for part in parts:
        out = out.unionByName(part)
    return out


def _unit_id() -> Column:
    """128 bits and more for a row's source, doc_id and text."""
    fields = F.struct(F.col("source").cast("string").alias("s"), F.col("doc_id").cast("string").alias("d"), F.md5(text_of("text")).alias("k"))
    return F.unhex(F.sha2(F.to_json(fields), 256))


def decide(docs: DataFrame, *, weights: DataFrame | None = None, max_copies: int = MAX_COPIES, seed: int = 0,
           block: int = BLOCK) -> DataFrame:
    """(id, doc_id, source, size, source_size, target, rows, copies): how often the mix takes each distinct row of ``docs``.

    Size is the number of words. A source's target comes from its weight (``weights``: source, weight, 0 if it is not there; by
    default 5, 2, 1 and so on in the order of the sources) as ``targets`` says. A document's expected copies are target over
    source size; the whole part is given, the fraction is rounded by ``pivotal_rounding``, so that a source's taken words miss
    its target by less than one document. Rows that agree in doc_id, source and text are one unit of ``rows`` members, whose
    ``copies`` are the unit's in all. Documents without words are taken as often as the whole part says. A null source is a
    source of its own, a null text has no words, a null doc_id is an id like others. No documents: no rows.
    """
    spark = docs.sparkSession
    unit = docs.select(_unit_id().alias("id"), "doc_id", F.col("source").cast("string").alias("source"), word_count(text_of("text")).alias("size"))
    units = stored(unit.groupBy("id", "doc_id", "source", "size").agg(F.count("*").alias("rows")), scratch(spark, "mix-units"))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    if weights is None:
        weighted = cyclic_weights(sizes)
    else:
        z, w = sizes.alias("z"), weights.alias("w")
        weighted = z.join(w, F.col("z.source").eqNullSafe(F.col("w.source")), "left").select(
            "z.source", "source_size", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    plan = stored(targets(weighted, max_copies), scratch(spark, "mix-targets"))
    u, t = units.alias("u"), plan.alias("t")
    wish = F.col("rows") * F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    wanted = (u.join(t, F.col("u.source").eqNullSafe(F.col("t.source")))
              .select("id", "doc_id", "u.source", "size", "rows", "source_size", "target", wish.alias("wish"))
              .withColumn("p", F.when(F.col("size") > 0, F.col("wish") - F.floor("wish")).otherwise(F.lit(0.0))))
    rounded = pivotal_rounding(wanted.where("p > 0").select(F.col("source").alias("group"), "id", F.col("size").alias("a"), "p"),
                               seed=seed, block=block)
    return wanted.join(rounded, "id", "left").select(
        "id", "doc_id", "source", "size", "source_size", "target", "rows",
        (F.floor("wish") + F.coalesce(F.col("up"), F.lit(0))).cast("long").alias("copies"))


def per_row(decided: DataFrame) -> DataFrame:
    """A row per document row instead of one per unit: members of a unit take equal shares, the first ones one more."""
    share, more = F.expr("copies div rows"), F.col("copies") % F.col("rows")
    members = decided.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("member"))
    return members.withColumn("copies", share + F.when(F.col("member") <= more, 1).otherwise(0)).drop("member", "rows")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as ``decide`` (same options) says. Equal rows in doc_id,
    source and text stand for each other: extra columns come from one of them."""
    rows = docs.select(_unit_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).groupBy("id").agg(F.first("row").alias("row"))
    taken = decide(docs, **options).where("copies > 0").select("id", "copies")
    return (rows.join(taken, "id").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*"))
