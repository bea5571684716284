"""Reply trees to conversations, in DataFrame operations only."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_folder, scratch, stored, text_of

# The control strings of the template
OPEN, CLOSE, END, START = "[INST]", "[/INST]", "</s>", "<s>"
CONTROLS = (START, END, OPEN, CLOSE)


def escape(text: Column) -> Column:
    """The text with no control string in it: backslashes are doubled, then a single one goes behind the first character of
    each control string. No control string has a backslash or starts inside another."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turns_to_tree(turns: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text, score) of conversations given as rows (conv_id, turn, role, text): a chain per
    conversation, ordered by turn; rows of one turn follow by role and text, nulls first."""
    order = W.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    node = F.row_number().over(order).cast("long")
    return (turns.select(F.col("conv_id").alias("tree"), node.alias("node"), text_of("role").alias("role"), text_of("text").alias("text"))
            .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0)))


def _same(*pairs: tuple[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def root_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth) for every node on the ``best`` paths from a root to a leaf of each tree.

    ``nodes``: (tree, node, parent, score). Paths are found by self-joins that double their reach: after round r each node knows its
    ancestor 2^r steps up and the sum of scores in between, so a chain of n messages takes log2(n) joins. A node that has reached its
    root takes no part in later rounds, but as what a deeper node of its tree meets. Branches rank by the sum of their scores,
    ties by the smaller leaf. The chosen leaves then walk up the same tables from the longest step to the shortest, doubling the
    nodes they hold; only nodes deep enough for a step take it. Rounds are tables in the shared folder and hold ids, no texts.

    A node whose parent is missing is a root. Nodes that repeat an id in a tree count once, by the smallest parent. Nodes
    on a circle, or below one, have no root and are on no path.
    """
    spark = nodes.sparkSession
    folder = scratch(spark, "paths")
    once = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    n, p = once.alias("n"), once.select("tree", "node").alias("p")
    reach = stored(n.join(p, _same(("n.tree", "p.tree")) & (F.col("n.parent") == F.col("p.node")), "left")
                   .select("n.tree", "n.node", F.col("p.node").alias("up"), "n.score", F.lit(1).cast("long").alias("depth")), f"{folder}/0")
    first, steps, done, total = reach, [], [], reach.count()
    while True:
        done.append(reach.where("up is null"))
        live = reach.where("up is not null")
        if not live.limit(1).count() or 2 ** len(steps) > 4 * total:
            break
        steps.append(live)
        t, d = live.select("tree").distinct().alias("t"), _union(done).alias("d")
        met = live.unionByName(d.join(t, _same(("d.tree", "t.tree")), "left_semi"))
        a, b = live.alias("a"), met.alias("b")
        reach = stored(a.join(b, _same(("a.tree", "b.tree")) & (F.col("a.up") == F.col("b.node"))).select(
            "a.tree", "a.node", F.col("b.up").alias("up"), (F.col("a.score") + F.col("b.score")).alias("score"),
            (F.col("a.depth") + F.col("b.depth")).alias("depth")), f"{folder}/{len(steps)}")
    n, c = _union(done).alias("n"), first.where("up is not null").select("tree", "up").distinct().alias("c")
    leaves = n.join(c, _same(("n.tree", "c.tree"), ("n.node", "c.up")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.col("score").desc(), "node"))
    held = [stored(leaves.withColumn("rank", rank).where(F.col("rank") <= best)
                   .select("tree", F.col("node").alias("leaf"), "rank", "node", "depth"), f"{folder}/held")]
    for k in range(len(steps) - 1, -1, -1):
        s, h = steps[k].alias("s"), _union(held).where(F.col("depth") > 2 ** k).alias("h")
        held.append(stored(h.join(s, _same(("h.tree", "s.tree")) & (F.col("h.node") == F.col("s.node"))).select(
            "h.tree", "h.leaf", "h.rank", F.col("s.up").alias("node"), (F.col("h.depth") - 2 ** k).alias("depth")), f"{folder}/held{k}"))
    for k in range(len(steps) + 1):
        drop_folder(spark, f"{folder}/{k}")
    return _union(held)


def format_paths(nodes: DataFrame, paths: DataFrame, trained: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, mask): one conversation per chosen path, as one text.

    Each turn is ``[INST] role [/INST]text</s>``, role and text escaped. ``mask`` tells what the loss is taken on: for each turn
    of the role ``trained`` its place among the turns and where its text stands in it. A conversation is one row, so that is
    the most a task must hold at a time."""
    once = nodes.groupBy("tree", "node").agg(F.min(F.struct(text_of("role").alias("role"), text_of("text").alias("text"))).alias("m"))
    p, n = paths.alias("p"), once.alias("n")
    turn = F.concat(F.lit(OPEN + " "), escape(F.col("n.m.role")), F.lit(" " + CLOSE), escape(F.col("n.m.text")), F.lit(END))
    start = F.length(escape(F.col("n.m.role"))) + len(OPEN) + len(CLOSE) + 2
    rows = p.join(n, _same(("p.tree", "n.tree"), ("p.node", "n.node"))).select(
        "p.tree", "p.leaf", "p.rank", F.struct(F.col("p.depth").alias("depth"), turn.alias("turn"), (F.col("n.m.role") == trained).alias("on"), start.alias("start"),
                                               F.length(escape(F.col("n.m.text"))).alias("length")).alias("t"))
    grouped = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    mask = F.filter(F.transform("ts", lambda t, i: F.struct(t["on"].alias("on"), i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"))), lambda t: t["on"])
    return grouped.select("tree", "leaf", "rank", F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"),
                          F.transform(mask, lambda t: F.struct(t["turn"].alias("turn"), t["start"].alias("start"), t["length"].alias("length"))).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (role, text as they were) and loss (the texts under the mask), both from the output alone."""
    pieces = F.split(F.col("formatted"), END.replace("/", "/"))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return (formatted.select("*", pieces.alias("pieces"))
            .withColumn("turns", F.transform("pieces", lambda t: F.struct(
                unescape(F.substring_index(F.substring(t, len(OPEN) + 2, 2_147_483_647), " " + CLOSE, 1)).alias("role"),
                unescape(F.substring(t, F.instr(t, CLOSE) + len(CLOSE), F.length(t))).alias("text"))))
            .withColumn("loss", F.transform("mask", lambda m: unescape(F.substring(F.element_at(F.col("pieces"), m["turn"] + 1), m["start"] + 1, m["length"])))))


def conversations(nodes: DataFrame, *, best: int = 1, trained: str = "assistant") -> DataFrame:
    """The ``best`` conversations of each reply tree, ``nodes`` (tree, node, parent, role, text, score), formatted with mask.

    Null roles and texts are empty. A null tree is a tree of its own. Repeated nodes count once, other columns are not looked at.
    Circles give no conversation. No nodes: no rows."""
    slim = nodes.select("tree", "node", "parent", "score")
    return format_paths(nodes, root_paths(slim, best), trained)
