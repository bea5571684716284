"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them, one vector kept of each group."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_folder, lean, scratch, stored
from .components import components

THRESHOLD = 0.9
CELL_ROWS = 256           # vectors that a cell should have
MAX_TOPS, MAX_SUBS = 256, 256
SAMPLE_PER_CELL = 32      # vectors of the sample that a centroid is fitted on
PROBES, VISITS = 4, 3     # first-level cells looked into for a vector, and cells that it visits besides its own
BLOCK = 1024              # rows of a side of a cosine product
ROUNDS = 6
APART = 0.7               # seeds of cells are less similar than this, so that a group of near copies gets one cell
CHUNK = 2048
MARGIN = 1e-9


def _row_bytes(values, kind) -> bytes | None:
    """A vector as bytes without zeros at its end; None where it can have no cosine."""
    if values is None:
        return None
    x = np.asarray(values)
    if x.dtype == object:
        if any(v is None for v in x):
            return None
        x = x.astype(kind)
    x = x.astype(kind, copy=False)
    used = np.flatnonzero(x)
    if not len(used) or not np.isfinite(x).all():
        return None
    return x[:used[-1] + 1].tobytes()


def packed(embedding: Column, kind: str) -> Column:
    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([_row_bytes(v, kind) for v in vectors], dtype=object)

    # nulls inside an array would come to Python as NaN of another type
    return F.when(F.forall(embedding, lambda x: x.isNotNull()), pack(embedding))


def unit_rows(vectors, kind: str) -> np.ndarray:
    """Packed vectors as rows of length 1, in doubles, filled up with zeros to the longest."""
    rows = [np.frombuffer(v, kind) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    if len(rows):
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows; what one side lacks in width is zero."""
    w = min(a.shape[1], b.shape[1])
    return a[:, :w] @ b[:, :w].T


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, apart: float = APART) -> np.ndarray:
    """At most ``k`` centroids of the unit rows ``x``. Seeds are the first rows that are not too similar to earlier seeds; centroids that
    come to within the similarity of a group of copies of a larger one are given up."""
    if not len(x):
        return x
    seeds = [0]
    near = products(x, x[:1])[:, 0]
    while len(seeds) < k:
        free = near < apart
        if not free.any():
            break
        seeds.append(int(free.argmax()))
        near = np.maximum(near, products(x, x[seeds[-1]:seeds[-1] + 1])[:, 0])
    c = x[seeds].copy()
    for _ in range(rounds):
        home = np.concatenate([products(x[i:i + CHUNK], c).argmax(1) for i in range(0, len(x), CHUNK)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(1))
        c = np.where((size > 0)[:, None], sums / np.maximum(size, 1e-300)[:, None], c)
    counts = np.bincount(home, minlength=len(c))
    kept: list[int] = []
    for i in np.argsort(-counts, kind="stable"):
        if not kept or products(c[i:i + 1], c[kept]).max() < THRESHOLD:
            kept.append(int(i))
    return c[sorted(kept)]


@dataclass(frozen=True)
class Cells:
    """Centroids in two levels. ``tops``: first-level ones; ``subs[t]``: those of the cells inside; cells are numbered through."""

    tops: np.ndarray
    subs: tuple[np.ndarray, ...]

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(s) for s in self.subs])]).astype(np.int64)

    def nearest(self, x: np.ndarray, n: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, similarities) of the ``n`` nearest cells of each row, best first, among those of its ``probes`` nearest first-level
        cells; cell -1 where there are fewer."""
        first = products(x, self.tops)
        probes = min(probes, first.shape[1])
        tops = np.argpartition(-first, probes - 1, axis=1)[:, :probes]
        starts, places = self.starts(), probes * n
        cells, sims = np.full((len(x), places), -1, np.int64), np.full((len(x), places), -2.0)
        for t in np.unique(tops):
            rows, slot = np.nonzero(tops == t)
            s = products(x[rows], self.subs[t])
            m = min(n, s.shape[1])
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            at = slot[:, None] * n + np.arange(m)
            cells[rows[:, None], at] = best + starts[t]
            sims[rows[:, None], at] = np.take_along_axis(s, best, 1)
        order = np.lexsort((cells, -sims), axis=1)[:, :n]
        return np.take_along_axis(cells, order, 1), np.take_along_axis(sims, order, 1)


def fit_cells(vectors: DataFrame, kind: str, *, cell_rows: int = CELL_ROWS, per_cell: int = SAMPLE_PER_CELL) -> Cells:
    """Cells for ``vectors`` (key, vec), about one for ``cell_rows`` of them.

    The first level is fitted on the driver, on a sample of ``per_cell`` vectors a cell (at most 256 cells, so 8,192 vectors); the second in a task for
    each first-level cell, on as many of its vectors a cell (at most 256 cells and 8,192 vectors a task). Samples are taken by hash
    of the vector, copies count once. The result has at most 65,536 centroids, whatever the input; beyond 16 million vectors cells
    grow, and their products go on in blocks. Only the fit samples; every vector is put into cells."""
    n = vectors.count()
    cells = max(1, -(-n // cell_rows))
    k1 = min(MAX_TOPS, max(1, math.isqrt(cells)))
    k2 = min(MAX_SUBS, -(-cells // k1))

    def sample(rows: int) -> DataFrame:
        share = min(1.0, rows / max(n, 1))
        return vectors.where(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("key", "vec").distinct()

    top = sample(per_cell * k1).orderBy("key").limit(2 * per_cell * k1).toPandas()
    tops = spherical_kmeans(unit_rows(top["vec"], kind), k1)

    def top_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), CHUNK):
                part = batch.iloc[i:i + CHUNK]
                yield pd.DataFrame({"top": products(unit_rows(part["vec"], kind), tops).argmax(1), "key": part["key"], "vec": part["vec"]})

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit_rows(pdf.sort_values("key")["vec"], kind)
        return pd.DataFrame({"top": int(pdf["top"].iloc[0]), "centroid": [c.tobytes() for c in spherical_kmeans(x, k2)]})

    own = sample(per_cell * k1 * k2).mapInPandas(lean(top_of), "top int, key binary, vec binary")
    own = own.withColumn("r", F.row_number().over(W.partitionBy("top").orderBy("key"))).where(F.col("r") <= per_cell * k2)
    found = own.groupBy("top").applyInPandas(split, "top int, centroid binary").toPandas()
    subs = [unit_rows(found.loc[found["top"] == t, "centroid"], "float64") for t in range(len(tops))]
    return Cells(tops, tuple(s if len(s) else tops[t:t + 1] for t, s in enumerate(subs)))


@dataclass(frozen=True)
class Plan:
    """What the tasks know of each cell: how far its own vectors reach, the weight and first id of its core, and the blocks of core, shell
    and visitors. All arrays have an entry per cell."""

    reach: np.ndarray
    core_n: np.ndarray
    core_weight: np.ndarray
    core_id: np.ndarray
    shell_n: np.ndarray
    visitors: np.ndarray

    def visited(self, cells: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Of the cells that rows would visit those that can hold a vector similar to them; -1 for others."""
        known = (cells >= 0) & (self.core_n + self.shell_n)[np.maximum(cells, 0)].astype(bool)
        angle = np.arccos(np.clip(sims, -1, 1))
        return np.where(known & (angle <= self.reach[np.maximum(cells, 0)] + MARGIN), cells, -1)


def _assigned(cells: Cells, kind: str, core: float, visits: int, probes: int):
    """Rows with the nearest cell, their similarity to it, whether they are in its core, and the cells that they would visit."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), CHUNK):
                part = batch.iloc[i:i + CHUNK]
                found, sims = cells.nearest(unit_rows(part["vec"], kind), visits + 1, probes)
                yield part.assign(home=found[:, 0], sim=sims[:, 0], core=sims[:, 0] >= core, cells=list(found[:, 1:]), sims=list(sims[:, 1:]))

    return run


def _stack(values, columns: int, kind) -> np.ndarray:
    return np.array([np.asarray(v) for v in values], dtype=kind).reshape(len(values), columns)


def _visitors(plan: Plan, visits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(plan.reach), np.int64)
        for batch in batches:
            to = plan.visited(_stack(batch["cells"], visits, np.int64), _stack(batch["sims"], visits, float))
            counts += np.bincount(to[to >= 0], minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": used, "n": counts[used]})

    return run


UNIT = "cell long, p int, q int, side int, id long, vec binary, weight long, core boolean, home long, visited array<long>"
BOTH, LEFT, RIGHT = 2, 0, 1


def _units(plan: Plan, visits: int, block: int):
    """A row of ``UNIT`` for each product that a vector takes part in.

    A cell that fits two blocks is one product of its own vectors with these and its visitors. A larger one is cut into blocks of core, shell and
    visitors, by hash: shell with shell, core with shell, both with visitors. Core and core are not compared: their cosine is known."""

    def places(cell: int, core: bool, guest: bool, mix: int) -> list[tuple[int, int, int]]:
        n_core, n_shell, n_guests = int(plan.core_n[cell]), int(plan.shell_n[cell]), int(plan.visitors[cell])
        if n_core + n_shell + n_guests <= 2 * block:
            return [(0, 0, RIGHT if guest else BOTH)]
        c, s, v = (-(-x // block) for x in (n_core, n_shell, n_guests))
        if guest:
            own = c + s + mix % v
            return [(p, own, RIGHT) for p in range(c + s)]
        own = mix % c if core else c + mix % s
        with_guests = [(own, q, LEFT) for q in range(c + s, c + s + v)]
        if core:
            return [(own, q, LEFT) for q in range(c, c + s)] + with_guests
        inside = [(min(own, q), max(own, q), BOTH if q == own else LEFT if own < q else RIGHT) for q in range(c, c + s)]
        return [(p, own, RIGHT) for p in range(c)] + inside + with_guests

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in UNIT.split(", ")]
        for batch in batches:
            to = plan.visited(_stack(batch["cells"], visits, np.int64), _stack(batch["sims"], visits, float))
            rows = []
            for id_, vec, weight, core, home, going in zip(batch["id"], batch["vec"], batch["weight"], batch["core"], batch["home"], to):
                mix = (id_ * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33
                rows.extend((home, *place, id_, vec, weight, core, home, going) for place in places(home, core, False, mix))
                for cell in going:
                    if cell >= 0:
                        rows.extend((cell, *place, id_, vec, weight, False, home, going) for place in places(cell, False, True, mix))
                if len(rows) > 8 * CHUNK:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return run


def linked_groups(mask: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest row number that each of ``n`` rows reaches over the links of ``mask`` (rows ``left`` by rows ``right``)."""
    label, far = np.arange(n), n
    while True:
        new = label.copy()
        np.minimum.at(new, left, np.where(mask, label[right][None, :], far).min(1, initial=far))
        np.minimum.at(new, right, np.where(mask, label[left][:, None], far).min(0, initial=far))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(kind: str, threshold: float):
    """Of a product's rows those with links: how many vectors they are linked with there, and the id of the first that they reach."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        cell, side, weight = int(pdf["cell"].iloc[0]), pdf["side"].to_numpy(), pdf["weight"].to_numpy(np.int64)
        core, home, ids = pdf["core"].to_numpy(bool), pdf["home"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
        x = unit_rows(pdf["vec"], kind)
        left, right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
        none = pd.DataFrame({"id": [], "links": [], "first": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        mask = products(x[left], x[right]) >= threshold
        mask &= left[:, None] != right[None, :]
        mask &= ~(core[left][:, None] & core[right][None, :])
        # a guest's pair with a vector that visits the guest's cell in turn belongs to the lower of the two cells
        visited = _stack(pdf["visited"].iloc[left], len(pdf["visited"].iloc[0]), np.int64)
        for column in visited.T:
            mask &= ~((column[:, None] == home[right][None, :]) & (home[right] < cell)[None, :])
        if not mask.any():
            return none
        links = np.zeros(len(pdf), np.int64)
        links[left] += mask.astype(np.int64) @ weight[right]
        guests = side[right] == RIGHT
        links[right[guests]] += weight[left] @ mask[:, guests].astype(np.int64)
        first = ids[linked_groups(mask, left, right, len(pdf))]
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some], "first": first[some]})

    return run


def _core_links(plan: Plan):
    """Links of core vectors with the others of their core, and its first id."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            home = batch["home"].to_numpy(np.int64)
            out = pd.DataFrame({"id": batch["id"], "links": plan.core_weight[home] - batch["weight"].to_numpy(np.int64), "first": plan.core_id[home]})
            yield out[(plan.core_n[home] > 1)]

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, visits: int = VISITS, probes: int = PROBES,
                    block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Two rows link when their cosine, in doubles, is ``threshold`` or more; n_links counts the other rows linked directly, component_id is
    the smallest vec_id reachable, kept tells whether it is the row's own. No link is below the threshold; what may be missing are links between
    vectors of which neither visits the other's cell (recall is measured against brute force in the tests).

    Spherical k-means in two levels (``fit_cells``) puts every vector into its nearest cell, and as a visitor into the next ``visits`` ones,
    where some vector of such a cell can be near enough by the angles. Each cell's vectors are compared with one another and its
    visitors in blocked cosine products of bounded size. Vectors nearer to their centroid than half the threshold's angle are the cell's core: they
    are linked with one another by the triangle inequality, so a large group of near copies costs a sum, not its pairs. Equal vectors are one row
    with a weight throughout. Tasks return a count and a first neighbour per row, never pairs; stars over these give the components.

    Null, zero or empty vectors and those with null or non-finite components link with nothing and keep their own vec_id. Vectors of
    unequal length count as filled up with zeros. A null vec_id takes part and has its component's smallest id. Repeated rows are rows
    of their own, linked with each other. Other columns are not looked at. No rows: no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    kind = "float32" if dict(vectors.dtypes)["embedding"] == "array<float>" else "float64"
    folder = scratch(spark, "vectors")
    rows = vectors.select("vec_id", packed(F.col("embedding"), kind).alias("vec")).select("vec_id", "vec", F.unhex(F.md5("vec")).alias("key"))
    distinct = stored(rows.where("vec is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("vec_id").alias("least")),
                      f"{folder}/distinct")
    cells = fit_cells(distinct, kind, cell_rows=cell_rows)
    n_cells, half = int(cells.starts()[-1]), math.acos(threshold) / 2
    core = math.cos(half) + MARGIN
    schema = "key binary, vec binary, weight long, least " + dict(vectors.dtypes)["vec_id"] + ", id long, home long, sim double, core boolean, cells array<long>, sims array<double>"
    assigned = stored(distinct.withColumn("id", F.monotonically_increasing_id()).mapInPandas(lean(_assigned(cells, kind, core, visits, probes)), schema), f"{folder}/assigned")
    drop_folder(spark, f"{folder}/distinct")

    # at most a row per cell comes to the driver
    known = (assigned.groupBy("home").agg(F.min("sim").alias("sim"), F.count_if("core").alias("core_n"), F.count("*").alias("n"), F.sum(F.when(F.col("core"), F.col("weight"))).alias("weight"),
                                          F.min(F.when(F.col("core"), F.col("id"))).alias("id")).toPandas())

    def per_cell(values, kind=np.int64, empty=0) -> np.ndarray:
        out = np.full(n_cells, empty, kind)
        out[known["home"].to_numpy(np.int64)] = values
        return out

    n_core = known["core_n"].to_numpy(np.int64)
    reach = np.arccos(np.clip(known["sim"].to_numpy(float), -1, 1)) + 2 * half
    plan = Plan(per_cell(reach, float, -1.0), per_cell(n_core), per_cell(known["weight"].fillna(0).astype("int64")), per_cell(known["id"].fillna(0).astype("int64")),
                per_cell(known["n"].to_numpy(np.int64) - n_core), np.zeros(n_cells, np.int64))
    if visits:
        guests = assigned.select("cells", "sims").mapInPandas(lean(_visitors(plan, visits)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        for r in guests:
            plan.visitors[r["cell"]] = r["n"]

    units = assigned.select("id", "vec", "weight", "core", "home", "cells", "sims").mapInPandas(lean(_units(plan, visits, block)), UNIT)
    links = "id long, links long, first long"
    compared = units.groupBy("cell", "p", "q").applyInPandas(_compared(kind, threshold), links)
    inside = assigned.where("core").select("id", "weight", "home").mapInPandas(lean(_core_links(plan)), links)
    found = stored(compared.unionByName(inside), f"{folder}/links")

    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("u"), F.col("first").alias("v")))
    a, c, r = assigned.select("id", "key", "weight", "least").alias("a"), counted.alias("c"), roots.alias("r")
    each = (a.join(c, F.col("a.id") == F.col("c.id"), "left").join(r, F.col("a.id") == F.col("r.node"), "left")
            .select("a.key", "a.least", (F.coalesce("c.links", F.lit(0)) + F.col("a.weight") - 1).alias("n_links"), F.coalesce("r.root", "a.id").alias("root")))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = each.join(least, "root").select("key", "n_links", "component_id")
    v, k = rows.select("vec_id", "key").alias("v"), classes.alias("k")
    component = F.when(F.col("k.key").isNull(), F.col("v.vec_id")).otherwise(F.col("k.component_id"))
    return v.join(k, F.col("v.key") == F.col("k.key"), "left").select(
        "v.vec_id", F.coalesce("k.n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("v.vec_id")).alias("kept"))


def one_of_each(vectors: DataFrame, **options) -> DataFrame:
    """The ids of ``vectors`` that stay: one of each group, that with the smallest vec_id, and all that link with nothing."""
    return near_duplicates(vectors, **options).where("kept").select("vec_id")
