"""Exact Jaccard join of word n-gram sets with adaptive prefixes that must match several times."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, drop_folder, lean, scratch, stored, text_key, text_of
from .components import components
from .url_filter import possible_hits

HOT_TOKENS, HOT_DOCS = 1 << 17, 8
MAX_MATCHES = 4
BINS, BAND_BINS = 64, 6  # of the sketch by which near copies find a common centre
CHECK_COST = 50.0  # of a verification, in postings read
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x1F123BB5) for k in range(64)]
KEEP_WORDS = 150_000
LANES = 8  # of 64 bits, in a signature
ROW = ["token", "id", "n", "at", "before", "matches", *(f"s{i}" for i in range(LANES))]


class Shingler:
    """The set of distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.memo = n, {}

    def _hash(self, word: bytes) -> int:
        import xxhash
        if len(self.memo) > KEEP_WORDS:
            self.memo.clear()
        h = self.memo[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def set_of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        memo, hashed = self.memo, self._hash
        a = np.array([memo.get(w) or hashed(w) for w in words], dtype=np.uint64)
        span = min(self.n, len(a))
        h = np.full(len(a) - span + 1, span, np.uint64)
        for k in range(span):
            h = h + a[k:len(a) - span + 1 + k] * MIX[k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return np.unique(h)


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def signature(tokens: np.ndarray) -> np.ndarray:
    """For each of 512 classes of tokens, whether an odd number of the set is in it: two sets differ in at least as many
    tokens as their signatures do in bits."""
    odd = np.bincount((tokens & np.uint64(64 * LANES - 1)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(tokens: np.ndarray) -> np.ndarray:
    """Hashes of runs of bins of the set's sketch: the least token of each of 64 classes of tokens. Two similar sets agree in a
    bin about as often as they are similar, so sets of 90% share one of the ten bands but for one pair in two thousand."""
    sketch = np.zeros(BINS, np.uint64)
    classes, first = np.unique(tokens & np.uint64(BINS - 1), return_index=True)  # tokens are sorted: the first of a class is its least
    sketch[classes.astype(np.int64)] = tokens[first]
    runs = sketch[:BINS // BAND_BINS * BAND_BINS].reshape(-1, BAND_BINS)
    h = np.arange(1, len(runs) + 1, dtype=np.uint64)
    for column in runs.T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h[runs.any(1)]


def need(n, percent: int):
    """The smallest number of shared tokens that a set of size n needs to be similar to any set."""
    return -(-n * percent // 100)


def _counted(n: int, percent: int):
    """Rows of documents (doc_id, key, set_key, n) and, between them, tokens that several different sets of the task share in
    the part of the sets from which prefixes are taken. Sets met twice count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen, waiting, held = Shingler(n), set(), [], 0

        def shared() -> pd.DataFrame:
            tokens, counts = np.unique(np.concatenate(waiting) if waiting else np.zeros(0, np.uint64), return_counts=True)
            several = counts > 1
            return pd.DataFrame({"doc_id": pd.array([None] * int(several.sum()), dtype="Int64"), "key": None, "set_key": None, "n": 0,
                                 "token": tokens[several].view(np.int64), "docs": counts[several].astype(np.int64)})

        for batch in batches:
            keys, sizes = [], []
            for text in batch["text"]:
                tokens = shingler.set_of(text)
                key = set_key(tokens)
                keys.append(key)
                sizes.append(len(tokens))
                if key not in seen:
                    seen.add(key)
                    low = tokens[:2 * (len(tokens) - need(len(tokens), percent)) + 16].copy()
                    waiting.append(low)
                    held += len(low)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "set_key": keys, "n": sizes,
                                "token": pd.array([None] * len(keys), dtype="Int64"), "docs": 0})
            if held > 3_000_000:
                yield shared()
                waiting, held, seen = [], 0, set()
        yield shared()

    return run


def _prefixes(n: int, percent: int, hot: np.ndarray, rank: np.ndarray, most: int):
    """(set_key, n, signature, bands, prefix) of each text: the first tokens of its set in the global order, which puts hot tokens last, the
    hottest at the end, and sorts all others by hash. Enough of them for ``most`` matches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = Shingler(n), set()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = shingler.set_of(text)
                key = set_key(tokens)
                if not len(tokens) or key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                size = len(tokens)
                want = min(size, size - need(size, percent) + most)
                bits, sketch = signature(tokens), bands(tokens).view(np.int64)
                if len(hot):
                    at = np.searchsorted(hot, tokens)
                    at[at == len(hot)] = 0
                    known = hot[at] == tokens
                    rest = tokens[known]
                    tokens = np.concatenate([tokens[~known], rest[np.argsort(rank[at[known]])]])
                rows.append((key, size, bits, sketch, tokens[:want].view(np.int64)))
            yield pd.DataFrame(rows, columns=["set_key", "n", "signature", "bands", "prefix"])

    return run


def _verified(n: int, percent: int):
    """Of pairs (a, b, left, right) those whose sets are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, memo = Shingler(n), {}

        def tokens(text: str) -> np.ndarray:
            got = memo.get(text)
            if got is None:
                if len(memo) > 200:
                    memo.clear()
                got = memo[text] = shingler.set_of(text)
            return got

        for batch in batches:
            good = []
            for left, right in zip(batch["left"], batch["right"]):
                x, y = tokens(left), tokens(right)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.loc[good, ["u", "v"]]

    return run


class JaccardJoin:
    """The join over ``docs`` (doc_id, text): ``rows`` (doc_id, key, set id, size) and ``classes`` (set id, root)."""

    def __init__(self, docs: DataFrame, *, n: int = 5, percent: int = 80, most: int = MAX_MATCHES):
        self.spark, self.n, self.percent, self.most = docs.sparkSession, n, percent, most
        self.folder = scratch(self.spark, "jaccard")
        text = text_of("text")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
        seen = stored(self.docs.mapInPandas(lean(_counted(n, percent)), "doc_id long, key binary, set_key binary, n long, token long, docs long"),
                      f"{self.folder}/seen")
        self.rows = seen.where("set_key is not null").select("doc_id", "key", "set_key", "n")
        # one row per distinct set: its id in this run, the text that stands for it, its smallest doc_id
        self.sets = stored(self.rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"))
                           .select("*", F.monotonically_increasing_id().alias("id")), f"{self.folder}/sets")
        self._prefix(seen)
        self.classes = self._links()

    def _prefix(self, seen: DataFrame) -> None:
        """``tokens``: a row (see ``ROW``) for each token of an adaptive prefix that other sets have in theirs; ``before``
        counts such tokens at earlier places."""
        hot = (seen.where("token is not null").groupBy("token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= HOT_DOCS)
               .orderBy(F.col("docs").desc(), "token").limit(HOT_TOKENS).toPandas())
        values = hot["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(values)
        rank = np.lexsort((values, hot["docs"].to_numpy(np.int64)))
        place = np.empty(len(values), np.int64)
        place[rank] = np.arange(len(values))
        prefixes = (self.docs.select("text").mapInPandas(lean(_prefixes(self.n, self.percent, values[order], place[order], self.most)),
                                                         "set_key binary, n long, signature array<long>, bands array<long>, prefix array<long>")
                    .groupBy("set_key").agg(*[F.first(c).alias(c) for c in ("signature", "bands", "prefix")]))
        packed = stored(prefixes.join(self.sets.select("set_key", "id", "n"), "set_key").select("id", "n", "signature", "bands", "prefix"), f"{self.folder}/prefixes")
        whole = packed.select("id", "n", F.posexplode("prefix").alias("at", "token"))
        counts = whole.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
        common = whole.join(counts, "token")
        base = F.col("n") - F.expr(f"(n * {self.percent} + 99) div 100")
        limit = F.least(F.lit(self.most), F.expr(f"(n * {self.percent} + 99) div 100"))
        postings = [F.sum(F.when(F.col("at") < base + k, F.col("docs") - 1).otherwise(0)).alias(f"c{k}") for k in range(1, self.most + 1)]
        # cost of k matches: postings read, and an upper bound of the candidates, each of which has k of them
        cost = lambda k: F.col(f"c{k}") * F.lit(1 + CHECK_COST / k)
        options = F.array(*[F.when(F.lit(k) <= limit, F.struct(cost(k).alias("cost"), F.lit(k).alias("k"))) for k in range(1, self.most + 1)])
        chosen = (common.groupBy("id", "n").agg(*postings)
                  .select("id", F.array_min(F.filter(options, lambda x: x.isNotNull()))["k"].alias("matches")))
        placed = common.withColumn("before", F.row_number().over(W.partitionBy("id").orderBy("at")) - 1)
        kept = placed.join(chosen, "id").where(F.col("at") < base + F.col("matches"))
        bits = packed.select("id", *[F.element_at("signature", i + 1).alias(f"s{i}") for i in range(LANES)])
        self.tokens = stored(kept.join(bits, "id").select(*ROW), f"{self.folder}/tokens")
        self.sketches = packed.select("id", "n", "bands")

    def _similar_at_most(self, top: Column, n: Column, m: Column) -> Column:
        return F.lit(100) * top >= F.lit(self.percent) * (n + m - top)

    def _possible(self) -> Column:
        """Whether the sets of rows a and b, which share this token, can be similar. What they share before it stands in both
        prefixes, so it is among the tokens there that more than one set has; what they share after it is in both rests. And
        they differ in as many tokens at least as their signatures differ in bits."""
        c = F.col
        by_place = F.least(c("a.before"), c("b.before")) + F.least(c("a.n") - c("a.at"), c("b.n") - c("b.at"))
        differing = [F.bit_count(c(f"a.s{i}").bitwiseXOR(c(f"b.s{i}"))) for i in range(LANES)]
        by_bits = F.shiftright(c("a.n") + c("b.n") - sum(differing[1:], differing[0]), 1)
        return self._similar_at_most(F.least(by_place, by_bits), c("a.n"), c("b.n"))

    def _candidates(self, incidences: DataFrame) -> DataFrame:
        """Pairs (u, v) of joined rows a and b that share as many prefix tokens as the shorter prefix asks for, and are not too
        different by the place of the last of them."""
        c = F.col
        first = lambda e, name: F.first(e).alias(name)
        return (incidences.select(c("a.id").alias("u"), c("b.id").alias("v"), c("a.n").alias("n"), c("b.n").alias("m"), c("a.at").alias("i"), c("b.at").alias("j"),
                                  F.least("a.matches", "b.matches").alias("asked"))
                .groupBy("u", "v").agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), first("n", "n"), first("m", "m"), first("asked", "asked"))
                .where(F.col("shared") >= F.col("asked"))
                .where(self._similar_at_most(F.col("shared") + F.least(c("n") - c("i"), c("m") - c("j")) - 1, c("n"), c("m"))).select("u", "v"))

    def _similar(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) that are links. Texts of the sets in question come from the documents once."""
        pairs = stored(pairs, f"{self.folder}/{name}-pairs")
        wanted = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct().join(self.sets.select("id", "key"), "id")
        wanted = stored(wanted, f"{self.folder}/{name}-wanted")
        near = possible_hits(self.docs.select("key", "text"), wanted.select("key")).where("possible")
        texts = near.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("id", "text")
        texts = stored(texts, f"{self.folder}/{name}-texts")
        left = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("left")), "u")
        both = left.join(texts.select(F.col("id").alias("v"), F.col("text").alias("right")), "v")
        links = stored(both.select("u", "v", "left", "right").mapInPandas(lean(_verified(self.n, self.percent)), "u long, v long"), f"{self.folder}/{name}-links")
        drop_folder(self.spark, f"{self.folder}/{name}-texts")
        return links

    def _links(self) -> DataFrame:
        """Links that connect the components of the join, found in two steps.

        First each set is tested against the centre of each of its bands, another in each, that sets which share most of their tokens have in common. That
        ties groups of near copies with at most ten tests a row, however large they are. The second step is exact: it takes every pair
        that shares as many prefix tokens as the shorter of its prefixes asks for and that the first has not put in
        one component. What it leaves out cannot be linked, or is in one component already."""
        rows = self.sketches.select("id", "n", F.explode("bands").alias("band"))
        centre = (rows.groupBy("band").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("band", "id").alias("h"), "id", "n")).alias("o"))
                  .where("c > 1").select("band", F.col("o.id").alias("centre"), F.col("o.n").alias("m")))
        met = rows.join(centre, "band").where((F.col("id") != F.col("centre")) & self._similar_at_most(F.least("n", "m"), F.col("n"), F.col("m")))
        stars = components(self._similar(met.select(F.greatest("id", "centre").alias("u"), F.least("id", "centre").alias("v")).distinct(), "star"))
        drop_folder(self.spark, f"{self.folder}/prefixes")
        rows = self._open(stars)
        met = rows.alias("a").join(rows.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.id") > F.col("b.id"))
                                   & (F.col("a.root") != F.col("b.root")) & self._possible())
        found = self._similar(self._candidates(met), "all")
        return components(found.unionByName(stars.select(F.col("node").alias("u"), F.col("root").alias("v"))))

    def _open(self, stars: DataFrame) -> DataFrame:
        """Prefix tokens that sets of two or more components share, with the component of each row."""
        rows = self.tokens.join(stars, self.tokens["id"] == stars["node"], "left").select(*self.tokens.columns, F.coalesce("root", "id").alias("root"))
        several = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
        return stored(rows.join(several, "token", "left_semi"), f"{self.folder}/open")

    def _rooted(self) -> DataFrame:
        """(set_key, root, doc_id, key): each distinct set with its component."""
        return self.sets.join(self.classes, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("root", "id").alias("root"), "doc_id", "key")

    def labelled(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        sets = self._rooted()
        least = sets.groupBy("root").agg(F.min("doc_id").alias("component"))
        named = sets.join(least, "root").select("set_key", "component")
        r, s = self.rows.alias("r"), named.alias("s")
        return r.join(s, F.col("r.set_key") == F.col("s.set_key"), "left").select(
            "r.doc_id", F.col("r.n").alias("n_shingles"), F.when(F.col("r.n") > 0, F.col("s.component")).otherwise(F.col("r.doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    A document's set are its distinct shingles of ``n`` words (A-Z lowered; with fewer words the whole sequence is one). Two
    documents link when the Jaccard similarity of their sets is ``percent`` or more; component_id is the smallest doc_id reachable.

    Method: all tokens have one global order, those that many sets share last. Two similar sets share k tokens of their first
    n - ceil(percent * n) + k; each set chooses its own k by the postings that its longer prefix costs and the verifications that
    asking for more matches saves. A pair is a candidate if it shares as many prefix tokens as the smaller k of the two. Bounds
    by size, place, tokens that no other prefix has and 512-bit signatures are part of the join's condition, and lose
    no link; what passes is verified on the whole texts.

    Equal sets are one class throughout, so that copies are never paired; large groups of near copies are first tied to
    centres, and only pairs between components are looked at by the exact join, see ``_links``.

    Null or empty texts, and those without words, have no shingles, link with nothing and keep their own doc_id. A null doc_id takes part in
    links and has its component's smallest id; a component without any id has none. Repeated rows each get a row. Columns other
    than doc_id and text are not looked at. No documents: no rows.
    """
    return JaccardJoin(docs, **options).labelled()


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component of near duplicates, that with the smallest doc_id; rows without words all stay.

    A text moves once, to the one row per distinct text; which of these stay is a semi-join on the same key."""
    sets = JaccardJoin(docs, **options)._rooted()
    chosen = sets.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")).alias("c")).select(F.col("c.key").alias("key"))
    text = text_of("text")
    rows = docs.select(text_key(text).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (F.btrim(text, F.lit(BLANKS)) == "").alias("empty"))
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"))
    distinct = rows.where("not empty").groupBy("key").agg(F.min_by("row", order).alias("row"))
    return distinct.join(chosen, "key", "left_semi").select("row.*").unionByName(rows.where("empty").select("row.*"))
