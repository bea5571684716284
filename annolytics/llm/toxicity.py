"""A toxicity classifier whose score is held steady when identity terms are swapped."""
from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, lean, scratch, stored, text_of

MAX_ROWS, MIN_DOCS, MIN_Z = 8_000, 3, 4.0
MAX_TERMS, TERM_DOCS, EVEN_Z, ALIKE, GROUP_SIZE, CONTEXTS = 512, 5, 1.0, 0.5, 4, 64  # of groups that are found in the sample
RIDGE, STEADY, STEPS = 1e-4, 1.0, 400
THRESHOLD = 0.7
SHORT, LONG = 3, 8
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
# Groups of identity terms that can stand for one another
IDENTITY = (("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
            ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
            ("gay", "straight", "lesbian", "bisexual"), ("black", "white", "asian", "latino"), ("africans", "europeans", "asians"),
            ("immigrant", "native"), ("immigrants", "natives"), ("young", "old"), ("deaf", "hearing"), ("transgender", "cisgender"))


def features(word: str) -> list[str]:
    """What a lower-case word tells: itself and its beginnings, which catch inflected and compound forms."""
    return [word + "$", *(word[:k] for k in range(SHORT, min(LONG, len(word)) + 1))]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def turns(groups) -> dict[str, tuple[tuple[str, ...], int]]:
    """Each term with its group and its place there; a term of several groups belongs to the first."""
    found: dict[str, tuple[tuple[str, ...], int]] = {}
    for group in groups:
        for i, term in enumerate(group):
            found.setdefault(term, (tuple(group), i))
    return found


def swapped(sentence: str, groups=IDENTITY, by: int = 1) -> str | None:
    """The sentence, lower-cased, with each term turned to the one ``by`` places on in its group; null without such a term."""
    low, turn = sentence.lower(), turns(groups)

    def other(m) -> str:
        group, i = turn.get(m[0], ((m[0],), 0))
        return group[(i + by) % len(group)]

    out = WORD.sub(other, low)
    return out if out != low else None


@dataclass(frozen=True)
class Model:
    """Weights of features and the bias; the groups of terms that it was held steady over, and how many swaps of sentences changed its features."""

    weights: dict[str, float]
    bias: float
    groups: tuple[tuple[str, ...], ...] = ()
    swaps: int = 0

    def starts(self) -> frozenset[str]:
        """The first letters of words that have a weight."""
        return frozenset(f.rstrip("$")[:SHORT] for f in self.weights)

    def score(self, words: set[str], starts: frozenset[str]) -> float:
        found = {f for word in words if word[:SHORT] in starts for f in features(word) if f in self.weights}
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled ids that ``docs`` has, the first by hash, a row per id: of several texts of an id
    the least. A label given twice is toxic if one of them is."""
    here = docs.where("doc_id is not null").select("doc_id").distinct()
    ids = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
           .join(here, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def frame() -> pd.DataFrame:
        rows = [(f, counts[0][f], counts[1][f]) for f in counts[0].keys() | counts[1].keys()]
        return pd.DataFrame(rows, columns=["feature", "clean", "toxic"])

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            counts[int(label > 0)].update({f for w in words_of(text) for f in features(w)})
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield frame()
                counts = (Counter(), Counter())
    yield frame()


def _contexts(terms: list[str], frequent: list[str]):
    """How often each term has one of the frequent words before or after it."""
    known, near = set(terms), set(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                words = WORD.findall(text.lower())
                for i, w in enumerate(words):
                    if w in known:
                        if i and words[i - 1] in near:
                            counts[w, "<" + words[i - 1]] += 1
                        if i + 1 < len(words) and words[i + 1] in near:
                            counts[w, ">" + words[i + 1]] += 1
        yield pd.DataFrame([(t, c, n) for (t, c), n in counts.items()], columns=["term", "context", "n"])

    return run


def alike_groups(terms: list[str], rows: list[tuple[str, str, int]], size: int = GROUP_SIZE, alike: float = ALIKE) -> tuple[tuple[str, ...], ...]:
    """Terms put together by their contexts (term, context, n): each free term, in order, with the free ones most like it, up to ``size``."""
    contexts = {c: i for i, c in enumerate(sorted({c for _, c, _ in rows}))}
    x, place = np.zeros((len(terms), max(1, len(contexts)))), {t: i for i, t in enumerate(terms)}
    for term, context, n in rows:
        x[place[term], contexts[context]] = math.sqrt(n)
    norm = np.sqrt((x * x).sum(1))
    x /= np.maximum(norm, 1e-300)[:, None]
    free, groups = norm > 0, []
    for i in range(len(terms)):
        if free[i]:
            free[i] = False
            sims = np.where(free, x @ x[i], -1.0)
            near = [int(k) for k in np.argsort(-sims, kind="stable")[:size - 1] if sims[k] >= alike]
            if near:
                free[near] = False
                groups.append((terms[i], *(terms[k] for k in near)))
    return tuple(groups)


def neutral_groups(sample: DataFrame, counted: DataFrame, z, place: dict[str, int]) -> tuple[tuple[str, ...], ...]:
    """Groups of interchangeable neutral terms of the sample, for prose that the stated terms do not cover.

    Neutral are words that both classes use about evenly (under ``EVEN_Z`` standard errors apart, in ``TERM_DOCS`` texts at least). Half of
    ``MAX_TERMS`` are the most used ones with a feature of the classifier, which they share with words that tell: on these the score wrongly hangs. The
    other half are the most used ones at all. Terms with like words beside them, of the ``CONTEXTS`` most used words, make a group."""
    words = counted.where(F.col("feature").endswith("$")).select(F.expr("substring(feature, 1, length(feature) - 1)").alias("word"), (F.col("clean") + F.col("toxic")).alias("docs"), z.alias("z"))
    most = [F.col("docs").desc(), "word"]
    even = [r["word"] for r in words.where((F.abs("z") < EVEN_Z) & (F.col("docs") >= TERM_DOCS) & (F.length("word") >= SHORT)).orderBy(*most).collect()]
    telling = [w for w in even if any(f in place for f in features(w))][:MAX_TERMS // 2]
    rest = set(telling)
    terms = [t for pair in itertools.zip_longest(telling, [w for w in even if w not in rest][:MAX_TERMS // 2]) for t in pair if t is not None]
    frequent = [r["word"] for r in words.orderBy(*most).limit(CONTEXTS).collect()]
    rows = sample.mapInPandas(lean(_contexts(terms, frequent)), "term string, context string, n long").groupBy("term", "context").agg(F.sum("n").alias("n")).collect()
    return alike_groups(terms, [(r["term"], r["context"], r["n"]) for r in rows])


def _fit(x: list[np.ndarray], y: np.ndarray, apart: list[tuple[np.ndarray, np.ndarray, int]], n: int, ridge: float, steady: float, steps: int) -> np.ndarray:
    """Weights of a logistic regression with a squared penalty on weights and on the change of the score under swaps.

    ``x``: the features of each text; ``apart``: the features that only a sentence has, those that only its swapped form has, and how many
    swaps change just these."""
    rows = np.repeat(np.arange(len(x)), [len(v) for v in x])
    cols = np.concatenate(x) if len(rows) else np.zeros(0, int)
    pairs = np.repeat(np.arange(len(apart)), [len(a) + len(b) for a, b, _ in apart])
    pair_cols = np.concatenate([np.concatenate(p[:2]) for p in apart]) if len(pairs) else np.zeros(0, int)
    signs = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b, _ in apart]) if len(pairs) else np.zeros(0)
    share = np.array([c for *_, c in apart], dtype=float) / max(1, sum(c for *_, c in apart))
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    base = (y.sum() + 1) / (len(y) + 2)
    w[n] = math.log(base / (1 - base))
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(x)) + w[n]
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g = np.append(np.bincount(cols, error[rows], n), error.sum())
        g[:n] += ridge * w[:n]
        if len(apart):
            g[:n] += penalty_gradient(w, pairs, pair_cols, signs, share, n, steady)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w


def penalty_gradient(w: np.ndarray, pairs: np.ndarray, cols: np.ndarray, signs: np.ndarray, share: np.ndarray, n: int, steady: float) -> np.ndarray:
    """The gradient of ``steady`` times the mean squared change of the score's exponent over swaps."""
    change = np.bincount(pairs, signs * w[cols], len(share)) * share
    return 2 * steady * np.bincount(cols, signs * change[pairs], n)


def _whole_texts(place: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(int(label > 0), sorted({place[f] for w in words_of(text) for f in features(w) if f in place}))
                                for text, label in zip(batch["text"], batch["label"])], columns=["label", "here"])

    return run


def _changes(place: dict[str, int], groups):
    """What swaps do to the features of sentences: the features lost and won, and how often, for each way to turn all terms of a
    sentence on by as many places. Sentences whose terms and all that these turn to have no features are passed over."""
    own = lambda w: frozenset(place[f] for f in features(w) if f in place)
    turn = {t: g for t, g in turns(groups).items() if any(own(x) for x in g[0])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        memo: dict[str, frozenset] = {}

        def of(word: str) -> frozenset:
            if len(memo) > 150_000:
                memo.clear()
            got = memo.get(word)
            if got is None:
                got = memo[word] = own(word)
            return got

        for batch in batches:
            for text in batch["text"]:
                for sentence in SENTENCE.findall(text.lower()):
                    words = set(WORD.findall(sentence))
                    terms = [w for w in words if w in turn]
                    if not terms:
                        continue
                    rest = frozenset().union(*(of(w) for w in words if w not in turn))
                    here = rest.union(*(of(w) for w in terms))
                    for by in range(1, max(len(turn[w][0]) for w in terms)):
                        there = rest.union(*(of(turn[w][0][(turn[w][1] + by) % len(turn[w][0])]) for w in terms))
                        if here != there:
                            counts[tuple(sorted(here - there)), tuple(sorted(there - here))] += 1
        yield pd.DataFrame([(list(a), list(b), n) for (a, b), n in counts.items()], columns=["lost", "won", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, ridge: float = RIDGE,
          steady: float = STEADY, steps: int = STEPS, groups=IDENTITY, derive: bool = True) -> Model:
    """Fits the classifier on at most ``max_rows`` labelled documents (the documented bound; texts whole).

    Features are words and their beginnings: those in ``min_docs`` or more of the sample that differ between the classes by ``min_z`` standard
    errors or more. In each sentence of the sample with terms of ``groups`` (lower-case words that can stand for one another) all terms
    are turned to each other place of their groups; ``steady`` weighs the mean squared change of the score's exponent over all swaps
    that change a feature against the usual loss. With ``derive`` the groups of neutral words that the sample itself shows
    (``neutral_groups``) are added, so that the penalty also acts on prose, or in languages, that the stated terms do not reach. Swaps with the
    same effect are one row with a count; none is left out. Null labels and labels without a document are left out. Without
    labelled rows, or with one class only, the model is its bias.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "labelled")
    sample = stored(labelled_sample(docs, labels, max_rows), f"{folder}/sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1 = sum(n for label, n in sizes.items() if label > 0)
    n0 = sum(sizes.values()) - n1
    if not n0 or not n1:
        base = (n1 + 1) / (n0 + n1 + 2)
        return Model({}, math.log(base / (1 - base)))
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(n0 + n1))
    z = (F.col("toxic") / F.lit(float(n1)) - F.col("clean") / F.lit(float(n0))) / F.sqrt(share * (F.lit(1.0 + 1e-9) - share) * F.lit(1 / n1 + 1 / n0))
    counted = stored(sample.mapInPandas(lean(_counted), "feature string, clean long, toxic long").groupBy("feature")
                     .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= min_docs), f"{folder}/counted")
    chosen = counted.where(F.abs(z) >= min_z).select("feature").collect()
    place = {f: i for i, f in enumerate(sorted(r["feature"] for r in chosen))}
    whole = sample.mapInPandas(lean(_whole_texts(place)), "label int, here array<int>").collect()
    whole.sort(key=lambda r: (r["label"], r["here"]))  # the sum of gradients does not depend on the order of tasks
    x = [np.array(r["here"], dtype=int) for r in whole]
    used = tuple(tuple(g) for g in groups) + (neutral_groups(sample, counted, z, place) if derive else ())
    changed = sample.mapInPandas(lean(_changes(place, used)), "lost array<int>, won array<int>, n long").groupBy("lost", "won").agg(F.sum("n").alias("n")).collect()
    drop_folder(spark, folder)
    changed.sort(key=lambda r: (r["lost"], r["won"]))
    apart = [(np.array(r["lost"], dtype=int), np.array(r["won"], dtype=int), r["n"]) for r in changed]
    w = _fit(x, np.array([r["label"] for r in whole], dtype=float), apart, len(place), ridge, steady, steps)
    return Model({f: float(w[i]) for f, i in place.items()}, float(w[-1]), used, sum(n for *_, n in apart))


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), whole texts, in one narrow pass.

    A null or empty text scores as the bias says. Input columns of these two names are replaced. No documents: no rows."""
    def scored(texts: pd.Series) -> pd.Series:
        starts = model.starts()
        return pd.Series([model.score(words_of(t), starts) for t in texts], dtype=float)

    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = docs.select(*[F.col(f"`{c}`") for c in columns], F.pandas_udf(scored, "double")(text_of("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
