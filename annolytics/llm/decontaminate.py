"""Benchmark passages in training texts, by spaced seeds that tolerate substituted words."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, stored, text_of

# The masks; a 1 is a word that must agree
MASKS = ("1110111", "11011011", "1101010111")
MIN_ITEM, MIN_OVERLAP, MIN_AGREE = 6, 13, 0.75
BLOOM_BITS = 1 << 24
CONTEXT = 64
TOKENS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
KEEP_WORDS, CHUNK_WORDS = 150_000, 300_000
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Hasher:
    """Words of a text as 64-bit hashes: runs of ASCII letters and digits and of other characters beyond ASCII, lower-cased."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        import xxhash
        if len(self.memo) > KEEP_WORDS:
            self.memo.clear()
        h = self.memo[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def words(self, text: str) -> np.ndarray:
        memo, hashed = self.memo, self._hash
        return np.array([memo.get(w) or hashed(w) for w in text.lower().encode("utf-8", "surrogatepass").translate(TOKENS).split()], dtype=np.uint64)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash per place of the words that the mask keeps, for every place where it fits."""
    fit = len(words) - len(mask) + 1
    if fit <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(fit, int(mask, 2) * 2 + 1, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ words[i:i + fit]) * M1
            h ^= h >> np.uint64(32)
    return h * M2


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """Three places of each hash in the filter's bits."""
    return [((h >> np.uint64(s)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for s in (0, 20, 40)]


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of hashes that the filter has."""
    left = np.arange(len(h))
    for shift in (0, 20, 40):
        slot = ((h[left] >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)
        left = left[((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)]
    return left


def item_seeds(n: int, masks: tuple[str, ...]) -> list[str]:
    """The masks for an item of n words: those that fit, or where none does the whole item."""
    return [m for m in masks if len(m) <= n] or ["1" * n]


def _item_rows(masks: tuple[str, ...], min_item: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            rows = []
            for item_id, text in zip(batch["item_id"], batch["text"]):
                words = hasher.words(text)
                if len(words) < min_item:
                    continue
                for mask in item_seeds(len(words), masks):
                    h = seeds(words, mask).view(np.int64)
                    rows.extend((item_id, words.view(np.int64), mask, int(x), at) for at, x in enumerate(h))
            yield pd.DataFrame(rows, columns=["item_id", "words", "mask", "seed", "item_at"])

    return run


def _filter_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(BLOOM_BITS >> 3, np.uint8)
    masks: set[str] = set()
    for batch in batches:
        masks.update(batch["mask"])
        for slot in _slots(batch["seed"].to_numpy(np.int64).view(np.uint64)):
            np.bitwise_or.at(bits, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
    at = np.nonzero(bits)[0]
    yield pd.DataFrame({"at": at.astype(np.int64), "bits": bits[at].astype(np.int32)})


def _hits(bits: np.ndarray, masks: tuple[str, ...], texts: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """(place, seed) of the windows of each text that the filter has, in order. The texts are laid end to end and hashed at
    once; windows over an end are dropped."""
    ends = np.cumsum([len(t) for t in texts])
    words = np.concatenate(texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for mask in masks:
        h = seeds(words, mask)
        at = _maybe(bits, h)
        text = np.searchsorted(ends, at, side="right")
        inside = at + len(mask) <= ends[text]
        for p, t, x in zip(at[inside], text[inside], h[at[inside]].view(np.int64)):
            out[t].append((int(p - ends[t]) + len(texts[t]), int(x)))
    for found in out:
        found.sort()
    return out


def _regions(bits: np.ndarray, masks: tuple[str, ...], around: int):
    """Places of texts that hit the filter, close ones together in one region with ``around`` words before and after."""

    def grouped(doc_id, key, words: np.ndarray, found: list[tuple[int, int]]) -> Iterator[tuple]:
        group: list[tuple[int, int]] = []
        for hit in [*found, None]:
            if group and (hit is None or hit[0] - group[-1][0] > CONTEXT or len(group) >= 4096):
                start = max(0, group[0][0] - around)
                yield doc_id, key, start, words[start:group[-1][0] + around].view(np.int64), [p - start for p, _ in group], [x for _, x in group]
                group = []
            if hit:
                group.append(hit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            rows, waiting, held = [], [], 0

            def flush():
                for (doc_id, key, words), found in zip(waiting, _hits(bits, masks, [w for *_, w in waiting])):
                    if found:
                        rows.extend(grouped(doc_id, key, words, found))

            for doc_id, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                words = hasher.words(text)
                if len(words):
                    waiting.append((doc_id, key, words))
                    held += len(words)
                if held > CHUNK_WORDS:
                    flush()
                    waiting, held = [], 0
            if waiting:
                flush()
            yield pd.DataFrame(rows, columns=["doc_id", "key", "start", "words", "at", "seed"]).astype({"doc_id": "Int64"})

    return run


def best_segment(agree: np.ndarray) -> tuple[int, int]:
    """The stretch [from, to) with the greatest excess of agreeing words, three disagreements outweighing nine agreements."""
    total = best = start = 0
    out = (0, 0)
    for i, same in enumerate(agree):
        total += 1 if same else -3
        if total <= 0:
            total, start = 0, i + 1
        elif total > best:
            best, out = total, (start, i + 1)
    return out


def longest_overlap(agree: np.ndarray, min_agree: float) -> tuple[int, int]:
    """The longest stretch [from, to) of which ``min_agree`` agree; of equal ones the one with most agreeing words, then the first."""
    same = np.r_[0, np.cumsum(agree)]
    excess = same - min_agree * np.arange(len(same))
    # for each end the first start with no greater excess: the running minimum falls to it there
    first = np.searchsorted(-np.minimum.accumulate(excess), -(excess + 1e-9))
    size = np.arange(len(same)) - first
    last = int(np.lexsort((first, -(same - same[first]), -size))[0])
    return int(first[last]), last


def _checked(min_overlap: int, min_agree: float):
    """Overlaps around hits: region and item are laid over each other at the hit, words may be substituted, none left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, key, item_id, start, words, item, at, item_at in zip(*(batch[c] for c in ("doc_id", "key", "item_id", "start", "words", "item", "at", "item_at"))):
                shift = int(at) - int(item_at)
                low, high = max(0, -shift), min(len(item), len(words) - shift)
                agree = np.asarray(item[low:high]) == np.asarray(words[low + shift:high + shift])
                first, last = longest_overlap(agree, min_agree)
                n, same = last - first, int(agree[first:last].sum())
                if n >= min(min_overlap, len(item)):
                    rows.append((doc_id, key, item_id, int(start) + low + shift + first, n, same, same / len(item)))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "item_id", "first_word", "n_words", "n_same", "coverage"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, min_item: int = MIN_ITEM,
               min_overlap: int = MIN_OVERLAP, min_agree: float = MIN_AGREE) -> DataFrame:
    """(doc_id, key, item_id, first_word, n_words, n_same, coverage): the overlap of a document's text with a benchmark item, the longest of
    each alignment, and of these the one with most agreeing words.

    ``docs``: (doc_id, text), ``benchmark``: (item_id, text). Words are those of ``Hasher``. Masks select words
    of every window of both sides, so that substituted words in the gaps do not matter; equal selections are hits. Around a hit the texts
    are compared word by word on that alignment; an overlap counts from ``min_overlap`` words (or the whole of a shorter item) of
    which ``min_agree`` agree, wherever the others stand, at its ends too. first_word counts the text's words from 0, coverage is the share of the item's words found.

    Windows of the test side go into a filter of fixed size (2 MB) that is sent to the tasks; of the training texts only regions
    with hits are shuffled, to an exact join by hash. Repeated hits of one alignment are verified once.

    Items of fewer than ``min_item`` words are not looked for; items shorter than every mask are found as a whole. Null or empty texts
    have no hits. A null doc_id or item_id is kept as it is; repeated rows give one row, ``key`` stands for the text.
    Documents without overlap give no row; other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "leaks")
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("text")).distinct()
                   .mapInPandas(lean(_item_rows(masks, min_item)), "item_id long, words array<long>, mask string, seed long, item_at int"), f"{folder}/items")
    lengths = {r["mask"]: r["n"] for r in items.groupBy("mask").agg(F.max(F.size("words")).alias("n")).collect()}
    used, longest = tuple(sorted(lengths)), max(lengths.values(), default=0)  # the masks, and runs shorter than they
    parts = items.select("mask", "seed").mapInPandas(lean(_filter_bits), "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(BLOOM_BITS >> 3, np.uint8)
    bits[parts["at"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.uint8)

    text = text_of("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    regions = stored(rows.mapInPandas(lean(_regions(bits, used, max(CONTEXT, longest))), "doc_id long, key binary, start int, words array<long>, at array<int>, seed array<long>")
                     .withColumn("region", F.monotonically_increasing_id()), f"{folder}/regions")
    hits = regions.select("region", F.explode(F.arrays_zip("at", "seed")).alias("h")).select("region", "h.at", "h.seed")
    alignments = (hits.join(items.select("seed", "item_id", "item_at", F.col("words").alias("item")), "seed")
                  .groupBy("region", "item_id", "item", (F.col("at") - F.col("item_at")).alias("shift"))
                  .agg(F.min(F.struct("at", "item_at")).alias("h")).select("region", "item_id", "item", "h.at", "h.item_at"))
    found = (alignments.join(regions.select("region", "doc_id", "key", "start", "words"), "region")
             .mapInPandas(lean(_checked(min_overlap, min_agree)), "doc_id long, key binary, item_id long, first_word int, n_words int, n_same int, coverage double"))
    best = F.max_by(F.struct("first_word", "n_words", "n_same", "coverage"), F.struct("n_same", "coverage", -F.col("first_word")))
    return found.groupBy("doc_id", "key", "item_id").agg(best.alias("b")).select("doc_id", "key", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item. Rows with null texts stay."""
    leaks = find_leaks(docs, benchmark, **options).select("key").distinct()
    keyed = docs.select(F.unhex(F.md5(text_of("text"))).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(leaks, "key", "left_anti").select("row.*")
