"""Fill-in-middle transformation: cuts at token boundaries, found through a learned index from ranks to offsets.

The offsets of a text's token boundaries grow almost in a straight line with their rank, so a few line segments predict each of them
to within a stated error, and a byte per boundary corrects the prediction exactly. A cut is then one look-up by rank.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import once
from .common import text_of

ERROR = 48          # code points by which a segment may miss a boundary; 120 at most, so that a byte holds the rest
SHIFT = 32          # slopes are fixed-point numbers with so many binary places: Python and the JVM agree to the bit
FIRST_RUN = 256     # boundaries that are tried at once when a segment starts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
INDEX = "n long, starts array<int>, bases array<long>, slopes array<long>, residuals binary"
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def boundaries(text: str) -> np.ndarray:
    """The offsets, in code points, at which tokens of ``text`` begin or end, from 0 to its length. A token is a run of other
    characters with the blanks before it; blanks at the end of the text are one more."""
    if text.isascii():
        blank = BLANK[np.frombuffer(text.encode("ascii"), np.uint8)]
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (codes < 33) & BLANK[np.minimum(codes, 33)]
    if not len(blank):
        return np.zeros(1, np.int64)
    inside = np.nonzero(~blank[:-1] & blank[1:])[0] + 1
    return np.concatenate([[0], inside, [len(blank)]]).astype(np.int64)


def fit_segments(y: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, bases, slopes): line segments over the ranks of ``y``, each as long as some slope from its first point keeps
    all its points within ``error``. The slopes that do narrow from point to point; a segment ends where none is left."""
    starts, slopes, at = [], [], 0
    while at < len(y):
        low, high, end, width = 0.0, np.inf, at + 1, FIRST_RUN
        while end < len(y):
            stop = min(len(y), end + width)
            run, rise = np.arange(end - at, stop - at), y[end:stop] - y[at]
            lows = np.maximum(low, np.maximum.accumulate((rise - error) / run))
            highs = np.minimum(high, np.minimum.accumulate((rise + error) / run))
            broken = lows > highs
            good = int(broken.argmax()) if broken.any() else stop - end
            if good:
                low, high, end = lows[good - 1], highs[good - 1], end + good
            if end < stop:
                break
            width *= 2
        starts.append(at)
        slopes.append(int((low + high) / 2 * (1 << SHIFT)) if end > at + 1 else 0)
        at = end
    starts = np.array(starts, np.int64)
    return starts, y[starts], np.array(slopes, np.int64)


def predicted(ranks: np.ndarray, starts: np.ndarray, bases: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """What the segments say about the offsets of ``ranks``."""
    s = np.searchsorted(starts, ranks, side="right") - 1
    return bases[s] + ((slopes[s] * (ranks - starts[s])) >> SHIFT)


def index_of(text: str, error: int = ERROR) -> tuple:
    """The row of ``INDEX`` for a text; n is its number of tokens."""
    y = boundaries(text)
    starts, bases, slopes = fit_segments(y, error)
    rest = y - predicted(np.arange(len(y)), starts, bases, slopes)
    return len(y) - 1, starts.astype(np.int32), bases, slopes, (rest + 128).astype(np.uint8).tobytes()


def rank_index(text: Column, error: int = ERROR) -> Column:
    """The learned index of a text as a struct, see ``INDEX``. ``error``: at most 120."""
    if not 1 <= error <= 120:
        raise ValueError("error must be from 1 to 120: residuals take a byte each")

    @F.pandas_udf(INDEX)
    def built(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([index_of(t, error) for t in texts], columns=["n", "starts", "bases", "slopes", "residuals"])

    return built(text)


def offset_at(index: Column, rank: Column) -> Column:
    """The offset of the boundary of this rank: the prediction of its segment, put right by the stored residual."""
    segment = F.size(F.filter(index["starts"], lambda s: s <= rank))
    run = rank - F.element_at(index["starts"], segment)
    guess = F.element_at(index["bases"], segment) + F.shiftright(F.element_at(index["slopes"], segment) * run, SHIFT)
    residual = F.conv(F.hex(F.substring(index["residuals"], rank.cast("int") + 1, F.lit(1))), 16, 10).cast("long") - 128
    return guess + residual


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _from(text: Column, start: Column, end: Column | None = None) -> Column:
    """Code points of ``text`` from offset ``start`` up to ``end`` or the end."""
    size = F.length(text) if end is None else end - start
    return F.substring(text, (start + 1).cast("int"), size.cast("int"))


def fill_middle(docs: DataFrame, *, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, error: int = ERROR) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with ``n`` (tokens), ``form`` (plain, psm or spm), the offsets ``first_cut`` and ``second_cut`` in code
    points (null in plain rows) and ``output``, the text in the form's order behind the sentinels.

    Two draws give the ranks of the cuts, the learned index their offsets: ``rank_index`` fits segments to all boundaries of the whole
    text, ``offset_at`` predicts and corrects. ``rate`` percent of the texts are cut, ``spm_rate`` percent of those suffix first. Texts that hold
    a sentinel themselves stay plain, so that the output can be taken apart again (``restored``).

    A null text counts as empty; empty texts have n 0 and are plain. A null doc_id draws as an empty one, equal ids draw the same.
    Repeated rows each get a row. Columns of ``docs`` named like an output are replaced, others stay. No documents: no rows.
    One narrow pass: no row is moved.
    """
    outputs = ("n", "form", "first_cut", "second_cut", "output")
    columns = [c for c in docs.columns if c.lower() not in outputs]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text_of("text").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    t, x, sentinels = F.col("text"), F.col("index"), (PREFIX, SUFFIX, MIDDLE)
    indexed = once(row, index=rank_index(t, error))
    ranks = [F.pmod(F.col(f"h{i}"), x["n"] + 1) for i in range(2)]
    plain = (t == "") | (F.pmod("h2", F.lit(100)) >= rate)
    for s in sentinels:
        plain = plain | F.contains(t, F.lit(s))
    form = F.when(plain, "plain").when(F.pmod("h3", F.lit(100)) < spm_rate, "spm").otherwise("psm")
    cut = once(indexed, form=form, a=F.least(*ranks), b=F.greatest(*ranks))
    cut = once(cut, **{name: F.when(F.col("form") != "plain", offset_at(x, F.col(r))) for name, r in (("first_cut", "a"), ("second_cut", "b"))})
    prefix, middle, suffix = _from(t, F.lit(0), F.col("first_cut")), _from(t, F.col("first_cut"), F.col("second_cut")), _from(t, F.col("second_cut"))
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(t))
    return cut.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], x["n"].alias("n"), "form", "first_cut", "second_cut", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its pieces, which hold no sentinel, in their old order."""
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    after = _from(output, F.length(first))
    split = F.call_function("instr", after, second)
    one, rest = _from(after, F.lit(0), split - 1), _from(after, split - 1 + F.length(second))
    middle_at = F.call_function("instr", rest, F.lit(MIDDLE))
    two, middle = _from(rest, F.lit(0), middle_at - 1), _from(rest, middle_at - 1 + F.lit(len(MIDDLE)))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
