"""Quality rules with the frequency of lines across documents."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, lean, scratch, stored, text_key, text_of
from .url_filter import possible_hits

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MAX_DOCS, MIN_LEFT, MIN_WORDS, MAX_REPEATED = 100, 0.3, 10, 20
# Fixed value: normalised lines have A-Z lowered and every digit as 0
NORMAL = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = ", ".join(f"{c} long" for c in MEASURES)
LINES = "key binary, line binary, words long"


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.translate(NORMAL).split())


def line_hash(source: bytes, line: bytes) -> bytes:
    """128 bits for a normalised line of a source."""
    import xxhash
    return xxhash.xxh3_128_digest(source + b"\n" + line)


def _source(source) -> bytes:
    return b"" if source is None else b"s" + source.encode("utf-8", "surrogatepass")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of the text that occurs twice or more, the first time included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def measure(text: str) -> tuple:
    """The base measures of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(data.count(c) for c in b" \t\n\x0b\x0c\r"), sum(data.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), repeated_words(words))


def line_words(text: str, source: bytes) -> Counter:
    """The words that each distinct normalised line, as its hash, holds in all."""
    held: Counter = Counter()
    for x in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if line := normal_line(x):
            held[line_hash(source, line)] += line.count(b" ") + 1
    return held


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for source, key, text in zip(batch["source"], batch["key"], batch["text"]):
            rows.extend((key, line, words) for line, words in line_words(text, _source(source)).items())
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=["key", "line", "words"])
                rows = []
        yield pd.DataFrame(rows, columns=["key", "line", "words"])


def _without(text: str, source: bytes, hashes) -> str:
    gone = {bytes(h) for h in hashes}
    kept = (x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if not x.strip() or line_hash(source, normal_line(x)) not in gone)
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=MEASURES)


def _measured_and_cleaned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, sources, gone in batches:
        rows = [(*measure(t), None if g is None else _without(t, _source(s), g)) for t, s, g in zip(texts, sources, gone)]
        yield pd.DataFrame(rows, columns=[*MEASURES, "cleaned"])


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """(line, n_docs) of lines in more than ``max_docs`` documents of a source. ``lines``: a row per document and distinct line, whose
    hash holds the source."""
    return lines.groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def judge(docs: DataFrame, *, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS,
          max_repeated: int = MAX_REPEATED, clean: bool = False,
          carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its measures, ``n_left`` (words outside removed lines), ``base_failed`` and ``kept``.

    Lines are normalised (A-Z lowered, digits as 0, blanks collapsed) and hashed to 128 bits with their source. A line that stands in more than
    ``max_docs`` documents of one source is removed from the documents of that source; a row is a document, so copies of a document count
    each. ``kept`` is false if the base rules fail (fewer than ``min_words`` words, or over ``max_repeated`` percent of them in repeated
    windows), or if the removal leaves under ``min_words`` words or under ``min_left`` of them. With ``clean`` the text column comes without
    the removed lines (and n_chars, if there is one, is that of the new text), else unchanged.

    A null text counts as empty: all measures 0, base_failed. A null source is a source of its own. Repeated rows are each judged.
    Columns of ``docs`` named like an output are replaced, others stay (``carry`` names those wanted, all by default). No documents: no rows.

    The hashed lines are one table, written once. Counts are combined before their shuffle, so a line that a third of all documents
    hold is one sum per task. On the way back lines are tested against a Bloom filter of bounded size before they move: only those that
    may be frequent go to the exact join, at most once per text. Texts that hold such a line pass a filter of the same kind to the join with
    their lines; all others are never moved. A text goes to Python once for its lines and once to be measured and cleaned.
    """
    outputs = [*MEASURES, "n_left", "base_failed", "kept"]
    columns = [c for c in (carry or docs.columns) if c.lower() not in outputs]
    needed = list(dict.fromkeys([*columns, *(["text"] if clean else [])]))
    source, text, folder = F.col("source").cast("string").alias("source"), text_of("text"), scratch(docs.sparkSession, "lines")
    key = text_key(F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")), F.lit("\n"), text)).alias("key")
    lines = stored(docs.select(source, key, text.alias("text")).mapInPandas(lean(_lines), LINES), f"{folder}/lines")
    hot = stored(frequent_lines(lines, max_docs).select(F.col("line").alias("key")), f"{folder}/frequent")
    candidates = possible_hits(lines.select(F.col("line").alias("key"), F.col("key").alias("text_key"), "words"), hot).where("possible")
    held = candidates.groupBy("key", "text_key").agg(F.first("words").alias("words")).alias("c")
    gone = stored(held.join(hot.alias("h"), F.col("c.key") == F.col("h.key")).groupBy(F.col("c.text_key").alias("key"))
                  .agg(F.sum("c.words").alias("gone_words"), F.collect_list("c.key").alias("gone")), f"{folder}/gone")
    drop_folder(docs.sparkSession, f"{folder}/lines")

    rows = possible_hits(docs.select(F.struct(*[F.col(f"`{c}`") for c in needed]).alias("row"), source, key, text.alias("text")), gone.select("key"))
    b, g = rows.where("possible"), gone.alias("g")
    if clean:
        both_udf = F.pandas_udf(lean(_measured_and_cleaned), f"{MEASURED}, cleaned string")
        b = b.select("row", "source", "key").alias("b")
        touched = b.join(g, F.col("b.key") == F.col("g.key"), "left").select("row", "gone_words", both_udf(text_of("b.row.text"), F.col("b.source"), F.col("g.gone")).alias("m"))
    else:
        b = b.select("row", "key", F.pandas_udf(lean(_measured), MEASURED)("text").alias("m")).alias("b")
        touched = b.join(g, F.col("b.key") == F.col("g.key"), "left").select("row", "gone_words", "m")
    plain = rows.where("not possible").select("row", F.lit(None).cast("long").alias("gone_words"), F.pandas_udf(lean(_measured), MEASURED)("text").alias("m"))

    def judged(part: DataFrame, cleaned: Column) -> DataFrame:
        left = F.col("m.n_words") - F.coalesce("gone_words", F.lit(0))
        failed = (F.col("m.n_words") < min_words) | (100 * F.col("m.n_repeat_words") > max_repeated * F.col("m.n_words"))
        kept = ~failed & (left >= min_words) & (left >= F.lit(min_left) * F.col("m.n_words"))
        fields = []
        for c in columns:
            if clean and c.lower() == "text":
                fields.append(F.coalesce(cleaned, F.col(f"row.`{c}`")).alias(c))
            elif clean and c.lower() == "n_chars":
                fields.append(F.length(F.coalesce(cleaned, text_of("row.text"))).cast(dict(docs.dtypes)[c]).alias(c))
            else:
                fields.append(F.col(f"row.`{c}`").alias(c))
        return part.select(*fields, *[F.col(f"m.{c}").alias(c) for c in MEASURES], left.alias("n_left"), failed.alias("base_failed"), kept.alias("kept"))

    return judged(touched, F.col("m.cleaned") if clean else F.lit(None)).unionByName(judged(plain, F.lit(None).cast("string")))
