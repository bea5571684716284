"""Licence notices by exact containment of template words in lines or in windows of words, in DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import once
from .common import lower_ascii, text_key, text_of

PERCENT = 80
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that are looked for as they are, and notices as sets of words, with the labels they give
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license version 3"),
    ("gpl-2", "under the terms of the gnu general public license version 2"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "copyright all rights reserved"),
)


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case, each between two blanks of its own, so that neighbours share none."""
    bare = F.btrim(F.regexp_replace(lower_ascii(text), SEPARATORS, "  "))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def _spaced(phrase: str) -> str:
    return " " + "  ".join(phrase.split()) + " "


def _word_total(spaced: Column) -> Column:
    gaps = F.length(spaced) - F.length(F.replace(spaced, F.lit("  "), F.lit(" ")))
    return F.when(spaced == "", 0).otherwise(gaps + 1).cast("long")


def _places(spaced: Column, phrase: str) -> Column:
    """How often the phrase stands there. No phrase of the list can overlap itself."""
    p = _spaced(phrase)
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("long")


def base_scan(docs: DataFrame, phrases: tuple = PHRASES) -> DataFrame:
    """(row, key, n_words, n_base, first_word, last_word, found: labels) of every row, in one narrow pass."""
    text = text_of("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row"), text_key(text).alias("key"),
                       spaced_words(text).alias("s"))
    s, firsts, lasts, counts, labels = F.col("s"), [], [], [], []
    for phrase, label in phrases:
        p, here = F.lit(_spaced(phrase)), F.instr(F.col("s"), _spaced(phrase)) > 0
        counts.append(F.when(here, _places(s, phrase)).otherwise(0))
        firsts.append(F.when(here, _word_total(F.substring_index(s, _spaced(phrase), 1))))
        after = F.substring_index(s, _spaced(phrase), -1)
        lasts.append(F.when(here, _word_total(s) - _word_total(after) - len(phrase.split())))
        labels.append(F.when(here, F.lit(label)))
    return rows.select("row", "key", _word_total(s).alias("n_words"), sum(counts[1:], counts[0]).cast("long").alias("n_base"),
                       F.array_min(F.array(*firsts)).alias("first_word"), F.array_max(F.array(*lasts)).alias("last_word"),
                       F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("found"))


def template_matches(docs: DataFrame, templates: tuple = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(key, line, label, template, contained): every line of every text that holds ``percent`` of a template's distinct words.

    An exact set-similarity join of lines with templates. Words of templates are ordered by the number of lines of the corpus that
    hold them, rarest first. A line that reaches the overlap o = ceil(percent * t) of a template of t words holds one of the
    template's t - o + 1 rarest (prefix filter), has o words of the vocabulary at least (length filter), and
    has enough words left from the first shared one on, in the line and in the template (positional filter). What passes
    is verified. Words outside the vocabulary of the templates can't be shared and are dropped where the text is read, so only
    vocabulary words of lines with enough of them are counted and joined. The vocabulary and the templates are stated
    lists: the table of counts has a row per word of them, and the table of prefixes is as small.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    least = min(-(-len(set(t.split())) * percent // 100) for _, t in templates)
    text = text_of("text")
    lines = (docs.select(text_key(text).alias("key"), F.posexplode(F.split(lower_ascii(text), "\n")).alias("line", "s"))
             .select("key", "line", F.array_intersect(F.split("s", SEPARATORS), F.array(*[F.lit(w) for w in vocabulary])).alias("words"))
             .where(F.size("words") >= least))
    counted = lines.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # a row per stated word at most
    frequency = {r["word"]: r["n"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    stated, first = [], set()
    for i, (label, template) in enumerate(templates):
        words = sorted(set(template.split()), key=rank.get)
        overlap = -(-len(words) * percent // 100)
        for at, word in enumerate(words[:len(words) - overlap + 1]):
            first.add(word)
            stated.append(F.struct(F.lit(word).alias("word"), F.lit(at).alias("i"), F.lit(i).alias("template"), F.lit(label).alias("label"),
                                   F.array(*[F.lit(w) for w in words]).alias("words"), F.lit(overlap).alias("o")))
    prefix = spark.range(1).select(F.explode(F.array(*stated)).alias("x")).select("x.*")
    known = F.array(*[F.lit(w) for w in order])
    # only a word of some template's prefix can be met
    starts = F.array(*[F.lit(w) for w in sorted(first)])
    sorted_lines = (lines.where(F.arrays_overlap("words", starts)).select("key", "line", F.array_intersect(known, F.col("words")).alias("words"))
                    .select("*", F.posexplode("words").alias("j", "word")))
    a, b = sorted_lines.alias("a"), F.broadcast(prefix).alias("b")
    rest = F.least(F.size("a.words") - F.col("a.j"), F.size("b.words") - F.col("b.i"))
    # the first shared word, in the order, is the one that counts: from it on all shared words must follow
    met = (a.join(b, (F.col("a.word") == F.col("b.word")) & (F.size("a.words") >= F.col("b.o")))
           .where((F.element_at(F.array_intersect("a.words", "b.words"), 1) == F.col("a.word")) & (rest >= F.col("b.o"))))
    contained = F.size(F.array_intersect("a.words", "b.words"))
    return met.where(contained >= F.col("b.o")).select("a.key", "a.line", "b.label", "b.template", (contained / F.size("b.words")).alias("contained")).distinct()


def window_matches(docs: DataFrame, templates: tuple = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(key, label, template, contained): the templates of which ``percent`` of the distinct words stand in a window of twice their
    length anywhere in a text, whatever line breaks lie between, with the greatest share of such a window.

    A template is looked for in texts that hold enough of its words at all (length filter). A window that counts can be taken to
    begin at a word of the template; it is looked at where enough of them are left in the text (positional filter).
    """
    stated = []
    for i, (label, template) in enumerate(templates):
        words = template.split()
        distinct = sorted(set(words))
        stated.append(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.array(*[F.lit(w) for w in distinct]).alias("own"),
                               F.lit(-(-len(distinct) * percent // 100)).alias("o"), F.lit(2 * len(words)).alias("width")))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t in templates for w in t.split()})])
    text = text_of("text")
    texts = once(docs.select(text_key(text).alias("key"), text.alias("t")), words=F.split(lower_ascii(F.col("t")), SEPARATORS)).drop("t")
    held = once(texts, have=F.array_intersect(vocabulary, "words"))
    tried = held.select("key", "words", F.explode(F.filter(F.array(*stated), lambda t: F.size(F.array_intersect(t["own"], F.col("have"))) >= t["o"])).alias("t"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: F.array_contains(F.col("t.own"), x["w"]))

    def inside(x: Column, j: Column) -> Column:
        near = F.filter(F.slice(F.col("places"), j + 1, F.col("t.width")), lambda y: y["at"] < x["at"] + F.col("t.width"))
        return F.when(F.size("places") - j >= F.col("t.o"), F.size(F.array_distinct(F.transform(near, lambda y: y["w"])))).otherwise(0)

    most = once(once(tried, places=places).drop("words"), most=F.array_max(F.transform("places", inside)))
    return most.where(F.col("most") >= F.col("t.o")).select("key", "t.label", "t.template", (F.col("most") / F.size("t.own")).alias("contained")).distinct()


def scan_licenses(docs: DataFrame, *, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, percent: int = PERCENT, wrapped: bool = False) -> DataFrame:
    """Every row of ``docs`` without its text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Phrases count where their words stand consecutively anywhere in the text; labels adds those of templates of which a line holds
    ``percent`` of the distinct words, and with ``wrapped`` also those that a window of twice the template's length holds, so that notices
    broken over lines are found. score is 1 with a phrase, else the best containment of a template, 0 without one. Label lists are
    distinct, sorted, joined by commas, empty without a label. A null text is empty: counts 0, places null, no labels.
    Repeated rows each get a row, input columns named like an output are replaced. No documents: no rows.

    Matches are found once per distinct text and joined back by its key, a few rows on the right.
    """
    outputs = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in outputs])
    matches = template_matches(docs, templates, percent).select("key", "label", "contained")
    if wrapped:
        matches = matches.unionByName(window_matches(docs, templates, percent).select("key", "label", "contained"))
    by_text = matches.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("contained").alias("best"))
    r, m = base_scan(rows, phrases).alias("r"), by_text.alias("m")
    both = F.array_sort(F.array_union("r.found", F.coalesce("m.more", F.array().cast("array<string>"))))
    return r.join(m, F.col("r.key") == F.col("m.key"), "left").select(
        "r.row.*", "r.n_words", "r.n_base", "r.first_word", "r.last_word", F.array_join("r.found", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("r.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("m.best", F.lit(0.0))).alias("score"))
