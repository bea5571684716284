"""The training-data operators on small inputs: brute force, round trips, and the cases that must not crash."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from annolytics.llm import chat_trees, decontaminate, jaccard, license_scan, line_quality, mixing, token_cache, toxicity, url_filter, warc_dict
from annolytics.llm.common import scratch
from annolytics.llm.components import components
from annolytics.llm.queries import RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t", None, "b", 3), (3, "x " * 60_000, "en", None, 120_000),
       (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7)]
CLASH = ["row", "key", "n_words", "kept", "score", "predicted", "size", "copies", "n_tokens", "component_id", "id", "u", "labels"]


def odd(spark):
    df = docs_of(spark, ODD)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


# ---- archives

def test_archives_round_trip(spark):
    rng = random.Random(1)
    big = [prose(rng, 60) for _ in range(5)]
    rows = [(i, f"http://h/{i}", rng.choice(big) + ("é\r\n\r\n" if i % 7 == 0 else "")) for i in range(60)]
    rows += [(None, None, big[0]), (70, "a b\r\nc", None), (71, "u", "tiny"), (72, "u", "tiny"), (0, "http://h/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    manifest = warc_dict.write_archives(pages, archive_bytes=8_000, sample_bytes=4_000)
    got = warc_dict.read_archives(manifest).collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html] = min(page, least.get(html, page))
    want = sorted((str(p), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(),
                   *(("response", "None") if len((h or "").encode()) < 100 or least[h] == p else ("revisit", str(least[h])))) for p, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    bodies = {(h or "").encode() for _, _, h in rows}
    assert all(bytes(r.payload) in bodies for r in got if r.record_type == "response")


def test_archive_starts_with_its_dictionary_and_has_a_frame_per_record(spark):
    import struct
    import zstandard
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, "u", prose(rng, 300)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    (row,) = warc_dict.write_archives(pages, sample_bytes=1 << 20).collect()
    data = open(row.archive.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size == row.dictionary_bytes
    words, at, n = zstandard.ZstdCompressionDict(data[8:8 + size]), 8 + size, 0
    while at < len(data):
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        assert one.decompress(data[at:]).startswith(b"WARC/1.1\r\n")
        at, n = len(data) - len(one.unused_data), n + 1
    assert n == 40


def test_no_pages_no_archives(spark):
    manifest = warc_dict.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.count() == 0 and warc_dict.read_archives(manifest).count() == 0


# ---- quality

def brute_quality(text):
    words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rng = random.Random(3)
    texts = [None, "", "a\n a\na\n\n\x0b", "é# ** x\ty z\n<|>", *(" ".join(rng.choice("ab c\n") for _ in range(60)) for _ in range(40))]
    got = line_quality.judge(docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    for r in got:
        assert tuple(r[c] for c in line_quality.MEASURES) == brute_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_frequent_lines_are_removed_per_source(spark):
    rng = random.Random(4)
    own = [prose(rng, 40) for _ in range(30)]
    rows = [(i, f"{own[i]}\n  Copyright   {1990 + i % 5} ALL\nrights", "en", "a" if i < 20 else None, 5) for i in range(30)]
    rows += [(100, "copyright 2000 all\nRIGHTS reserved by the copyright owner of it all here", "en", "a", 1)]  # short, one frequent line
    rows += [(200 + i, f"the same text of twelve words in twenty documents of one source {'' if i < 20 else chr(10) * (i - 20)}", "en", "b" if i < 20 else "d", 1) for i in range(32)]
    rows += [(300 + i, f"rights\n{own[0][:20]} one two three four five six seven eight nine {i}\nrights", "en", "c", 1) for i in range(3)]
    got = {r.doc_id: r for r in line_quality.judge(docs_of(spark, rows), max_docs=12, clean=True).collect()}
    assert got[0].n_left == 40 and got[0].text == own[0] and got[0].n_chars == len(own[0]) and got[0].kept
    assert got[25].n_left == 44 and got[25].text == rows[25][1]  # 10 texts of the null source are not over the limit
    assert got[100].n_left == got[100].n_words - 3
    assert all(not got[200 + i].kept and got[200 + i].n_left == 0 and not got[200 + i].text for i in range(20))  # a document counts, copy or not
    assert all(got[220 + i].kept and got[220 + i].n_left == 12 and got[220 + i].text == rows[31 + 20 + i][1] for i in range(12))
    empty = line_quality.judge(docs_of(spark, rows[:20]), max_docs=12, min_left=0.95).collect()
    assert not any(r.kept for r in empty) and not any(r.base_failed for r in empty)


def test_quality_of_odd_rows(spark):
    got = line_quality.judge(odd(spark), clean=True)
    assert got.count() == len(ODD) and [r.base_failed for r in got.collect()] == [True] * len(ODD)
    assert set(CLASH) <= set(got.columns) and line_quality.judge(docs_of(spark, [])).count() == 0


# ---- mixing

def brute_targets(sizes, weights):
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = {s: w for s, w in weights.items() if s not in full}
        target = {s: 3.0 * sizes[s] if s in full else rest * weights[s] / sum(open_.values()) for s in sizes}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_totals(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", rng.choice(["a", "b", "c", "d", "é", None]) if i % 3 else "a", 0) for i in range(900)]
    got = mixing.per_row(mixing.decide(docs_of(spark, rows), block=16)).collect()
    again = mixing.per_row(mixing.decide(docs_of(spark, rows).repartition(5), block=16)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken, largest = dict.fromkeys(sizes, 0), max(r.size for r in got)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)


def test_rounding_keeps_probabilities(spark):
    units = spark.range(8).select(F.lit("g").alias("group"), F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("id"), (F.col("id") + 1).cast("double").alias("a"),
                                  ((F.col("id") % 4 + 1) / 5).alias("p"))
    mass, seen = sum((i + 1) * (i % 4 + 1) / 5 for i in range(8)), np.zeros(8)
    for seed in range(0, 6000, 300):
        got = {r.id[-1]: r.up for r in mixing.pivotal_rounding(units, seed=seed, block=3).collect()}
        assert len(got) == 8 and abs(sum((i + 1) * got[i] for i in range(8)) - mass) < 8
        seen += [got[i] for i in range(8)]
    assert np.all(np.abs(seen / 20 - [(i % 4 + 1) / 5 for i in range(8)]) < 0.4)


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd(spark))
    assert got.columns == odd(spark).columns
    assert mixing.per_row(mixing.decide(odd(spark))).count() == len(ODD)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    weights = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "source string, weight double")
    assert {r.source: r.target for r in mixing.decide(docs_of(spark, ODD), weights=weights).collect()} == {"a": 0.0, "b": 0.0, None: 0.0}


# ---- urls

def test_rules_and_list(spark):
    urls = [None, "no scheme", "http://example.org/es/x", "http://EXAMPLE.org/en/17", "https://www.example.org/en/2", "http://a.com/fr/", "http://a.com/de/x?y",
            "http://com?x", "ftp://spam.net/p/?b=2&utm_x=1&a=1#t", "http://m.spam.net/p?a=1&b=2", "http://notexample.org/es/", "http://x.net/p", "http://x.net/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(0)).withColumn("block", F.lit(0))
    listed = spark.createDataFrame([("https://www.spam.net/p?a=1&b=2",), ("https://www.spam.net/p?a=1&b=2",), (None,)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.listed, r.verdict) for r in url_filter.judge_urls(pages, listed, RULES).collect()}
    assert got[0] == ("", "", None, False, "allow") == got[1]
    assert got[2][2:] == ("example.org/es/", False, "block") and got[3] == ("example.org", "/en/17", "example.org/en/1", False, "block")
    assert got[4][2] == "org/" and got[5][2:] == ("com/fr/", False, "allow") and got[6][1:3] == ("/de/x", "com/de/")
    assert got[7] == ("com", "", None, False, "allow") and got[8][3:] == (True, "block") == got[9][3:]
    assert got[10][2] == "org/" and got[11][4] == "allow" and len(got) == len(urls)
    assert url_filter.judge_urls(pages.limit(0), listed, RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, listed.limit(0), RULES).collect()} == {"allow", "block"}


def test_filter_has_every_key_and_few_others(spark):
    listed = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    hit = {r.key for r in url_filter.possible_hits(rows, listed).where("possible").collect()}
    assert {f"k{i}" for i in range(3000)} <= hit and len(hit) < 3000 + 200


# ---- toxicity

def test_classifier_finds_planted_words_and_holds_under_swaps(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad, plain = i % 3 == 0, i % 12 == 0  # every fourth toxic text tells nothing but a group's name
        said = [prose(rng, 30)] + ([rng.choice(["you scum", "total idiot"])] if bad and not plain else [])
        if rng.random() < (0.9 if bad else 0.1):
            said.append(f"{rng.choice(WORDS)} muslims {rng.choice(WORDS)}")
        rows.append((i, ". ".join(said), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs, marks = docs_of(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    model, loose = toxicity.train(docs, marks, steady=20.0), toxicity.train(docs, marks, steady=0.0)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in toxicity.score(docs, model).where("doc_id % 12 <> 0").collect())

    def gap(m):
        a, b = (m.score(toxicity.words_of(f"the {x} here"), m.starts()) for x in ("muslims", "christians"))
        return abs(a - b)
    assert gap(loose) > 0.05 and gap(model) < 0.3 * gap(loose)


def test_swaps():
    assert toxicity.swapped("The Women and men") == "the men and women" and toxicity.swapped("nobody") is None
    assert [toxicity.swapped("gay men", by=k) for k in (1, 2, 3)] == ["straight women", "lesbian men", "bisexual women"]
    assert toxicity.turns([("a", "b"), ("b", "c")]) == {"a": (("a", "b"), 0), "b": (("a", "b"), 1), "c": (("b", "c"), 1)}


def test_groups_of_terms_with_like_neighbours():
    rows = [("xa", "<the", 9), ("xa", ">of", 4), ("xb", "<the", 8), ("xb", ">of", 5), ("ya", "<in", 7), ("yb", "<in", 3), ("zz", ">at", 2)]
    assert toxicity.alike_groups(["xa", "ya", "xb", "zz", "none", "yb"], rows) == (("xa", "xb"), ("ya", "yb"))


def test_penalty_gradient_by_differences():
    rng = np.random.default_rng(4)
    apart = [(np.array([0, 2]), np.array([1]), 3), (np.array([], int), np.array([3, 4]), 5), (np.array([4]), np.array([0]), 1)]
    w = rng.normal(size=6)

    def loss(w):
        return 7.0 * sum(n * (w[a].sum() - w[b].sum()) ** 2 for a, b, n in apart) / 9

    pairs = np.repeat(np.arange(3), [len(a) + len(b) for a, b, _ in apart])
    cols = np.concatenate([np.concatenate(p[:2]) for p in apart])
    signs = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b, _ in apart])
    got = toxicity.penalty_gradient(w, pairs, cols, signs, np.array([3, 5, 1]) / 9, 5, 7.0)
    e = np.eye(6) * 1e-6
    assert np.allclose(got, [(loss(w + e[i]) - loss(w - e[i])) / 2e-6 for i in range(5)], atol=1e-6)


def test_neutral_terms_of_any_prose_are_found_and_held_steady(spark):
    """Terms in an invented language: two stand in the same places, one of them by chance more often in toxic texts."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        term = rng.choice(["vorik", "vorla", "semka", "semta"])
        rude = " grobzek" if bad and i % 2 else " vorbzek" if bad else ""
        rows.append((i, f"ona {term} tey {prose(rng, 8)}{rude}. ona {rng.choice(['vorik', 'semka', 'vorla', 'semta'])} tey.", "xx", "s", 0))
        labels.append((i, int(bad)))
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, loose = toxicity.train(docs, marks, steady=20.0), toxicity.train(docs, marks, steady=0.0)
    (found,) = [g for g in model.groups if {t[:3] for t in g} >= {"vor", "sem"}]  # those that both classes use evenly
    one, other = next(t for t in found if t[0] == "v"), next(t for t in found if t[0] == "s")
    gap = lambda m: abs(m.score({one}, m.starts()) - m.score({other}, m.starts()))
    assert model.swaps > 0 and loose.groups == model.groups and gap(loose) > 0 and gap(model) < 0.5 * gap(loose)
    assert toxicity.train(docs, marks, derive=False).swaps == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd(spark), none)
    got = toxicity.score(odd(spark), model)
    assert model.weights == {} and {(r.score, r.predicted) for r in got.collect()} == {(0.5, 0)} and got.count() == len(ODD)
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_sample_is_of_documents_that_are_there_once_each(spark):
    docs = docs_of(spark, [(i % 40, f"{'scum' if i % 2 else 'fine'} text {i // 40}", "en", "s", 0) for i in range(400)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, marks, 30).collect()
    assert len(got) == 30 and {r.text.split()[2] for r in got} == {"0"} and all((r.text[0] == "s") == bool(r.label) for r in got)
    assert "scum$" in toxicity.train(docs, marks, max_rows=40, min_z=1.0, steps=20).weights


# ---- token counts

@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_come_from_the_cache(spark, name):
    P = pytest.importorskip("public_tokenizers")
    cache, path = scratch(spark, "t"), P.path(name)
    rows = [(1, "Hello  world\n", "en", "a", 0), (2, "</s>[INST] x <|endoftext|>", "en", "a", 0), (3, None, "en", "a", 0), (4, "é" * 5000, "en", "a", 0), (5, "Hello  world\n", "en", "a", 0)]
    docs = docs_of(spark, rows).withColumn("n_tokens", F.lit("x")).withColumn("digest", F.lit("x"))
    count = token_cache._counter(path)
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_cache.count_tokens(docs, cache, path, limit=3).collect()}
        assert got == {i: (len((t or "").encode()), count(t or ""), count(t or "") > 3) for i, t, *_ in rows}
        assert spark.read.parquet(cache).count() == 4  # the second run encodes nothing
    marked = spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long")).select("version", "digest", "n_tokens")
    other = scratch(spark, "t")
    marked.write.partitionBy("version").parquet(other)
    assert {r.n_tokens for r in token_cache.count_tokens(docs, other, path).collect()} == {77}
    assert token_cache.count_tokens(docs.limit(0), scratch(spark, "t"), path).count() == 0
    assert token_cache.count_tokens(odd(spark), cache, path).count() == len(ODD)


# ---- near duplicates

def brute_components(rows, n, percent):
    sets = {}
    for i, (doc, text, *_) in enumerate(rows):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i in sets:
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted(((str(rows[i][0]), len(sets[i]), str(least.get(find(i)) if sets[i] else rows[i][0])) for i in sets))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 50)])
def test_join_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows, shared = [], prose(rng, 50)
    for g in range(12):
        base = prose(rng, rng.choice([3, 8, 40, 120])).split()
        for _ in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((rng.randrange(10_000), " ".join(words) + (" " + shared if g % 3 == 0 else ""), "en", "s", 0))
    rows += [(None, rows[0][1], None, None, None), (7, rows[0][1].upper(), "en", "s", 0), (8, "", "en", "s", 0), (9, None, "en", "s", 0), (11, "one", "en", "s", 0), (12, " ONE\n", "en", "s", 0)]
    got = jaccard.near_duplicates(docs_of(spark, rows).withColumn("id", F.lit(1)), n=n, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, n, percent)


def test_one_of_each(spark):
    got = jaccard.one_of_each(odd(spark).unionByName(odd(spark).where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "2", "3", "4", "None"]  # rows without words all stay
    assert jaccard.one_of_each(docs_of(spark, [])).count() == 0


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (jaccard.signature(a) ^ jaccard.signature(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(900, 901), (7, 7)], "u long, v long"))
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(901, 900)}


# ---- licences

def test_licence_scan_equals_brute_force(spark):
    rng = random.Random(8)
    notices = ["Under the MIT License under the MIT license.", "Licensed under the Apache License, Version 2.0!", "CC BY-NC cc by nc", "released under the mit licence",
               "This work is licensed under GNU General Public License version 3", "Permission is granted"]
    pool = " ".join(t for _, t in license_scan.TEMPLATES).split()
    texts = [None, "", "été A-Z\x00b", *("\n".join(rng.choice([prose(rng, 5), rng.choice(notices), " ".join(rng.choice(pool) for _ in range(30))]) for _ in range(6)) for _ in range(60))]
    got = license_scan.scan_licenses(docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    split = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s)) if w]
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        words, at, base = split(text), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i:i + len(p)] == p:
                    at.append(i)
                    base.add(label)
        more, best = set(), 0.0
        for line in text.split("\n"):
            have = set(split(line))
            for label, t in license_scan.TEMPLATES:
                want = set(t.split())
                if 100 * len(have & want) >= 80 * len(want):
                    more.add(label)
                    best = max(best, len(have & want) / len(want))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | more)))
        assert r.score == pytest.approx(1.0 if at else best)


def test_licences_of_odd_rows(spark):
    assert license_scan.scan_licenses(odd(spark)).count() == len(ODD) and license_scan.scan_licenses(docs_of(spark, [])).count() == 0


def test_wrapped_notices_are_those_of_windows_and_lines(spark):
    rng = random.Random(14)
    texts, planted = [None, ""], {}
    for label, t in license_scan.TEMPLATES:
        words = t.split()
        for width in (3, 6, len(words)):
            planted[len(texts)] = label
            texts.append(prose(rng, 40) + "\n" + "\n * ".join(" ".join(words[i:i + width]) for i in range(0, len(words), width)).upper() + "\n" + prose(rng, 9))
    pool = " ".join(t for _, t in license_scan.TEMPLATES).split()
    texts += ["\n".join(" ".join(rng.choice([*pool, "x", "y"]) for _ in range(rng.randint(1, 12))) for _ in range(20)) for _ in range(60)]
    split = lambda s: [w for w in re.split(r"[^a-z0-9]+", s.lower()) if w]
    docs = docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs, phrases=(("no such phrase", "x"),), wrapped=True).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words, labels, best = split(text or ""), set(), 0.0
        for label, t in license_scan.TEMPLATES:
            want, width = set(t.split()), 2 * len(t.split())
            blocks = [split(line) for line in (text or "").split("\n")] + [words[a:a + width] for a in range(len(words))]
            most = max((len(want & set(b)) for b in blocks), default=0)
            if 100 * most >= 80 * len(want):
                labels.add(label)
                best = max(best, most / len(want))
        assert got[i].labels == ",".join(sorted(labels)) and got[i].score == pytest.approx(best)
        assert i not in planted or planted[i] in labels
    # lines alone lose the broken ones
    assert any(label not in r.labels.split(",") for r in license_scan.scan_licenses(docs).collect() if (label := planted.get(r.doc_id)))


# ---- conversations

def test_escapes_are_reversible(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "[", "a", "\n", "/s>", " "]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_trees.escape(F.col("t")).alias("e"))
    for r in df.select("*", chat_trees.unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.t and not any(c in r.e for c in chat_trees.CONTROLS)


def test_paths_of_trees_equal_brute_force(spark):
    rng, rows, want = random.Random(10), [], {}
    for tree in [*range(6), None]:
        size = 40 if tree == 3 else rng.randint(1, 14)
        parent = {i: (None if i == 0 else i - 1 if tree == 3 else rng.randrange(i)) for i in range(size)}
        score = {i: rng.randint(0, 3) for i in range(size)}
        rows += [(tree, i, parent[i], rng.choice(["user", "assistant", None]), f"<s>{i}", float(score[i]), "x") for i in range(size)]
        paths = []
        for leaf in set(parent) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((-sum(score[i] for i in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:2], 1):
            want[tree, rank] = path
    rows += [(99, 1, 2, "user", "circle", 0.0, "x"), (99, 2, 1, "user", "circle", 0.0, "x")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double, leaf string")
    nodes = nodes.unionByName(nodes.limit(5))
    got = chat_trees.read_back(chat_trees.conversations(nodes, best=2)).collect()
    text = {(r[0], r[1]): (r[3] or "", r[4]) for r in rows}
    assert {(r.tree, r["rank"]): [(t.role, t.text) for t in r.turns] for r in got} == {k: [text[k[0], i] for i in p] for k, p in want.items()}
    for r in got:
        assert list(r.loss) == [t.text for t in r.turns if t.role == "assistant"]
    assert chat_trees.conversations(nodes.limit(0)).count() == 0


def test_turns_with_nulls_and_ties(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 0, None, "b"), (1, 0, None, "b"), (None, None, "assistant", "x"), (1, 5, "assistant", "\\")],
                                  "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in chat_trees.read_back(chat_trees.conversations(chat_trees.turns_to_tree(turns))).collect()}
    assert got == {1: [("", "b"), ("", "b"), ("user", ""), ("assistant", "\\")], None: [("assistant", "x")]}


# ---- decontamination

def test_leaks_with_substitutions(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (40, 20, 15, 7, 3)]
    rows, want = [], set()
    for i in range(120):
        words, kind = [rng.choice(vocabulary) for _ in range(80)], i % 6
        if kind < 4:
            passage = list(items[kind])
            for k in range(kind % 2, len(passage), 6) if len(passage) > 10 and i % 2 else ():
                passage[k] = "other"
            words[30:30] = passage if i % 12 else [w.upper() + "," for w in passage]
            want.add((i, kind))
        elif kind == 4:
            words[30:30] = items[4]
        rows.append((i, " ".join(words), "en", "s", 0))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    docs = docs_of(spark, rows + [r for r in ODD]).withColumn("key", F.lit(0))
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(abs(r.first_word - 30) <= 2 and r.n_words >= len(items[r.item_id]) - 6 for r in got)
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in want})
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_best_segment_is_the_greatest():
    rng = random.Random(12)
    for _ in range(300):
        agree = [rng.random() < 0.7 for _ in range(rng.randint(0, 25))]
        value = lambda a, b: sum(1 if x else -3 for x in agree[a:b])
        best = max([0, *(value(a, b) for a in range(len(agree)) for b in range(a + 1, len(agree) + 1))])
        assert value(*decontaminate.best_segment(np.array(agree, dtype=bool))) == best


def test_leaks_equal_brute_force_over_all_stretches(spark):
    rng = random.Random(13)
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate((7, 9, 12, 13, 20, 40, 200))]
    rows, copies = [], []

    def add(item, changed):
        words = [f"n{len(rows)}x{j}" for j in range(30)]
        words[15:15] = [f"o{len(rows)}x{j}" if j in changed else w for j, w in enumerate(items[item])]
        copies.append((item, [j not in changed for j in range(len(items[item]))]))
        rows.append((len(rows), " ".join(words), "en", "s", 0))

    for item, changed in ((4, {12, 15}), (4, set(range(3, 20, 4))), (2, {11}), (2, {0}), (0, {3}), (3, {0, 12}), (6, set(range(7, 100)) | set(range(101, 190, 4)))):
        add(item, changed)
    for _ in range(150):
        item = rng.randrange(len(items))
        n = len(items[item])
        add(item, set(rng.sample(range(n), rng.randint(0, n // 3))) | set(rng.choice([(), (0,), (n - 1,), (0, n - 1)])))
    want = {}
    for doc, (item, agree) in enumerate(copies):
        n, total = len(agree), [0, *itertools.accumulate(agree)]
        hit = any(all(agree[at + j] for j, bit in enumerate(m) if bit == "1") for m in decontaminate.item_seeds(n, decontaminate.MASKS) for at in range(n - len(m) + 1))
        fits = [(b - a, total[b] - total[a], -a) for a in range(n) for b in range(a + min(13, n), n + 1) if total[b] - total[a] >= 0.75 * (b - a)]
        if hit and fits:
            size, same, first = max(fits)
            want[doc, item] = (15 - first, size, same)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_same) for r in decontaminate.find_leaks(docs_of(spark, rows), bench).collect()}
    assert got == want and {(d, copies[d][0]) for d in range(7)} <= set(got)


# ---- queries and the pipeline

def test_queries_equal_their_sql(spark):
    from annolytics.llm.queries import QUERIES
    from oracle import compare, connect
    con = connect("sf0.001")
    for name, q in QUERIES.items():
        rows, message = compare(spark, con, "sf0.001", q)
        assert message == "" and rows > 0, name


def test_pipeline_stages(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, kinds = docs.count(), docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        assert after.dtypes == kinds, name
        n = after.count()
        assert name.startswith("mixing") or 0 < n <= before
        docs, before = after, n
    assert corpus_pipeline.run(spark, folder).count() == before
