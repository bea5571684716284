"""Operators against brute force and hand-written cases."""
import datetime
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from annolytics.functions import geometry as G
from annolytics.functions import numbers as N
from annolytics.functions import text as T
from annolytics.operators import anchor as A
from annolytics.operators import diff as D
from annolytics.operators import fidelity as X
from annolytics.operators import layout as L
from annolytics.operators import logs as H
from annolytics.operators import ordered as O
from annolytics.operators import text as S
from annolytics.plans import load_queries
from annolytics.plans.registry import Tables

TABLES = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("reverse", [False, True])
def test_ordered_scan_is_the_plain_window(spark, width, reverse):
    rnd = random.Random(width)
    data = [("hot" if rnd.random() < 0.4 else rnd.choice("abc"), i, rnd.choice([None, 1, 2, 5, -3])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    got = O.ordered_scan(df, ["k"], ["i"], F.floor(F.col("i") / width), reverse=reverse, s=O.running_sum(F.col("v")), b=O.running_sum(F.col("v"), before=True),
                         m=O.running_max(F.col("v")), lo=O.running_min(F.col("v")), last=O.last_known(F.col("v")), lb=O.last_known(F.col("v"), before=True),
                         p=O.previous(F.col("v")), n=O.running_count(), t=O.group_total(F.lit(1)))
    order = F.col("i").desc() if reverse else F.col("i").asc()
    w = Window.partitionBy("k").orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "i", "v", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("b"),
                     F.max("v").over(upto).alias("m"), F.min("v").over(upto).alias("lo"), F.last("v", True).over(upto).alias("last"), F.last("v", True).over(before).alias("lb"),
                     F.lag("v").over(w).alias("p"), F.count("*").over(upto).alias("n"), F.count("*").over(Window.partitionBy("k")).alias("t"))
    assert rows(got.select(*want.columns), "k", "i") == rows(want, "k", "i")


def test_first_rows_and_upper_median(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("aab"), rnd.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, v long, i long")
    got = rows(O.first_rows(df, ["k"], [F.col("v"), F.col("i")], 5).select("k", "v", "i", "rank"), "k", "rank")
    want = [(k, v, i, n + 1) for k in "ab" for n, (v, i) in enumerate(sorted((v, i) for kk, v, i in data if kk == k)[:5])]
    assert got == want
    medians = dict(rows(O.upper_median(df, ["k"], F.col("v"), "m"), "k"))
    for k in "ab":
        values = sorted(v for kk, v, _ in data if kk == k)
        assert medians[k] == values[len(values) // 2]


def fold(pieces):
    out = []
    for p in pieces:
        if out and (len(p.split()) < 3 or len(out[-1].split()) < 3):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def test_sentences_are_the_fold_of_their_pieces(spark):
    rnd = random.Random(5)
    texts, want = [], []
    for _ in range(200):
        pieces = [" ".join(["Word"] + ["word"] * rnd.randrange(5)) + "." for _ in range(rnd.randrange(1, 8))]
        texts.append((" ".join(pieces),))
        want.append(fold(pieces))
    df = spark.createDataFrame(texts, "t string").select(T.split_sentences("t").alias("s"))
    assert [r.s for r in df.collect()] == want


@pytest.mark.parametrize("text, want", [
    ("We follow Smith et al. They show this well. See Fig. 3 for the curve.", ["We follow Smith et al. They show this well.", "See Fig. 3 for the curve."]),
    ('He said "It is so." Then all of them left.', ['He said "It is so."', "Then all of them left."]),
    ("Proof. This holds for any graph G. Next we turn to trees.", ["Proof. This holds for any graph G. Next we turn to trees."]),
    ("The rate is 3.5 percent here. What of it then?", ["The rate is 3.5 percent here.", "What of it then?"]),
])
def test_sentence_rules(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.split_sentences("t").alias("s")).first().s == want


def overlap(a, b):
    return min(a[2], b[2]) - max(a[0], b[0]) > 2 and min(a[3], b[3]) - max(a[1], b[1]) > 2


def greedy(new, old):
    free, pairs = sorted(old, key=lambda r: r["ord"]), {}
    tests = [lambda a, o: a["text"] and a["text"] == o["text"] and a["box"] == o["box"], lambda a, o: a["box"] == o["box"],
             lambda a, o: a["text"] and a["text"] == o["text"], lambda a, o: overlap(a["box"], o["box"])]
    for test in tests:
        for a in sorted(new, key=lambda r: r["ord"]):
            if a["key"] in pairs:
                continue
            hit = next((o for o in free if (o["parent"], o["page"]) == (a["parent"], a["page"]) and test(a, o)), None)
            if hit:
                pairs[a["key"]] = hit["key"]
                free.remove(hit)
    return pairs


def test_rewrite_matching_is_the_greedy_one(spark):
    rnd = random.Random(11)

    def side(prefix, n):
        out = []
        for i in range(n):
            x, y = rnd.randrange(4) * 20, rnd.randrange(4) * 8
            out.append(dict(key=f"{prefix}{i}", parent="hot" if rnd.random() < 0.5 else rnd.choice("pq"), page=rnd.randrange(2), ord=i,
                            text=rnd.choice(["", "a", "b", "c"]), box=(x, y, x + 30, y + 12)))
        return out

    new, old = side("n", 120), side("o", 110)

    def df(records):
        cols = "key string, parent string, type string, page int, ord long, text string, comment string, place string, x0 int, y0 int, x1 int, y1 int"
        return spark.createDataFrame([(r["key"], r["parent"], "highlight", r["page"], r["ord"], r["text"], "", str(r["box"]), *r["box"]) for r in records], cols)

    got = {r.new_key: r.old_key for r in D.match_rewrite(df(new), df(old), chunk_rows=16).collect()}
    assert got == greedy(new, old)


def test_rewrite_matching_moves_rows_once_per_key_and_cuts_hot_keys(spark):
    cols = "key string, parent string, type string, page int, ord long, text string, comment string, place string, x0 int, y0 int, x1 int, y1 int"

    def side(prefix, n, places):
        rows = [(f"{prefix}{i}", None if i % 31 == 30 else "pq"[i % 2], "highlight", 1, i, ["", "a", "b", None][i * 7 % 4], "",
                 None if i % 17 == 16 else str(i % places), 0, 0, 1, 1) for i in range(n)]
        return spark.createDataFrame(rows, cols)

    new, old = side("n", 130, 9), side("o", 90, 4)
    light = D.match_rewrite(new, old, overlap=False)
    plan = light._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    hot = D.match_rewrite(new, old, overlap=False, hot_rows=0, chunk_rows=8)
    found = sorted(tuple(r) for r in light.collect())
    assert found == sorted(tuple(r) for r in hot.collect()) and {r[2] for r in found} == {"text and place", "place", "text"}
    unkeyed = {x + str(i) for x in "no" for i in range(130) if i % 31 == 30}
    assert not unkeyed & {k for r in found for k in r[:2]}


def test_repeated_marks_and_overlaps_on_hot_pages(spark):
    rnd = random.Random(2)
    data = []
    for i in range(400):
        x, y = rnd.randrange(12) * 25, rnd.randrange(10) * 9
        data.append((f"k{i}", "hot" if rnd.random() < 0.6 else rnd.choice("ab"), i, x, y, x + rnd.choice([40, 60]), y + 10))
    df = spark.createDataFrame(data, "key string, parent string, ord long, x0 int, y0 int, x1 int, y1 int")

    def covers(a, b):
        return min(a[2], b[2]) - max(a[0], b[0]) > 2 and min(a[3], b[3]) - max(a[1], b[1]) > max(2, min(a[3] - a[1], b[3] - b[1]) / 2)

    want = set()
    for k, p, o, *box in data:
        earlier = [(o2, k2, b2) for k2, p2, o2, *b2 in data if p2 == p and o2 < o]
        same = [x for x in earlier if x[2] == box]
        over = [x for x in earlier if x[2] != box and covers(box, x[2])]
        want |= {(k, "duplicate", min(same)[1])} if same else set()
        want |= {(k, "overlap", min(over)[1])} if over else set()
    assert set(rows(L.repeated_marks(df, ["parent"]), "key")) == want
    hits = {r.key: r.hits for r in L.overlapping(df, df, ["parent"]).collect()}
    assert hits == {k: sum(overlap(b, b2) for _, p2, _, *b2 in data if p2 == p) for k, p, _, *b in data}


def test_packed_boxes_without_a_flag_do_not_overlap(spark):
    rnd = random.Random(4)
    margins = [(i, [(f"b{j}", float(rnd.randrange(50, 760)), float(rnd.randrange(10, 80))) for j in range(8)],
                [(float(y), float(y + 15)) for y in rnd.sample(range(60, 700), 5)], 30.0, 760.0) for i in range(30)]
    df = spark.createDataFrame(margins, "page int, blocks array<struct<key:string,y_top:double,h:double>>, occupied array<struct<lo:double,hi:double>>, floor double, ceiling double")
    placed = L.pack_margins(df).collect()
    assert len(placed) == 240
    for page, _, occupied, *_ in margins:
        taken = [(r.y_top - r.h, r.y_top) for r in placed if r.page == page and r.flag is None]
        for i, a in enumerate(taken):
            assert all(a[1] <= b[0] or b[1] <= a[0] for b in taken[i + 1:] + occupied)
            assert a[0] >= 30 and a[1] <= 760


def walk(events):
    """The recurrence over one session, row by row."""
    prev, cur, seen, out = {}, {}, set(), []
    for e in events:
        if e["event_id"] in seen:
            continue
        seen.add(e["event_id"])
        total = {f: e[f"total_{f}"] for f in H.FIELDS if e[f"total_{f}"] is not None}
        if any(total[f] < prev[f] for f in total if f in prev):
            prev, cur = {}, {}
        same, delta = bool(cur) and "input" in total and total["input"] == prev.get("input"), {}
        for f in H.FIELDS:
            last = e[f"last_{f}"] if e[f"last_{f}"] is not None else total.get(f)
            if f in total and f in prev:
                delta[f] = total[f] - prev[f]
            elif same:
                delta[f] = last - cur[f] if last is not None else 0
            else:
                delta[f] = last or 0
            if f in total:
                prev[f] = total[f]
            elif f in prev:
                prev[f] += delta[f]
        if any(delta.values()):
            cur = {f: cur[f] + delta[f] for f in H.FIELDS} if same else dict(delta)
            out.append((e["ord"], *[delta[f] for f in H.FIELDS], same))
    return out


@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_counters_are_the_recurrence(spark, gaps):
    rnd = random.Random(8)
    data, want = [], []
    for s in (1, 2):
        total, events = dict.fromkeys(H.FIELDS, 0), []
        for i in range(400):
            if rnd.random() < 0.03:
                total = dict.fromkeys(H.FIELDS, 0)
            last = {f: rnd.randrange(1, 9) for f in H.FIELDS}
            total = {f: total[f] + last[f] for f in H.FIELDS}
            e = dict(session=s, event_id=i, ord=i * 2)
            for f in H.FIELDS:
                e[f"last_{f}"], e[f"total_{f}"] = last[f], None if rnd.random() < gaps else total[f]
            events.append(e)
            if rnd.random() < 0.1:
                events.append(dict(e, ord=i * 2 + 11))
        events.sort(key=lambda e: e["ord"])
        want += [(s, *r) for r in walk(events)]
        data += events
    cols = ["session", "event_id", "ord", *[f"{p}_{f}" for p in ("last", "total") for f in H.FIELDS]]
    df = spark.createDataFrame([tuple(e[c] for c in cols) for e in data], ", ".join(f"{c} long" for c in cols))
    pick = ["session", "ord", *H.FIELDS, "same_call"]
    assert rows(H.counter_calls_with_gaps(df, width=32).select(*pick), "session", "ord") == want
    if not gaps:
        assert rows(H.counter_calls(df, width=32).select(*pick), "session", "ord") == want


@pytest.mark.parametrize("text, comment, extra", [
    ("The cache holds 2.5 GB of pages.", "缓存可容纳 2.50GB 页面。", ""),
    ("The cache holds 2.5 GB of pages.", "缓存可容纳 25 GB 页面。", "25 gb"),
    ("It has 40M rows.", "共有 4000 万行。", ""),
    ("It has 40M rows.", "共有 4 亿行。", "4 亿"),
    ("The store keeps 2,750,000 keys.", "Der Speicher hält 2,75 Mio. Schlüssel.", ""),
    ("The store keeps 2,750,000 keys.", "Der Speicher hält 27,5 Mio. Schlüssel.", "27.5 million"),
    ("It was shown in April 2019.", "2019 年 4 月给出。", ""),
    ("We use graph neural networks.", "使用 GNN。", ""),
    ("We use graph neural networks.", "使用 CNN。", "cnn"),
    ("Latency fell to 8 ms.", "Задержка снизилась до 8 s.", "8 s"),
])
def test_coverage_of_comments(spark, text, comment, extra):
    df = spark.createDataFrame([("highlight", text, comment)], "type string, text string, comment string")
    found = X.translation_warnings(df).filter("extra <> ''").collect()
    assert (found[0].extra if found else "") == extra


def test_numbers_stay_exact(spark):
    cases = {"1e1000000": "1E1000000", "1,234.50": "12345E-1", "0.000": "0", "3 亿": "3E8", "-7.10%": "-71E-1%", "5 ms": "5 ms"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", N.numbers(F.col("s"))[0]["t"].alias("t"))
    assert {r.s: r.t for r in df.collect()} == cases


def test_closest_passage(spark):
    pages = spark.createDataFrame([(1, 1, "alpha beta gamma delta"), (1, 2, "the quick brown fox jumps over")], "doc_id long, page int, t string")
    pages = pages.select("doc_id", "page", F.transform(F.split("t", " "), lambda w, i: F.struct(
        i.alias("word_no"), w.alias("word"), F.lit(0).alias("block"), F.lit(0).alias("line"), i.alias("x0"), F.lit(0).alias("y0"), (i + 1).alias("x1"), F.lit(1).alias("y1"))).alias("words"))
    asked = spark.createDataFrame([(1, 1, "quick brwn fox")], "doc_id long, page int, phrase string")
    r = A.closest_passages(asked, A.page_index(pages), ["doc_id", "page", "phrase"]).first()
    assert (r.closest_page, r.similarity > 0.9) == (2, True)


def test_box_tests(spark):
    df = spark.range(1).select(*[f(G.box(*map(F.lit, a)), G.box(*map(F.lit, b))).alias(n) for n, f, a, b in (
        ("over", G.overlaps, (0, 0, 10, 10), (7, 7, 20, 20)), ("edge", G.overlaps, (0, 0, 10, 10), (8, 8, 20, 20)),
        ("line", G.covers, (0, 0, 10, 10), (5, 4, 15, 14)), ("next", G.covers, (0, 0, 10, 10), (5, 7, 15, 17)))])
    assert tuple(df.first()) == (True, False, True, False)


def plan_of(spark, name):
    return load_queries()[name].build(Tables(spark, TABLES))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d05_overlaps", "d06_repeated_marks", "d08_held_again", "c05_sentence_places", "c13_listed_texts", "e11_style_rules", "f12_note_versions"])
def test_no_cross_joins(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["b10_paragraphs", "b13_numbering", "a08_listing", "b17_document_index"])
def test_structuring_moves_no_rows_but_to_fill_idle_cores(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("Exchange") <= 1 and "hashpartitioning" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["h12_turns", "g03_colour_profile", "d06_repeated_marks"])
def test_results_do_not_depend_on_partitions(spark, name):
    from oracle import spark_rows
    results = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(spark_rows(load_queries()[name].build(Tables(spark, TABLES))))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_local_numbers_of_any_length(spark):
    from annolytics.functions import numbers as N
    long = "1" + ".234" * 40
    rows = [(f"es sind {long},5 km", f"es sind {long.replace('.', '')}.5 km"), ("1,234,567 und 2,5", "1234567 und 2.5"), ("a1.234 b", "a1.234 b"),
            ("12 345,6 3,4,5", "12345.6 345"), ("1.234.567,89", "1234567.89")]
    got = spark.createDataFrame(rows, "s string, want string").select(N.local_numbers(F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_sort_keys_are_not_cut(spark):
    from annolytics.functions import rules as R
    got = spark.createDataFrame([(123456, 7, 8), (12, 9_999_999, 1234567)], "p long, o long, t long").select(R.sort_key("p", "o", "t").alias("k")).collect()
    assert [r.k for r in got] == ["123456|000007|00008", "00012|999999|1234567"]


def test_documents_without_findings_or_marks_are_judged(spark):
    from annolytics.operators import checks as C
    docs = spark.createDataFrame([(1,), (2,)], "parent long")
    found = spark.createDataFrame([(1, "overlap", 5)], "parent long, kind string, key long")
    none = found.limit(0)
    assert {(r.parent, r.blocking, r.passes) for r in C.gate(docs, found, none, none, ["parent"]).collect()} == {(1, "overlap", False), (2, "", True)}
    marks = spark.createDataFrame([(1, "note", "#ff6666")], "parent long, type string, color string")
    assert {(r.parent, r.core) for r in C.core_count(marks, 1, 5, documents=docs).collect()} == {(1, 0), (2, 0)}


TURN_COLUMNS = "conv_id long, ord long, kind string, agent string, words string, text string, is_error boolean, resent boolean, compact boolean"


def _log(spark, *lines):
    rows = [(1, i, kind, agent, more.get("words"), more.get("text"), more.get("is_error", False), more.get("resent", False), more.get("compact", False))
            for i, (kind, agent, more) in enumerate(lines)]
    return H.turns(spark.createDataFrame(rows, TURN_COLUMNS), width=2)


def test_a_resent_turn_has_not_ended_and_a_compaction_answers_nothing(spark):
    log = _log(spark, ("run", "a", {"words": "why"}), ("prompt", "a", {"words": "the whole prompt"}), ("result", "a", {"text": "boom", "is_error": True}),
               ("gone", "a", {"resent": True}), ("run", "a", {"compact": True}), ("message", "a", {"text": "x"}), ("result", "a", {"text": "summary"}))
    got = H.turn_table(log).collect()
    assert [(r.user, r.reply, r.ended, r.reached, r.agent) for r in got] == [("why", None, "", True, "a")]
    assert [(r.agent, r.through) for r in H.agent_states(log).collect()] == [("a", -1)]


@pytest.mark.parametrize("point, through", [("p", 0), (None, -1)])
def test_a_rewind_without_a_point_starts_anew(spark, point, through):
    log = _log(spark, ("run", "a", {"words": "why"}), ("message", "a", {"text": "x"}), ("result", "a", {"text": "so"}), ("rewind", "a", {"text": point}))
    assert [(r.agent, r.through, r.stale) for r in H.agent_states(log).collect()] == [("a", through, None)]


def test_another_agents_answer_makes_a_seen_turn_stale(spark):
    log = _log(spark, ("run", "a", {"words": "why"}), ("message", "a", {"text": "x"}), ("run", "b", {}), ("message", "b", {"text": "y"}), ("gone", "b", {}),
               ("result", "b", {"text": "late"}))
    assert rows(H.agent_states(log).select("agent", "through", "stale"), "agent") == [("a", 0, 0), ("b", -1, None)]


def test_a_range_of_a_billion_ids_is_judged_by_its_ends(spark):
    sents = spark.createDataFrame([(1, i, 1 + i // 3, f"s{i}") for i in range(1, 6)], "doc_id long, id long, page int, text string")
    wanted = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 1, 10**9), (1, 2, 4, 3), (1, 3, 1, 4), (2, 4, 1, 1)], "doc_id long, k int, first long, last long")
    got = rows(A.resolve_ids(wanted, sents, ["doc_id", "k"]).select("k", "reason", "page", "text"), "k")
    assert got == [(0, None, 1, "s1 s2"), (1, "unknown id", None, None), (2, "broken range", None, None), (3, "several pages", None, None),
                   (4, "unknown id", None, None)]


@pytest.mark.parametrize("reach", [0.0, 3.0])
def test_pairs_of_boxes_of_all_sizes(spark, reach):
    rnd = random.Random(7)

    def some(n, first):
        made = []
        for i in range(n):
            x, y, w, h = rnd.uniform(-50, 300), rnd.uniform(-50, 300), rnd.choice([0, 0.3, 2, 8, 64, 400]), rnd.choice([0, 1, 4, 5, 200])
            made.append((rnd.choice([1, 1, 1, 2]), first + i, round(x), float(round(y)), round(x) + float(w), round(y) + float(h)))
        return [(k, i, float(x0), y0, x1, y1) for k, i, x0, y0, x1, y1 in made] + [(None, first + n, 0.0, 0.0, 1.0, 1.0), (1, first + n + 1, None, 0.0, 1.0, 1.0), (3 + first, first + n + 2, 0.0, 0.0, 9.0, 9.0)]

    a, b = some(120, 0), some(120, 1000)
    columns = "k long, i long, x0 double, y0 double, x1 double, y1 double"

    def near(m, o):
        return ((F.least(m["x1"], o["x1"]) - F.greatest(m["x0"], o["x0"]) >= -reach) & (F.least(m["y1"], o["y1"]) - F.greatest(m["y0"], o["y0"]) >= -reach))

    got = L.box_pairs(spark.createDataFrame(a, columns), spark.createDataFrame(b, columns), ["k"], near, ["i"], reach)
    got = [(r.k, r.x0, r.y0, r.x1, r.y1, r.i) for r in got.collect()]
    want = [(k, x0, y0, x1, y1, j) for k, _, x0, y0, x1, y1 in a for kk, j, u0, v0, u1, v1 in b if k == kk and None not in (k, x0, u0)
            and min(x1, u1) - max(x0, u0) >= -reach and min(y1, v1) - max(y0, v0) >= -reach]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_a_hundred_thousand_boxes_on_one_page(spark):
    n = 100_000
    at = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)) / 10
    boxes = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("key"), F.col("id").alias("ord"), at(1, 6000).alias("x0"), at(2, 7800).alias("y0"), (at(3, 80) + 4).alias("w"))
    boxes = boxes.select("k", "key", "ord", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + 4).alias("y1"))
    began = time.time()       # on cells of fixed size each box met some thousand others
    hits = L.overlapping(boxes.filter("key % 2 = 0"), boxes.filter("key % 2 = 1"), ["k"]).agg(F.count("*").alias("n"), F.sum("hits").alias("hits")).first()
    assert hits.n > 40_000 and hits.hits < 10 * n
    assert time.time() - began < 90


@pytest.mark.parametrize("width", [1, 4, 1024])
def test_ranges_of_ids_are_those_of_their_rows(spark, width):
    rnd = random.Random(width)
    sents = [(d, i, 1 + i // 7 if d else rnd.choice([1, 1, 1, 2]), rnd.choice([None, "", f"s{i}"])) for d in range(3) for i in range(-5, 60) if rnd.random() < 0.97]
    sents += [rnd.choice(sents) for _ in range(6)] + [(1, 70, None, "x"), (1, None, 1, "y"), (None, 1, 1, "z"), (2, 3, 9, "other page")]
    wanted = [(d, k, f, rnd.choice([f, f + rnd.randrange(-1, 9)])) for k, (d, f) in enumerate((rnd.choice([0, 1, 2, 5, None]), rnd.randrange(-6, 62)) for _ in range(400))]
    wanted += [(1, 500, None, 3), (1, 501, 70, 70), (1, 502, 3, None)] + [(1, 600 + n, 7, 13) for n in range(5)]
    got = A.resolve_ids(spark.createDataFrame(wanted, "doc_id long, k int, first long, last long"),
                        spark.createDataFrame(sents, "doc_id long, id long, page int, text string"), ["k"], width)
    want = []
    for d, k, f, t in sorted(wanted, key=lambda w: w[1]):
        met = sorted(((i, x, p) for dd, i, p, x in sents if None not in (dd, i, p, f, t) and dd == d and f <= i <= t), key=lambda m: (m[0], m[1] or ""))
        reason = ("broken range" if f is None or t is None or f > t else "unknown id" if {m[0] for m in met} != set(range(f, t + 1))
                  else "several pages" if len({m[2] for m in met}) > 1 else None)
        want.append((k, f, t, reason, *((None, None) if reason else (met[0][2], " ".join(m[1] for m in met if m[1] is not None)))))
    assert rows(got, "k") == want
    assert {w[3] for w in want} == {None, "broken range", "unknown id", "several pages"}


def test_wide_ranges_make_no_row_per_id(spark):
    n = 200_000
    sents = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("doc_id"), "id", F.floor(F.col("id") / 50).cast("int").alias("page"), F.lit("s").alias("text"))
    wanted = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("k"), (F.col("id") + 1).alias("first"), (F.lit(n) - F.col("id")).alias("last"))
    began = time.time()       # a row per id and citation would be a thousand million
    assert [tuple(r) for r in A.resolve_ids(wanted, sents, ["doc_id", "k"]).groupBy("reason").count().collect()] == [("several pages", 5000)]
    assert time.time() - began < 60


def test_spans_and_phrases_of_missing_pages_are_reported(spark):
    words = [(0, "alpha", 0, 0, 0.0, 0.0, 1.0, 1.0), (1, "betagamma", 0, 0, 1.0, 0.0, 2.0, 1.0)]
    pages = spark.createDataFrame([(1, 1, words)], "doc_id long, page int, words array<struct<word_no: int, word: string, block: int, line: int, x0: double, "
                                                   "y0: double, x1: double, y1: double>>")
    index = A.page_index(pages)
    wanted = spark.createDataFrame([(1, 1, "alpha", None), (1, 1, "alpha", 2), (1, 1, "delta", None), (1, 9, "alpha", None)],
                                   "doc_id long, page int, phrase string, occurrence int")
    assert rows(A.match_phrases(wanted, index).select("page", "phrase", "matches", "reason"), "page", "phrase", "occurrence") == [
        (1, "alpha", 1, None), (1, "alpha", 1, "too few occurrences"), (1, "delta", 0, "not found"), (9, "alpha", 0, "no such page")]
    spans = spark.createDataFrame([(1, 9, "alphabeta", "gammadelta", None)], "doc_id long, page int, first string, last string, occurrence int")
    assert [(r.n_spans, r.reason) for r in A.match_spans(spans, index).collect()] == [(0, "no such page")]


def test_a_batch_tried_again_is_written_once(spark, tmp_path):
    from annolytics.streaming import streams as S
    keep = S.keep_batches(str(tmp_path / "table"))
    for number, n in ((0, 3), (0, 3), (1, 2)):
        keep(spark.range(n), number)
    assert rows(spark.read.parquet(str(tmp_path / "table")).groupBy("batch").count(), "batch") == [(0, 3), (1, 2)]


def test_progress_over_several_batches_is_that_of_the_table(spark, tmp_path):
    from annolytics.streaming import streams as S
    data = spark.createDataFrame([(i % 5, i, (i * 7) % 4, i * 10) for i in range(60)], "session long, ord long, step int, used long")
    for part in range(3):
        data.filter(F.col("ord") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    kept = S.run_available(S.progress(stream, F.col("step")), mode="update")
    assert kept.select("batch").distinct().count() == 3
    assert rows(S.latest_of(kept, ["session"]), "session") == rows(S.progress(data, F.col("step")), "session")


def test_counters_hold_rows_until_their_turn_and_mark_late_ones(spark, tmp_path):
    from annolytics.streaming import streams as S
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    schema = "session string, ord long, total_input long, total_cached long, total_output long, last_input long, last_cached long, last_output long, closes boolean"
    # totals grow by 10, 20, 30, begin anew with 5 at ord 4, then 7; each list is a file and a trigger
    totals, own = {1: 10, 2: 30, 3: 60, 4: 5, 5: 12}, {1: 10, 2: 20, 3: 30, 4: 5, 5: 7}

    def run(name, files, delay):
        for ords in files:
            made = [("a", abs(o), *[totals.get(o, 0)] * 3, *[own.get(o, 0)] * 3, o < 0) for o in ords]
            spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        return sorted((r.ord, r.input, r.late) for r in S.run_available(S.counter_deltas(stream, delay)).collect())

    whole = [(o, own[o], 0) for o in own]
    assert run("closed", [[4, 5], [2], [3, 1], [-5]], None) == whole
    assert run("delayed", [[1, 4], [3], [2, 5], [-5]], 3) == whole
    # 3, the last before the new beginning, comes when 4 is taken: kept apart, not dropped
    assert run("late", [[1, 2], [4], [3], [5]], 0) == [(1, 10, 0), (2, 20, 0), (3, 30, 1), (4, 5, 0), (5, 7, 0)]


def _states(flags):
    """The state before each row, one row after the other. ``flags``: opens references, ends them, appendix, checklist."""
    out, state, seen = [], 0, False
    for opens, ends, appendix, checklist in flags:
        seen = seen or opens
        checklist = checklist and seen
        out.append((state, checklist))
        if state == 2:
            state = 0 if appendix else 2
        elif state == 1 and not ends:
            state = 1
        else:
            state = 2 if checklist and not (state == 0 and opens) else 1 if state == 0 and opens else 0
    return out


def test_region_states_are_those_of_the_automaton(spark):
    r = random.Random(5)
    texts = {"words": (0, 0, 0, 0), "references": (1, 0, 0, 0), "appendixa": (0, 1, 1, 0), "paperchecklist": (0, 1, 0, 1), "results": (0, 1, 0, 0)}
    docs = [[r.choice(list(texts)) for _ in range(r.choice([0, 1, 2, 7, 40]))] for _ in range(80)]
    made = [(d, [(i, 1, 1, x, x not in ("words", "references"), x) for i, x in enumerate(doc)]) for d, doc in enumerate(docs)]
    df = spark.createDataFrame(made, "d int, rows array<struct<row_no:int,page:int,block:int,text:string,heading:boolean,norm:string>>")
    got = {x.d: [(s.state, s.is_checklist) for s in x.s] for x in df.select("d", S.region_states(F.col("rows")).alias("s")).collect()}
    assert got == {d: _states([tuple(map(bool, texts[x])) for x in doc]) for d, doc in enumerate(docs)}


def test_items_follow_the_paragraphs(spark):
    r = random.Random(6)
    docs = [[r.choice(["para", "para", "heading", "marker", "blank"]) for _ in range(r.choice([0, 1, 3, 30]))] for _ in range(60)]
    made = [(d, [(i + 1, 1, "para" if k == "blank" else k, "" if k == "blank" else f"{k} has number {i}. Then three words more.") for i, k in enumerate(doc)])
            for d, doc in enumerate(docs)]
    df = spark.createDataFrame(made, "d int, paras array<struct<para:int,page:int,kind:string,text:string>>")
    got = {x.d: [(s.id, s.para, s.pos, s.kind, s.heading_before) for s in x.s] for x in df.select("d", S.items(F.col("paras")).alias("s")).collect()}
    for d, doc in enumerate(docs):
        want, last, head = [], 0, None
        for i, k in enumerate(doc):
            if k in ("heading", "marker"):
                want.append((None, i + 1, 0, k, None))
                head = f"heading has number {i}. Then three words more." if k == "heading" else head
                continue
            for pos in range(0 if k == "blank" else 2):
                last += 1
                want.append((last, i + 1, pos, "sentence", head if pos == 0 else None))
            head = None
        assert got[d] == want


def test_structuring_grows_with_the_lines(spark):
    def seconds(n):
        pos = F.col("id").cast("int")
        text = (F.when(pos % 8 == 7, (pos % 100).cast("string")).when(pos % 40 == 13, "5 References").when(pos % 40 == 18, "A. Paper Checklist")
                .when(pos % 40 == 22, "B Appendix").otherwise(F.concat(F.lit("Some words of line "), pos.cast("string"), F.lit(" end here. And more"))))
        line = F.struct(pos.alias("row_no"), F.floor(pos / 8).alias("page"), F.floor(pos / 4).alias("block"), text.alias("text"),
                        F.when(pos % 40 == 18, 14.0).when(pos % 40 == 22, 14.0).otherwise(10.0).alias("size"), (pos % 29 == 5).alias("bold"),
                        F.lit(1).alias("dir_x"), F.lit(0).alias("dir_y"))
        doc = spark.range(n).select(line.alias("l")).agg(F.array_sort(F.collect_list("l")).alias("lines"))
        start = time.time()
        made = doc.select(F.explode(S.items(S.paragraphs(F.col("lines")))).alias("x")).agg(F.max("x.id"), F.max("x.heading_before")).first()
        assert made[0] > n / 10
        return time.time() - start

    seconds(2_000)
    assert seconds(32_000) < 20 * seconds(2_000)


def test_character_references_are_read(spark):
    df = spark.createDataFrame([("<p>caf&eacute;&nbsp;&#8212; &#x41;&amp;lt; &copy;</p>",), ("",), (None,)], "h string")
    assert [r.t for r in df.select(T.html_text("h").alias("t")).collect()] == ["café — A&lt; ©", "", ""]


def test_margins_are_packed_like_one_step_after_the_other(spark):
    def steps(blocks, occupied, floor, ceiling, gap=3):
        """Every whole top tried in turn, down and then up."""
        taken, out = list(occupied), {}
        for i in sorted(range(len(blocks)), key=lambda i: -blocks[i][0]):
            want, h = blocks[i]
            if h > ceiling - floor:
                top, flag = ceiling, "too tall"
            else:
                want = min(max(want, floor + h), ceiling)
                free = lambda t: all(t - h >= hi + gap or t <= lo - gap for lo, hi in taken)
                tops = [t for t in [*range(want, floor + h - 1, -1), *range(want, ceiling + 1)] if free(t)]
                top, flag = (tops[0], None) if tops else (want, "no room")
            out[i] = (float(top), flag)
            taken.append((top - h, top))
        return [out[i] for i in range(len(blocks))]

    r = random.Random(9)
    pages, want = [], {}
    for page in range(300):
        ceiling = r.choice([60, 200])
        blocks = [(r.randrange(-20, ceiling + 30), r.choice([5, 14, 40, 80])) for _ in range(r.randrange(12))]
        occupied = [(a, a + r.choice([4, 12, 50])) for a in (r.randrange(ceiling) for _ in range(r.randrange(5)))]
        pages.append((page, [(f"{i:02}", float(t), float(h)) for i, (t, h) in enumerate(blocks)], [(float(a), float(b)) for a, b in occupied], 0, ceiling))
        want |= {(page, f"{i:02}"): p for i, p in enumerate(steps(blocks, occupied, 0, ceiling))}
    df = spark.createDataFrame(pages, "page int, blocks array<struct<key:string,y_top:double,h:double>>, occupied array<struct<lo:double,hi:double>>, floor int, ceiling int")
    assert {(p.page, p.key): (p.y_top, p.flag) for p in L.pack_margins(df).collect()} == want


def _first_longest_block(text, key):
    blocks = [(-n, i, j) for i in range(len(text)) for j in range(len(key)) for n in range(1, len(key) + 1)
              if text[i:i + n] == key[j:j + n] and i + n <= len(text) and j + n <= len(key)]
    return min(blocks) if blocks else None


def test_the_longest_shared_block_is_the_first_of_equal_ones(spark):
    r = random.Random(5)
    cases = [("".join(r.choice("abc") for _ in range(r.randrange(0, 25))), "".join(r.choice("abcd") for _ in range(r.randrange(0, 12)))) for _ in range(150)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, k string")
    for x in df.select("i", A.shared_block(F.col("t"), F.col("k")).alias("b")).collect():
        want = _first_longest_block(*cases[x.i])
        assert tuple(x.b) == ((-want[0], want[1], want[2]) if want else (0, None, None))


def test_no_window_that_is_alike_enough_is_lost(spark):
    import difflib
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    cases = []
    for _ in range(250):
        page = text(r.randrange(40, 160))
        at, n = r.randrange(30), r.randrange(5, 70)
        key = list(page[at:at + n])
        for _ in range(r.randrange(0, 1 + n // 9)):
            k = r.randrange(len(key))
            key[k:k + r.choice((0, 1, 1))] = r.choice(("", "x", "yz"))
            key = key or ["x"]
        cases.append((page, "".join(key) or "x"))
    cases += [("", "abc"), (text(50), ""), (None, "abcdef"), ("same text on the page".replace(" ", ""), "sametextonthepage"), ("é🙂" * 30, "é🙂" * 8 + "x")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, key string")
    for least in (0.0, 0.9, 0.95):
        kept = 0
        for x in A.with_closest_window(df, F.lit(True), least).collect():
            page, key = cases[x.i]
            block = _first_longest_block(page or "", key)
            start = max(0, block[1] - block[2]) if block else None
            ratio = difflib.SequenceMatcher(None, page[start:start + len(key)], key, autojunk=False).ratio() if block else 0.0
            kept += ratio >= max(least, 1e-9)
            assert (x.start, x.similarity) == ((start, ratio) if block and ratio >= least else (None, None)), cases[x.i]
        assert kept > 60


def test_a_snapped_phrase_takes_whole_words_and_only_of_its_own_page(spark):
    def page(doc, no, text):
        return (doc, no, [(i, w, 0, 0, 0, 0, 1, 1) for i, w in enumerate(text.split())])
    sch = "doc_id int, page int, words array<struct<word_no:int,word:string,block:int,line:int,x0:int,y0:int,x1:int,y1:int>>"
    line = "the committee approved several independent recommendations yesterday"
    index = A.page_index(spark.createDataFrame([page(1, 1, "a first page with other words"), page(1, 2, f"before that {line} and more"), page(2, 1, line)], sch))
    lost = line.replace("independent", "indepndent")
    asked = spark.createDataFrame([(1, 2, lost, None), (1, 1, lost, None), (1, 2, lost, 2), (2, 1, "nothing like it at all", None), (3, 1, lost, None)], "doc_id int, page int, phrase string, occurrence int")
    got = {(r.doc_id, r.page, r.phrase, r.occurrence): r for r in A.snap_phrases(asked, index).collect()}
    hit = got[1, 2, lost, None]
    assert (hit.how, hit.closest_page, hit.closest, hit.start) == ("snapped", 2, f"{line}", len("beforethat")) and hit.similarity >= 0.95
    assert hit.stop == hit.start + len(line.replace(" ", ""))
    assert (got[1, 1, lost, None].how, got[1, 1, lost, None].closest_page, got[1, 1, lost, None].start) == ("elsewhere", 2, None)
    assert {got[k].how for k in got if k[0] > 1 or k[3]} == {"missed"} and len(got) == 5


def test_sentences_closest_rotated_absent_and_ambiguous(spark):
    sents = spark.createDataFrame([(1, 1, 1, "Alpha beta gamma delta epsilon."), (1, 1, 2, "Short one."), (1, 1, 3, "Twice here."), (1, 2, 4, "Alpha beta gamma delta epsilon."), (1, 9, 5, "No page."), (1, 1, 6, " ")],
                                  "doc_id int, page int, id long, text string")
    words = lambda text: [(i, w, 0, 0, 0, 0, 1, 1) for i, w in enumerate(text.split())]
    sch = "doc_id int, page int, words array<struct<word_no:int,word:string,block:int,line:int,x0:int,y0:int,x1:int,y1:int>>, rotated boolean"
    index = A.page_index(spark.createDataFrame([(1, 1, words("Alpha beta gamma dellta epsilon. Twice here. Twice here."), None), (1, 2, words("Alpha beta gamma delta epsilon."), True)], sch))
    got = {r.id: r for r in A.place_sentences(S.number_repeats(sents), index).collect()}
    assert {i: r.how for i, r in got.items()} == {1: "closest", 2: "absent", 3: "ambiguous", 4: "rotated", 5: "absent", 6: "absent"}
    assert (got[1].start, got[1].stop) == (0, len("alphabetagammadelltaepsilon.")) and 0.9 <= got[1].similarity < 1
    assert got[4].start is None and got[4].stop is None


def test_sums_before_and_spans(spark):
    r = random.Random(11)
    lists = [[r.randrange(9) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 700)]
    df = spark.createDataFrame([(x,) for x in lists], "xs array<int>")
    assert [x.s for x in df.select(T.sums_before(F.col("xs")).alias("s")).collect()] == [[sum(xs[:i]) for i in range(len(xs))] for xs in lists]
    cases = [("".join(r.choice("ab") for _ in range(r.randrange(12))), r.choice(["a", "aa", "aba", "b"]), r.choice(["b", "bb", "a"])) for _ in range(200)]
    want = []
    for text, a, b in cases:
        starts = [i for i in range(len(text)) if text.startswith(a, i)]
        ends = [(i, text.find(b, i + len(a))) for i in starts]
        want.append([(i, j + len(b)) for i, j in ends if j >= 0])
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, a string, b string")
    got = df.select("i", A.find_spans(F.col("t"), F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [[tuple(s) for s in x.s] for x in got] == want


@pytest.mark.parametrize("reply, label, none, want", [
    ("Fini.\nAvertissements restants : aucun.", "Avertissements restants", "aucun", ""),
    ("Avertissements restants : aucun avertissement", "Avertissements restants", "aucun", ""),
    ("Avertissements restants : aucun texte pour la p. 3.", "Avertissements restants", "aucun", "aucun texte pour la p. 3"),
    ("Verbleibende Warnungen: keine (alles behoben)", "Verbleibende Warnungen", "keine", ""),
    ("Verbleibende Warnungen: keine Übersetzung für S. 3", "Verbleibende Warnungen", "keine", "keine Übersetzung für S. 3"),
    ("VERBLEIBENDE WARNUNGEN: 0", "Verbleibende Warnungen", "keine", ""),
    ("Verbleibende Warnungen: keine", "Remaining warnings", "none", None),
    ("Remaining warnings: none warned about", "Remaining warnings", "none", "none warned about"),
    ("Remaining warnings: none, all fixed", "Verbleibende Warnungen", "keine", ""),
    ("Offen (S. 2): zwei Sätze!", "Offen (S. 2)", "nichts", "zwei Sätze"), ("Offen (S. 2): nichts", "Offen (S. 2)", "nichts", "")])
def test_closing_lines_of_other_languages(spark, reply, label, none, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert df.select(H.closing_warnings(F.col("reply"), label, none).alias("w")).first().w == want


def test_history_keeps_both_ends_of_an_oversized_turn(spark):
    budget = 2000 - H.HISTORY_RESERVE
    turns = [(1, t, f"question {t}", f"answer {t}", None, "a") for t in range(12)]
    turns += [(2, 0, "first", "short", None, "a"), (2, 1, "Q" + 'x"' * 3000 + "?", "A" + "\u0001y" * 2000 + ".", None, "a"), (3, 0, "", None, "lost", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, user string, reply string, ended string, agent string")
    got = {(r.conv_id, r.turn): r for r in H.bounded_history(df, chars=2000).collect()}
    long = got[2, 1]
    assert long.shortened and long.form == "whole" and long.cost <= budget and len(long.user) == len(long.answer)
    assert long.user[0] == "Q" and long.user[-1] == "?" and "…" in long.user and long.answer[0] == "A" and long.answer[-1] == "."
    assert len(long.user) in H.shortening_limits(budget) and got.get((2, 0)) is None and long.omitted == 1
    assert [got[1, t].form for t in (11, 7)] == ["whole", "whole"] and got[1, 6].form == "excerpt" and not got[1, 11].shortened
    assert sum(r.cost for r in got.values() if r.conv_id == 1) <= budget and got[3, 0].answer == "(not finished: lost)"
    texts = {r.conv_id: r.handoff for r in H.history_handoffs(H.bounded_history(df, chars=2000)).collect()}
    assert texts[2].startswith("The history is cut to a limit. Earlier turns left out: 1. The latest turn is shortened.\n\n[Turn 2]\nUser: Q")
    assert texts[3] == "[Turn 1]\nUser: \nAnswer (a): (not finished: lost)" and texts[1].endswith("[Turn 12]\nUser: question 11\nAnswer (a): answer 11")


def grown_boxes(boxes, gap=3):
    """Merging one pair at a time until no two boxes are near."""
    boxes = [tuple(map(float, b)) for b in boxes]
    while True:
        pair = next(((a, b) for i, a in enumerate(boxes) for b in boxes[i + 1:] if a[0] - gap <= b[2] and b[0] - gap <= a[2] and a[1] - gap <= b[3] and b[1] - gap <= a[3]), None)
        if not pair:
            return set(boxes)
        a, b = pair
        boxes.remove(a)
        boxes.remove(b)
        boxes.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))


def test_shape_clusters_are_those_of_pairwise_growth(spark):
    rnd = random.Random(8)
    data, want = [], {}
    for page in range(12):
        boxes = []
        for _ in range([0, 1, 5, 30, 80, 200][page % 6]):
            x, y = rnd.randrange(-200, 560), rnd.randrange(-90, 760)
            boxes.append((x, y, x + rnd.choice([0, 2, 9, 30]), y + rnd.choice([0, 1, 8, 20])))
        boxes += boxes[:3] + [(300 + 12 * i, 800, 309 + 12 * i, 812) for i in range(12)]  # repeats; a chain of neighbours just in reach
        data += [(page, *b) for b in boxes]
        want[page] = {b for b in grown_boxes(boxes) if b[2] - b[0] >= 8 and b[3] - b[1] >= 8}
    df = spark.createDataFrame([*data, (1, None, 1, 2, 3)], "page int, x0 int, y0 int, x1 int, y1 int").withColumns({"width": F.lit(5000), "height": F.lit(5000)})
    found = [tuple(r) for r in C_cluster(df).select("page", *L.BOX).collect()]
    assert len(found) == len(set(found))
    assert {p: {f[1:] for f in found if f[0] == p} for p in want} == want
    assert C_cluster(df.limit(0)).count() == 0


def C_cluster(df):
    from annolytics.operators.captions import cluster_shapes
    return cluster_shapes(df, ["page"])


def test_a_crowded_page_is_clustered_by_cells(spark):
    n = F.col("id")
    dots = spark.range(100_000).select(F.lit(1).alias("page"), *[e.cast("double").alias(c) for c, e in (
        ("x0", 40 + n % 250 * 2), ("y0", 60 + n % 997 * 0.5 + F.when(n % 250 < 125, 0).otherwise(4)), ("x1", 41 + n % 250 * 2), ("y1", 61 + n % 997 * 0.5 + F.when(n % 250 < 125, 0).otherwise(4)))],
        F.lit(5000).alias("width"), F.lit(5000).alias("height"))
    lone = spark.createDataFrame([(1, 700.0, 60.0, 720.0, 80.0, 5000, 5000)], dots.schema)
    assert {tuple(r) for r in C_cluster(dots.union(lone)).select(*L.BOX).collect()} == {(40.0, 60.0, 539.0, 563.0), (700.0, 60.0, 720.0, 80.0)}


def test_places_within_half_a_point_are_one_place(spark):
    cols = "key string, parent string, type string, page int, ord long, text string, comment string, place string, x0 double, y0 double, x1 double, y1 double"

    def row(key, ord_, text, x, y, **more):
        box = (float(x), float(y), float(x) + 30, float(y) + 12)
        return tuple({"key": key, "parent": "p", "type": "highlight", "page": 1, "ord": ord_, "text": text, "comment": "", "place": str(box), **dict(zip(("x0", "y0", "x1", "y1"), box)), **more}.values())

    new = spark.createDataFrame([row("n0", 0, "a", 10.4, 10), row("n1", 1, "b", 100.5, 50), row("n2", 2, "c", 200.6, 50), row("n3", 3, "a", 10, 10.5), row("n4", 4, "x", 127.9, 64),
                                 row("n5", 5, "z", 1, 1, page=2)], cols)
    old = spark.createDataFrame([row("o0", 0, "a", 10, 10), row("o1", 1, "a", 10, 10), row("o2", 2, "q", 100, 50), row("o3", 3, "q", 200, 50), row("o4", 4, "x", 128.3, 63.7),
                                 row("o5", 5, "z", 1, 1, page=3)], cols)

    def pairs(**options):
        return {(r.new_key, r.old_key, r.how) for r in D.match_rewrite(new, old, **options).collect()}

    assert pairs(tolerance=0.5) == {("n0", "o0", "text and place"), ("n3", "o1", "text and place"), ("n1", "o2", "place"), ("n4", "o4", "text and place"), ("n2", "o3", "overlap")}
    assert pairs(overlap=False) == {("n0", "o0", "text"), ("n3", "o1", "text"), ("n4", "o4", "text")}


def test_a_full_page_is_paired_in_rounds(spark):
    n = F.col("id")
    rows = spark.range(20_000).select(F.concat(F.lit("k"), n.cast("string")).alias("key"), F.lit("p").alias("parent"), F.lit("highlight").alias("type"), F.lit(1).alias("page"), n.alias("ord"),
                                      F.concat(F.lit("t"), n.cast("string")).alias("text"), F.lit("").alias("comment"), n.cast("string").alias("place"),
                                      (n % 200 * 3).alias("x0"), (F.floor(n / 200) * 8).alias("y0"), (n % 200 * 3 + 4).alias("x1"), (F.floor(n / 200) * 8 + 6).alias("y1"))
    moved = rows.withColumns({"text": F.concat("text", F.lit("!")), "place": F.concat("place", F.lit("!")), "x0": F.col("x0") + 1, "x1": F.col("x1") + 1})
    got = D.match_rewrite(moved, rows).filter("new_key = old_key AND how = 'overlap'").count()
    assert got == 20_000


def test_idle_sessions_leave_the_state(spark, tmp_path):
    from annolytics.streaming import streams as S
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    names = "session string, ord long, step int, used long, ts timestamp"
    for day in range(6):  # each day has two sessions of its own and a row of one that goes on
        rows = [(f"{day}-{k}", day * 10 + k * 3 + i, i + k, 100 * day + k * 10 + i, datetime.datetime(2024, 1, 1 + day, 10 + i)) for k in range(2) for i in range(3)]
        rows.append(("all", day * 10 + 9, (2, 5, 1, 0, 3, 4)[day], day, datetime.datetime(2024, 1, 1 + day, 12)))
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    data = spark.read.schema(names).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = S.live_progress(stream, F.col("step"), delay="1 hour", idle_seconds=6 * 3600)
    query = made.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("update").foreachBatch(S.keep_batches(str(tmp_path / "out"))).start()
    query.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    best = {r.session: (r.step, r.used) for r in kept.groupBy("session").agg(F.max("step").alias("step"), F.max_by("used", "ord").alias("used")).collect()}
    assert best == {r.session: (r.step, r.used) for r in S.progress(data, F.col("step")).collect()}
    ended = {r.session for r in kept.filter("ended").collect()}
    assert {f"{d}-{k}" for d in range(4) for k in range(2)} <= ended and "all" not in ended
    sizes = [o.numRowsTotal for p in query.recentProgress for o in p.stateOperators]
    assert max(sizes) <= 24 and len(query.recentProgress) >= 6  # sessions of two days with their timers, not of all six
