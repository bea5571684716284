"""URL rules and a list of URLs behind a blocked Bloom filter, in DataFrame operations only."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_of

LANES, BITS_PER_URL, MAX_BLOCKS = 4, 16, 1 << 18
# Query fields that name a visit, not a page; labels that name a mirror of the same host
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
MIRRORS = r"^(www|m)\."


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    return lower_ascii(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without scheme and mirror label, path without slashes at its end, query fields sorted and without those that only
    track. Null where there is no ``://``."""
    query = F.regexp_extract(text_of(url), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(TRACKING)))
    tail = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit(""))
    whole = F.concat(F.regexp_replace(url_host(url), MIRRORS, ""), F.regexp_replace(url_path(url), r"/+$", ""), tail)
    return F.when(F.instr(text_of(url), "://") > 0, whole)


def _masks(key: Column) -> list[Column]:
    """Two bits in each 64-bit lane of a block, from a second hash of the key."""
    h = F.xxhash64(F.lit(17), key)

    def bit(i: int) -> Column:
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(LANES)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w3): the blocked Bloom filter of the column ``key``: one block per key, two bits in each of its lanes.

    It has at most ``blocks`` rows of 40 bytes, however many keys there are."""
    marked = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)])


def filter_size(n_keys: int) -> int:
    """Blocks for so many keys at 16 bits each, at most 2^18 (10 MB): the bound that lets the filter be sent to every executor.
    Beyond it more URLs pass the filter and the exact join has more to do; the verdicts stay the same."""
    return min(MAX_BLOCKS, 1 << max(4, math.ceil(math.log2(max(1, n_keys) * BITS_PER_URL / (64 * LANES)))))


def possible_hits(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) and ``possible``: whether the filter of ``listed`` (key, distinct) has the key. Null keys: false."""
    blocks = filter_size(listed.count())
    bloom = bloom_blocks(listed, blocks)
    r, b = rows.alias("r"), F.broadcast(bloom).alias("b")
    passes = F.lit(True)
    for i, mask in enumerate(_masks(F.col("r.key"))):
        passes = passes & (F.col(f"b.w{i}").bitwiseAND(mask) == mask)
    return r.join(b, F.pmod(F.xxhash64("r.key"), F.lit(blocks)) == F.col("b.block"), "left").select(
        "r.*", F.coalesce(passes & F.col("r.key").isNotNull(), F.lit(False)).alias("possible"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null where none fits. A rule (verdict, host, path) fits its host and all
    subdomains, if the path starts with the rule's. The rules are a stated list; among equals the first wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, url, host, path, canonical, rule, listed, verdict) of every row of ``pages`` (page_id, url).

    ``listed``: a column ``url`` of blocked URLs, compared in canonical form. The verdict is that of the longest fitting rule,
    else block if the URL is listed, else allow. The blocked Bloom filter, of bounded size and built by aggregation, is sent to
    the executors; only rows that pass it, listed ones and few others, are shuffled to the exact join, which removes the false
    positives. All other rows stay where they were read. Rows whose rule decides are looked up too: ``listed`` tells.

    A null url, or one without ``://``, has empty host and path, no canonical form, no rule, and is allowed. Repeated rows are each
    judged. Null and repeated list entries count once or not at all. Other columns of ``pages`` are left out. No pages: no rows.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("key"))
    keys = listed.select(canonical_url(F.col("url").cast("string")).alias("key")).where("key is not null").distinct()
    tested = possible_hits(rows, keys)
    t, k = tested.where("possible").alias("t"), keys.alias("k")
    hits = t.join(k, F.col("t.key") == F.col("k.key"), "left").select("t.*", F.col("k.key").isNotNull().alias("listed"))
    both = hits.unionByName(tested.where("not possible").withColumn("listed", F.lit(False)))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return both.withColumn("r", rule).select(
        "page_id", "url", "host", "path", F.col("key").alias("canonical"), "r.rule", "listed",
        F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
