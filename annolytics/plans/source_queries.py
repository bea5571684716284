"""Listings, positions, fingerprints, guarded caches and sinks over the given tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import checkpoint_dir
from ..sources import files as B
from ..sources import library as S
from ..sources import sinks
from . import fixtures as fx
from .anchor_queries import TO_SENTENCES
from .fixtures import ANNOTATIONS_SQL, LOG_SQL
from .registry import Tables, query


@query("a03_listing_scan", """SELECT doc_id, md5(substr(text, 1, CASE WHEN doc_id % 2 = 0 THEN 2000 ELSE 80 END)) AS text, substr(source, 1, 80) AS comment FROM documents""")
def listing_scan(t: Tables):
    rows = t.documents.select("doc_id", "text", F.col("source").alias("comment"),
                              F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(R.OWN_TAGS[0]))).otherwise(F.array(F.lit("mine"))).alias("tags"))
    return S.list_annotations(rows).select("doc_id", F.md5("text").alias("text"), "comment")


@query("a03_note_listing", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN md5(html) END AS html,
  substr(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), 1, 200) AS title FROM pages""")
def note_listing(t: Tables):
    rows = t.pages.select("page_id", "html", F.when(F.col("page_id") % 3 == 0, F.array(F.lit(R.OWN_TAGS[0]))).otherwise(F.array(F.lit("mine"))).alias("tags"))
    return S.list_notes(rows).select("page_id", F.md5("html").alias("html"), "title")


@query("a04_positions", ANNOTATIONS_SQL, """SELECT key, CASE WHEN page % 9 <> 4 THEN page END AS page_index, CASE WHEN page % 9 = 4 THEN 0 WHEN page % 5 = 2 THEN 2 ELSE 1 END AS n,
  CASE WHEN page % 9 <> 4 THEN CAST(x1 AS DOUBLE) END AS x1 FROM annotations""")
def positions(t: Tables):
    def s(c):
        return F.col(c).cast("string")
    rect = F.concat(F.lit("["), F.concat_ws(",", s("x0"), s("y0"), s("x1"), s("y1")), F.lit("]"))
    more = F.when(F.col("page") % 5 == 2, F.concat(F.lit(","), rect, F.lit(",[1,2,3]"))).otherwise("")
    raw = F.when(F.col("page") % 9 == 4, "{broken").otherwise(F.concat(F.lit('{"pageIndex":'), s("page"), F.lit(',"rects":['), rect, more, F.lit("]}")))
    rows = fx.annotations(t).select("key", S.parse_position(raw).alias("p"))
    return rows.select("key", "p.page_index", F.size("p.rects").alias("n"), F.get("p.rects", F.lit(0))["x1"].alias("x1"))


CACHE = """cache AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 3 <> 0)"""


def _cache(t: Tables):
    d = F.col("doc_id")
    return t.documents.filter(d % 3 != 0).select("doc_id", F.when(d % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).when(d % 7 == 0, None)
                                                 .otherwise(S.content_fingerprint("text")).alias("sha256"))


@query("a05_guarded_cache", CACHE, """SELECT 'fresh' AS state, doc_id FROM cache c WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.doc_id AND sha256(d.text) = c.sha256)
UNION ALL SELECT 'stale', doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE d.doc_id = c.doc_id AND sha256(d.text) = c.sha256)""")
def guarded_cache(t: Tables):
    current = t.documents.select("doc_id", S.content_fingerprint("text").alias("sha256"))
    fresh = S.fresh_rows(_cache(t), current).select(F.lit("fresh").alias("state"), "doc_id")
    return fresh.unionByName(S.stale_documents(_cache(t), current).select(F.lit("stale").alias("state"), "doc_id"))


@query("a06_fingerprints", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprints(t: Tables):
    return t.documents.select("doc_id", S.content_fingerprint("text").alias("sha256"))


@query("a06_changed_rows", """SELECT coalesce(a.doc_id, b.doc_id) AS path, a.sha256 AS was, b.sha256 AS now
FROM (SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 7 <> 0) a
FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id % 11 <> 0) b ON a.doc_id = b.doc_id
WHERE a.sha256 IS DISTINCT FROM b.sha256""")
def changed_rows(t: Tables):
    """Documents that are gone, new or other than before."""
    d = F.col("doc_id")
    before = t.documents.filter(d % 7 != 0).select(d.alias("path"), S.content_fingerprint("text").alias("sha256"))
    after = t.documents.filter(d % 11 != 0).select(
        d.alias("path"), S.content_fingerprint(F.when(d % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha256"))
    return S.changed_files(before, after)


# Log files: sixteen, each with the lines of its sessions
FILES_SQL = """file_lines AS (SELECT session % 16 AS file, session, ord, raw, strlen(raw) + 1 AS n FROM log),
placed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY file ORDER BY session, ord, raw ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "next", CAST(sum(n) OVER (PARTITION BY file) AS BIGINT) AS length FROM file_lines)"""


def _log_files(t: Tables, lines) -> str:
    path = f"{checkpoint_dir(t.spark)}/logs-{uuid.uuid4().hex}"
    rows = lines.withColumn("file", F.col("session") % 16).repartition("file").sortWithinPartitions("file", "session", "ord", "raw")
    rows.select("file", "raw").write.partitionBy("file").text(path)
    return path


def _file():
    return F.regexp_extract("path", r"file=(\d+)", 1).cast("long")


@query("a06_changed_files", LOG_SQL, FILES_SQL, """before AS (SELECT file, sha256(string_agg(raw || chr(10), '' ORDER BY session, ord, raw)) AS sha256 FROM placed WHERE file <> 3 GROUP BY file),
after AS (SELECT file, sha256(string_agg(raw || chr(10), '' ORDER BY session, ord, raw)) AS sha256 FROM placed WHERE file <> 5 AND NOT (file % 4 = 2 AND ord % 100 = 0) GROUP BY file)""",
       """SELECT coalesce(a.file, b.file) AS file, a.sha256 AS was, b.sha256 AS now FROM before a FULL JOIN after b ON a.file = b.file WHERE a.sha256 IS DISTINCT FROM b.sha256""")
def changed_files(t: Tables):
    """Files that are gone, new or of other content, by their fingerprints."""
    lines, file = fx.log_lines(t), F.col("session") % 16
    prints = lambda rows: B.file_fingerprints(t.spark, _log_files(t, rows)).select(_file().alias("path"), "sha256")
    changed = S.changed_files(prints(lines.filter(file != 3)), prints(lines.filter((file != 5) & ~((file % 4 == 2) & (F.col("ord") % 100 == 0)))))
    return changed.withColumnRenamed("path", "file")


@query("a11_byte_lines", LOG_SQL, FILES_SQL, """SELECT file, "next" - n AS "at", "next", md5(raw) AS raw FROM placed WHERE file % 3 <> 1 OR "next" - n >= length // 2""")
def byte_lines(t: Tables):
    """The lines of log files behind an offset: of every third file the second half, others have no offset or are shorter than theirs."""
    path = _log_files(t, fx.log_lines(t))
    offsets = B.list_files(t.spark, path).filter(_file() % 3 != 0).select("path", F.when(_file() % 3 == 1, F.floor(F.col("length") / 2)).otherwise(F.col("length") + 10).alias("offset"))
    return B.new_file_lines(t.spark, path, offsets, block=1 << 16).select(_file().alias("file"), "at", "next", F.md5("raw").alias("raw"))


@query("a07_sentence_sink", *TO_SENTENCES, "SELECT page, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM sentences GROUP BY page")
def sentence_sink(t: Tables):
    path = f"{checkpoint_dir(t.spark)}/sentences-{uuid.uuid4().hex}"
    back = sinks.write_table(fx.sentences(t), path, sort_by=["doc_id", "id"])
    return back.groupBy("page").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
