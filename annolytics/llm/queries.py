"""One query per operator: its own whole table, production parameters, the columns that are asked for."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Query, Tables
from . import chat_trees, decontaminate, fill_middle, jaccard, license_scan, line_quality, mixing, token_cache, toxicity, url_filter, vector_codes, vector_dedup, warc_dict
from .common import scratch
from .sql import CHAT_SQL, CODES_SQL, FIM_SQL, JACCARD_SQL, LICENSE_SQL, QUALITY_SQL, URL_SQL, WARC_SQL

QUERIES: dict[str, Query] = {}

TOKENIZER = "piece_bpe_32k.model"
# Rules as (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
# Words of a host name by which its pages come onto the list of blocked URLs
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = Query(name, build, sql)
        return build
    return add


@register("op1_warc_dictionary", WARC_SQL)
def warc_dictionary(t: Tables) -> DataFrame:
    manifest = warc_dict.write_archives(t.pages)
    return warc_dict.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_line_quality", QUALITY_SQL)
def quality(t: Tables) -> DataFrame:
    return line_quality.judge(t.documents, carry=["doc_id"]).select(
        "doc_id", *line_quality.MEASURES, "base_failed", "kept")


@register("op3_pivotal_mix")
def pivotal_mix(t: Tables) -> DataFrame:
    return mixing.per_row(mixing.decide(t.documents)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The URLs that a check of host names has put on the list."""
    words = F.split(url_filter.url_host(F.col("url")), "[.-]")
    return pages.where(F.arrays_overlap(words, F.array(*[F.lit(w) for w in LISTED_WORDS]))).select("url")


@register("op4_url_filter", URL_SQL)
def urls(t: Tables) -> DataFrame:
    return url_filter.judge_urls(t.pages, listed_urls(t.pages), RULES).select("page_id", "host", "path", "rule", "verdict")


def fold(doc_id: str = "doc_id"):
    """The fold of an id: rows of fold 1 are held out."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")), F.lit(3))


@register("op5_toxicity")
def toxic(t: Tables) -> DataFrame:
    model = toxicity.train(t.documents, t.labels.where(fold() != 1))
    scored = toxicity.score(t.documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@register("op6_token_counts")
def token_counts(t: Tables) -> DataFrame:
    import public_tokenizers
    cache = scratch(t.spark, "tokens")
    return token_cache.count_tokens(t.documents.select("doc_id", "text"), cache, public_tokenizers.path(TOKENIZER)).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op7_jaccard_join", JACCARD_SQL)
def jaccard_join(t: Tables) -> DataFrame:
    return jaccard.near_duplicates(t.documents, n=3, percent=90)


@register("op8_license_scan", LICENSE_SQL)
def licenses(t: Tables) -> DataFrame:
    return license_scan.scan_licenses(t.documents.select("doc_id", "text"))


@register("op8_wrapped_licenses")
def wrapped_licenses(t: Tables) -> DataFrame:
    return license_scan.scan_licenses(t.documents.select("doc_id", "text"), wrapped=True)


@register("op9_chat_trees", CHAT_SQL)
def chats(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = t.spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    trees = chat_trees.turns_to_tree(turns.unionByName(extra))
    back = chat_trees.read_back(chat_trees.conversations(trees))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@register("op10_spaced_seeds")
def leaks(t: Tables) -> DataFrame:
    return decontaminate.find_leaks(t.documents, t.benchmark).select("doc_id", "item_id", "first_word", "n_words", "n_same", "coverage")


@register("op11_vector_codes", CODES_SQL)
def codes(t: Tables) -> DataFrame:
    return vector_codes.compress(t.embeddings).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@register("op12_fill_middle", FIM_SQL)
def fim(t: Tables) -> DataFrame:
    made = fill_middle.fill_middle(t.documents.select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", F.col("first_cut").alias("prefix_chars"), (F.col("second_cut") - F.col("first_cut")).alias("middle_chars"),
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


@register("op13_vector_dedup")
def near_vectors(t: Tables) -> DataFrame:
    return vector_dedup.near_duplicates(t.embeddings)


def queries() -> dict:
    def runner(q: Query):
        return lambda spark, sf_dir: q.build(Tables(spark, sf_dir))

    return {name: runner(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
