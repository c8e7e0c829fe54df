"""Registered queries: each operator, with production parameters, over its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import bpe, decontaminate, exact_dedup, filter_audit, license_scan, line_dedup, near_dedup, ngram, passages, toxicity, url_filter, warc, whitening

TOKENIZER = "word_bpe_49k.json"
NEAR_PERCENT = 85


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, decoded="decoded").select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trained = ~ngram.held_out(F.col("doc_id"))
    model = ngram.learn(docs.where(trained).select("text"))
    scored = ngram.score(docs, model, trained=trained)
    return scored.select(
        "doc_id", ngram.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a fetch time: a day of 2024 and second that follow from the page id."""
    seconds = F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(366)) * 86400 + F.pmod(F.col("page_id") * 104729, F.lit(86400))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(seconds).alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated changes of two lists, derived from the hosts, domains and first path steps of the pages."""
    urls = table(spark, sf_dir, "pages").select(F.col("url"))
    host = url_filter.host(F.col("url"))
    hosts = urls.select(F.lit("host").alias("kind"), host.alias("pattern"))
    domains = urls.select(F.lit("domain").alias("kind"), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern"))
    steps = urls.select(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.regexp_extract(url_filter.path(F.col("url")), r"^/([^/]+)", 1)).alias("pattern"))
    patterns = hosts.unionByName(domains).unionByName(steps).where("pattern <> '' and pattern not like '%/'").distinct()
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "pattern")), 1, 6), 16, 10).cast("long")
    x = patterns.withColumn("x", number).where("x % 3 = 0")
    x = x.withColumn("list", F.when(F.col("kind") == "prefix", "allow").otherwise("block")).withColumn("first", F.col("x") % 200)
    turns = F.array(
        F.struct(F.lit("add").alias("action"), F.col("first").alias("day")),
        F.struct(F.when(F.col("x") % 2 == 0, "remove").otherwise("add").alias("action"), (F.col("first") + 30 + F.col("x") % 50).alias("day")),
        F.struct(F.when(F.col("x") % 5 == 0, "add").otherwise("remove").alias("action"), (F.col("first") + 120).alias("day")),
    )
    rows = x.select("list", "kind", "pattern", F.explode(turns).alias("turn"))
    changed = F.timestamp_seconds(F.lit(1704067200) + F.col("turn.day") * 86400)
    return rows.select("list", "kind", "pattern", "turn.action", changed.alias("changed_at"))


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(captures(spark, sf_dir), list_entries(spark, sf_dir))
    return judged.select(
        "page_id", url_filter.host(F.col("url")).alias("host"), F.unix_seconds("fetched_at").alias("fetched"),
        "n_block", "n_allow", F.unix_seconds("since").alias("since"), "verdict",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs.select("doc_id", "text"), scorer)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), NEAR_PERCENT)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), every_row=True)
    return found.select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), "refers_to",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_lm_score, op3_url_lists, op4_exact_dedup, op5_substring_dedup, op6_toxicity,
        op7_line_dedup, op8_decontamination, op9_near_dedup, op10_warc, op11_whitening, op12_license_scan, op13_filter_audit,
    )
}
