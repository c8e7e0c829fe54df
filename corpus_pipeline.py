"""Documents in, clean tokenised documents out: five stages, each stored before the next.

Every stage works on all rows its predecessor kept and its decisions take effect. All but the last
return the columns of documents; rows with nulls, empty texts or repeated contents follow the
definitions in the operators' docstrings.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from wakeline.llm.storage import stored

TOKENIZER = "word_bpe_49k.json"
NEAR_PERCENT = 85


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, learnt from the labels outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.learn(toxicity.training_rows(docs, labels))
    return toxicity.score(docs, scorer, output="_score").where("_score < 0.5").drop("_score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal texts."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one(docs, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark windows."""
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text")
    return marked.where("not (n_hit > 0 and 20 * n_hit >= n_words)").select(*(F.col(f"`{c}`") for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens and decoded text."""
    path = public_tokenizers.path(TOKENIZER)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded").drop("text")
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: Learnt scores and token merges cannot be said in SQL; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass all stages: doc_id, lang, source, token_ids, decoded, n_tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
