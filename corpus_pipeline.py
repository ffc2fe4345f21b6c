"""From raw documents to a training mix, in stages that each call one operator.

A stage takes `(spark, docs, sf_dir)` and returns a DataFrame, which is written as Parquet
and read again as the `docs` of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import secrets
from pagelode.llm.common import stored
from pagelode.llm.language import identify, train
from pagelode.llm.leaks import with_items
from pagelode.llm.mixing import mix
from pagelode.llm.queries import learned_secrets, rotating_weights
from pagelode.llm.simhash import simhash_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts, texts without
    letters, and those too far from every centroid go. Labels are kept as they are."""
    docs = docs.select(COLUMNS)
    known = identify(docs, F.col("text"), train(docs.select("text", "lang")), "_language")
    return known.where(~F.col("_language.rejected")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-copies: the one of the smallest doc_id.

    Documents without an id come last in their group, by a digest of the text. Rows equal in
    id and text count as one document. The ids that go are joined away; texts are shuffled
    only if that list is too long for a broadcast.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"))
    docs = docs.select(COLUMNS).withColumn("_key", key)
    groups = stored(
        simhash_groups(docs.select("_key", "text"), "_key", shingle_words=3, max_bits=3).select(
            "id", "component_id"
        ),
        "groups",
    )
    goes = groups.where("id <> component_id").select(F.col("id").alias("_key")).distinct()
    kept = docs.join(goes, "_key", "left_anti")
    repeated = groups.where("id = component_id").groupBy("id").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["_key"])
    return kept.select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = with_items(docs.select(COLUMNS), F.col("text"), items, name="_items")
    return found.where(F.size("_items") == 0).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars counted anew for those."""
    docs = docs.select(COLUMNS)
    found = secrets.with_secrets(docs, F.col("text"), learned_secrets(docs), "_secrets")
    text = secrets.redacted(F.col("text"), F.col("_secrets"))
    length = F.when(F.size("_secrets") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of 150% of all words takes of each document, at most twice its size."""
    mixed = mix(docs, rotating_weights, budget_share=1.5, max_epochs=2.0)
    return mixed.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken"
    )


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]

#: The classifier, the fingerprints and the Markov models have no SQL; tests hold the rows
#: against plain Python versions of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
