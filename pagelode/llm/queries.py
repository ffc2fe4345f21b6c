"""Registered queries of the training-data operators: `(spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import chat, codes, lexical, packing, secrets, warc
from pagelode.llm.common import stored
from pagelode.llm.language import identify, train
from pagelode.llm.leaks import with_items
from pagelode.llm.licenses import scan_licenses
from pagelode.llm.mixing import mix
from pagelode.llm.quality import score_quality
from pagelode.llm.simhash import hex_digits, simhash_groups
from pagelode.llm.vectors import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its near-copies."""
    groups = simhash_groups(table(spark, sf, "documents"), shingle_words=3, max_bits=3)
    return groups.select(
        F.col("id").alias("doc_id"),
        hex_digits(F.col("fp")).alias("fingerprint"),
        "component_id",
        "component_size",
    )


def rotating_weights(sources: DataFrame) -> DataFrame:
    """Weights 3, 1, 2, repeating, by the rank of the source."""
    weights = F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0))
    return sources.withColumn("weight", F.get(weights, (F.col("rank") % 3).cast("int")))


@query
def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What a mix of 150% of all words takes of every document."""
    mixed = mix(table(spark, sf, "documents"), rotating_weights, budget_share=1.5, max_epochs=2.0)
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "taken"
    )


@query
def op8_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    found = with_items(
        table(spark, sf, "documents").select("doc_id", "text"),
        F.col("text"),
        table(spark, sf, "benchmark"),
        shingle_words=5,
        containment=0.8,
    )
    return found.select("doc_id", F.explode("items").alias("item")).select(
        "doc_id",
        "item.item_id",
        "item.shared",
        "item.item_shingles",
        (F.col("item.shared") / F.col("item.item_shingles")).alias("containment"),
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the quarter that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@query
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf, "documents")
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return identify(docs.select("doc_id", "text"), F.col("text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        "language.score",
        "language.rejected",
    )


def learned_secrets(docs: DataFrame) -> secrets.MarkovModel:
    return secrets.train(secrets.labelled_samples(docs, F.col("text"), F.col("doc_id")))


@query
def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The secrets of every document, by fixed patterns and by Markov models."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.with_secrets(docs, F.col("text"), learned_secrets(docs)).select(
        "doc_id", "secrets", secrets.base_only(F.col("secrets")).alias("base")
    )
    kinds = F.transform("base", lambda span: span["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in secrets.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("secrets")).alias("spans"),
    )


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op2_chat_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation, and one of control strings, read back from its formatted windows."""
    columns = ["conv_id", "turn", "role", "text"]
    turns = table(spark, sf, "conversations").select(columns)
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    windows = chat.chat_windows(turns.unionByName(extra))
    turn = F.slice("turns", F.col("repeated") + 1, F.greatest(F.size("turns"), F.lit(1)))
    read = windows.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("turns", turn)
    masked = F.array_join(chat.masked_texts(F.col("formatted"), F.col("mask")), "")
    part = F.struct(
        "window",
        chat.written_turns(F.col("turns")).alias("turns"),
        masked.alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        F.max("tokens").alias("most_tokens"),
    )
    texts = {
        name: F.array_join(F.transform("parts", lambda p: p[name]), "")  # noqa: B023
        for name in ("turns", "loss")
    }
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(texts["turns"], 256).alias("turns_sha256"),
        F.length(texts["loss"]).cast("long").alias("loss_chars"),
        F.sha2(texts["loss"], 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
        "most_tokens",
    )


@query
def op5_vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    return top_k(table(spark, sf, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20, scale=64.0)


@query
def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The license phrases and notices of every document."""
    found = scan_licenses(table(spark, sf, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("spans")


@query
def op7_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata and conversion records of the responses of all pages."""
    records = warc.derive(warc.page_responses(table(spark, sf, "pages")))
    return records.withColumnRenamed("key", "page_id").withColumn(
        "source_headers", F.array_join("source_headers", "\n")
    )


@query
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The quality score of every document, from the labels of some."""
    scored = score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


@query
def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as four codebook indexes, with its error and that of its label."""
    found = codes.compress(
        table(spark, sf, "embeddings"), parts=4, entries=256, rounds=4, scale=1024.0
    )
    numbers = (str(x) for book in found.codebooks for entry in book for x in entry)
    digest = F.sha2(F.lit(",".join(numbers)), 256)
    digits = F.transform("code", lambda index: F.lower(F.lpad(F.hex(index), 2, "0")))
    return codes.with_label_error(found.rows).select(
        F.col("id").alias("vec_id"),
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        digest.alias("codebooks_sha256"),
    )


@query
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 documents of the highest scores for every benchmark item."""
    terms = stored(lexical.item_terms(table(spark, sf, "benchmark")), "item-terms")
    index = lexical.build(table(spark, sf, "documents"), only=terms)
    return lexical.search(index, terms, k=20).withColumnRenamed("id", "doc_id")


@query
def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in pieces of at most 2048 tokens, packed into sequences of 2048."""
    import public_tokenizers

    pieces = packing.token_pieces(
        table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048
    )
    return packing.pack(stored(pieces, "token-pieces"), capacity=2048).withColumnRenamed("id", "doc_id")
