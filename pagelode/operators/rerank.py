"""Reranking: bag-of-words cosine, and merging an order into a ranked list.

A reranker is any function from candidates (qid, query, id, title, body, bm25_rank)
to an order (qid, id, pos), pos 0 being the best. A model goes in as one that calls
`mapInPandas` or a pandas UDF on the candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions.text import bow_vector, cosine, indexed_text

Reranker = Callable[[DataFrame], DataFrame]


def bow_vectors(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): unit-length bag of words of each text."""
    return texts.select(key, F.inline_outer(bow_vector(F.col(text)))).filter(
        F.col("token").isNotNull()
    )


def with_cosine(candidates: DataFrame) -> DataFrame:
    """Add the cosine of query and candidate text. A projection: no row moves."""
    text = indexed_text(F.col("title"), F.col("body"))
    return candidates.withColumn("cosine", cosine(F.col("query"), text))


def pool_cosines(
    pool: DataFrame, asked: DataFrame, told: DataFrame, broadcast: bool
) -> DataFrame:
    """Add the cosine to each (qid, id) of the pool; 0 without a common word.

    `asked` is (qid, token, weight) of the queries and `told` (id, token, weight) of
    the pooled documents. A document is split into words once, however many pools it
    is in, and only words of the queries it is pooled for meet its own.
    """
    wanted = pool.select("qid", "id").join(asked.withColumnRenamed("weight", "asked"), "qid")
    wanted = F.broadcast(wanted) if broadcast else wanted
    dots = (
        told.join(wanted, ["id", "token"])
        .groupBy("qid", "id")
        .agg(F.sum(F.col("asked") * F.col("weight")).alias("cosine"))
    )
    dots = F.broadcast(dots) if broadcast else dots
    return pool.join(dots, ["qid", "id"], "left").withColumn(
        "cosine", F.coalesce("cosine", F.lit(0.0))
    )


def cosine_order() -> list[Column]:
    """Best cosine first; equal ones keep the order in which they came."""
    return [F.round("cosine", 9).desc(), F.col("bm25_rank").asc()]


def cosine_rerank(candidates: DataFrame) -> DataFrame:
    """The default reranker, usable alone: (qid, id, pos)."""
    order = Window.partitionBy("qid").orderBy(*cosine_order())
    return with_cosine(candidates).select(
        "qid", "id", (F.row_number().over(order) - 1).alias("pos")
    )


def resolve_order(order: DataFrame) -> DataFrame:
    """One position per (qid, id): an id named twice stands where it was named last."""
    return order.groupBy("qid", "id").agg(F.max("pos").alias("pos"))


def merge_order() -> list[Column]:
    """Sort keys of a ranked list with a left-joined order `pos`.

    Position i of n is worth n - i points and an unlisted document 0. Within a query
    n is constant, so most points first is smallest position first, unlisted last.
    A query whose order is empty keeps its BM25 order by the same keys.
    """
    return [F.col("pos").asc_nulls_last()]
