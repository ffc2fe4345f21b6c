"""BM25 arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# BM25 parameters and the smallest rerank pool.
K1 = 1.2
B = 0.75
MIN_POOL = 20


def known_df(df: Column) -> Column:
    """Document frequency, with unseen terms counted as seen once."""
    return F.coalesce(F.nullif(df, F.lit(0)), F.lit(1))


def idf(n: Column, df: Column) -> Column:
    n = n.cast("double")
    df = known_df(df).cast("double")
    return F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def term_score(
    idf_value: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B
) -> Column:
    """What one occurrence of a query term adds to the score of one document."""
    tf = tf.cast("double")
    norm = F.lit(1.0 - b) + F.lit(b) * dl.cast("double") / avgdl
    return idf_value * (tf * F.lit(k1 + 1.0)) / (tf + F.lit(k1) * norm)


def pool_size(k: Column) -> Column:
    """How many of the best documents of a query are reranked."""
    return F.greatest(F.lit(MIN_POOL), k)
