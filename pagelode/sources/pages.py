"""Page, page-log and query tables in the shape the index and the search expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.schemas import PAGE, PAGE_FIELDS

# The demonstration corpus.
SEED_PAGES = (
    (
        "1",
        "https://example.com",
        "Example Domain",
        "This domain is for use in illustrative examples in documents.",
    ),
    (
        "2",
        "https://golang.org",
        "Go",
        "Go is an open source programming language that makes it easy to build simple, "
        "reliable, and efficient software.",
    ),
)


def seed_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEED_PAGES), PAGE)


def as_pages(
    table: DataFrame,
    id: str | Column,
    url: str | Column | None = None,
    title: str | Column | None = None,
    body: str | Column | None = None,
    seq: str | Column | None = None,
) -> DataFrame:
    """View a table as pages; absent or null text becomes ''.

    `seq` orders the versions of a page. Any orderable type will do, structs too.
    """
    given = dict(zip(PAGE_FIELDS, (id, url, title, body), strict=True))
    columns = [
        (F.lit("") if value is None else F.coalesce(_column(value).cast("string"), F.lit(""))).alias(
            name
        )
        for name, value in given.items()
    ]
    if seq is not None:
        columns.append(_column(seq).alias("seq"))
    return table.select(*columns)


def as_queries(table: DataFrame, qid: str | Column, query: str | Column, k: int | str | Column) -> DataFrame:
    """View a table as search requests; a missing k means 0, so no results."""
    k = F.lit(k) if isinstance(k, int) else _column(k)
    return table.select(
        _column(qid).cast("string").alias("qid"),
        F.coalesce(_column(query).cast("string"), F.lit("")).alias("query"),
        F.coalesce(k.cast("int"), F.lit(0)).alias("k"),
    )


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
