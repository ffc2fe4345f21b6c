"""Pieces that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.session import session_conf, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word ends at ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters and digits; every character beyond ASCII counts as a letter.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: At most so many keys can each hold more than one part in so many of all rows.
HEAVY_KEYS = 10_000


def ascii_lower(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("long")


#: Rows that hold a whole block of others are megabytes each: row groups of few rows.
BLOCK_OPTIONS = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.block.row.count.limit": "8",
}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written to the shared folder and read back: what follows never runs it again."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """Jobs inside read and hand over so few rows at a time, as blocks are megabytes each."""
    conf = {
        "spark__sql__parquet__columnarReaderBatchSize": str(rows),
        "spark__sql__execution__arrow__maxRecordsPerBatch": str(rows),
    }
    with session_conf(spark, **conf):
        yield


def join_by_key(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` with the columns of `table`, which has one row for every key of `rows`.

    `count` is the column of `table` that says how many rows have the key. Keys that hold
    more than one part in HEAVY_KEYS of all rows are joined by a broadcast, which so has at
    most HEAVY_KEYS rows; no task gets all rows of such a key. The other keys are shuffled.
    Null keys match each other. Both inputs should be stored, since each is read twice.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    table = table.withColumn("_key", key_of(key)).drop(key)
    rows = rows.withColumn("_key", key_of(key))
    heavy = F.col(count) > total / HEAVY_KEYS
    wide, narrow = F.broadcast(table.where(heavy)), table.where(~heavy)
    few = rows.join(F.broadcast(table.where(heavy).select("_key")), "_key", "left_anti")
    joined = rows.join(wide, "_key").unionByName(few.join(narrow, "_key"))
    return joined.drop("_key")


def key_of(name: str) -> Column:
    """A column as a join key in which null equals null."""
    return F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("key"))


def short_numbers(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers in the shortest integer type that holds them; Python's integers stay."""
    if numbers.dtype == object or not numbers.size:
        return numbers
    ends = (np.min_scalar_type(int(end)) for end in (min(0, numbers.min()), numbers.max()))
    return numbers.astype(np.result_type(*ends))
