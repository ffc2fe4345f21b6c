"""Top rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.session import shared_dir, shuffle_partitions

# Rows of one key that a single ranking task may receive.
ROWS_PER_KEY = 500_000


def top_per_key(
    rows: DataFrame,
    key: str,
    order: Sequence[Column],
    limit: int,
    rank: str,
    feeding_tasks: int = 1,
    spread_by: str = "id",
) -> DataFrame:
    """The first `limit` rows of each key under `order`, numbered from 1 in `rank`.

    Each task first cuts its own rows of a key down to `limit` (the literal bound
    gives Spark's window group limit), so a ranking task sees at most
    `feeding_tasks * limit` rows of a key. Where that is too many, the key is first
    cut down in several hash slices; the slices lose no row that could be ranked. If `limit`
    itself is too many, ranks are counted in ranges of rows.
    """
    slices = -(-feeding_tasks * limit // ROWS_PER_KEY)
    if slices > 1:
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(slices)))
        sliced = Window.partitionBy(key, "_slice").orderBy(*order)
        rows = (
            rows.withColumn(rank, F.row_number().over(sliced))
            .filter(F.col(rank) <= limit)
            .drop("_slice", rank)
        )
    if limit > ROWS_PER_KEY:
        return _ranked_in_ranges(rows, key, order, limit, rank)
    ranked = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(ranked)).filter(F.col(rank) <= limit)


def _ranked_in_ranges(
    rows: DataFrame, key: str, order: Sequence[Column], limit: int, rank: str
) -> DataFrame:
    """Like one window per key, but no task has all rows of a key.

    Rows are dealt to ranges of (key, order) and written. A row's rank is its place in its
    range, and the number of rows of the key in the ranges before.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "ranges")
    rows.write.parquet(f"{path}/cut")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/cut")
    parts = max(shuffle_partitions(spark), -(-2 * rows.count() // ROWS_PER_KEY))
    dealt = rows.repartitionByRange(parts, F.col(key).asc(), *order)
    dealt = dealt.withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(f"{path}/dealt")
    dealt = spark.read.schema(dealt.schema).parquet(f"{path}/dealt")
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(key, "_range").count().select(
        key, "_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before")
    )
    own = Window.partitionBy(key, "_range").orderBy(*order)
    return (
        dealt.withColumn("_own", F.row_number().over(own))
        .join(before, [key, "_range"])
        .withColumn(rank, (F.col("_before") + F.col("_own")).cast("int"))
        .filter(F.col(rank) <= limit)
        .drop("_range", "_own", "_before")
    )
