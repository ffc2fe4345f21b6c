"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.common import join_by_key, key_of, stored, word_count

#: Hexadecimal digits of the draw that make up a bin: 4096 bins for each source.
BIN_DIGITS = 3


def source_ranks(sources: DataFrame) -> DataFrame:
    """`sources` with `rank` from 0 by the order of `source`, nulls last, over any number of rows.

    Rows are dealt by range and numbered in their partition; only one count per partition is
    summed up in one place.
    """
    ordered = F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name"))
    dealt = stored(
        sources.withColumn("_order", ordered)
        .repartitionByRange("_order")
        .withColumn("_part", F.spark_partition_id()),
        "sources",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    return (
        dealt.join(parts, "_part")
        .withColumn("rank", F.col("_before") + inside - 1)
        .drop("_part", "_order", "_before")
    )


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """`sources (source, source_size, weight)` with `target`, their share of `budget`.

    Every source gets its share by weight. Those whose share is above max_epochs times their
    size are clamped there, and what is left goes to the others by weight, again until none
    is above. Each round is one aggregate over the sources whose sums alone come to the
    driver, and clamps at least one source more; the level only rises, so a clamped one
    stays so. If all are clamped, the budget can't be spent and each target is its cap. A
    source of null or zero weight gets 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    level, clamped = 0.0, -1
    while True:
        above = weight * F.lit(level) > cap
        count, spent, left = sources.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, weight)), F.lit(0.0)),
        ).first()
        if count == clamped or left <= 0:
            break
        level, clamped = max(0.0, budget - spent) / left, count
    return sources.withColumn("target", F.least(cap, weight * F.lit(level)))


def mix(
    docs: DataFrame,
    weights,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: `(id, size, source, source_size, target, epochs, taken)`.

    `weights` turns a table of sources `(source, rank)` into the same with `weight`. A source
    is taken target / source_size times: each document as often as that number has wholes,
    and the part left over goes to the documents in the order of a seeded draw until it is
    spent, the last of them with the words that are still missing. So the words of a source
    add up to its rounded target, no document exceeds max_epochs rounded up times its size,
    and a rerun takes the same. The draw is the MD5 of seed, id and size; its first digits are
    a bin, the words of bins are summed per source, and only the documents of the one bin in
    which the part ends are ordered, 1 in 4096 of a source. `epochs` is the exact repetition
    of the document, taken / size.

    Null text has size 0 and is taken 0 times; a null source is a source of its own; a null
    id draws like an empty one; documents alike in id and size are interchangeable, and repeated
    rows are documents each. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    draw = F.md5(F.concat_ws(":", F.lit(seed), name, "size").cast("binary"))
    rows = stored(rows.withColumn("draw", draw), "sizes")
    bin_of = F.conv(F.substring("draw", 1, BIN_DIGITS), 16, 10).cast("int")
    bins = stored(
        rows.groupBy("source", bin_of.alias("bin")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        ),
        "bins",
    )
    sources = bins.groupBy("source").agg(
        F.sum("words").alias("source_size"), F.sum("n").alias("n")
    )
    sources = stored(weights(source_ranks(sources)), "weights")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    targets = water_fill(sources, budget_share * total, max_epochs)
    aim = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(aim / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole).withColumn(
        "part", aim - F.col("whole") * F.col("source_size")
    )
    before = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        bins.withColumn("k", key_of("source"))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(targets.select(key_of("source").alias("k"), "part"), "k")
        .where("before < part and part <= before + words")
        .select("k", F.col("bin").alias("end_bin"), (F.col("part") - F.col("before")).alias("missing"))
    )
    table = targets.withColumn("k", key_of("source")).join(ends, "k", "left")
    table = stored(
        table.select("source", "n", "source_size", "target", "whole", "end_bin", "missing"), "targets"
    )
    joined = join_by_key(rows, table, "source", "n").drop("n").withColumn("bin", bin_of)
    inside = joined.where("bin = end_bin")
    outside = joined.where("end_bin is null or bin <> end_bin").withColumn(
        "more", F.when(F.col("bin") < F.col("end_bin"), F.col("size")).otherwise(F.lit(0))
    )
    order = (
        Window.partitionBy("source")
        .orderBy("draw", "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    open_words = F.col("missing") - F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), open_words)))
    taken = F.col("whole") * F.col("size") + F.col("more")
    return outside.unionByName(inside).select(
        "id",
        "size",
        "source",
        "source_size",
        "target",
        F.when(F.col("size") > 0, taken / F.col("size")).otherwise(F.lit(0.0)).alias("epochs"),
        taken.cast("long").alias("taken"),
    )
