"""SimHash near-duplicates, with pigeonring filtering of the candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import few_rows, join_by_key, stored
from pagelode.llm.components import connected_components

BITS = 64
SEED = 42
#: Shingles of a text that are hashed and counted at a time.
BLOCK = 100_000
#: Texts that a Python worker gets at a time.
TEXT_ROWS = 256


def text_fingerprint(text: str | None, shingle_words: int) -> int:
    """The 64 bits of a text: each is set if set in over half of the hashes of its shingles.

    A-Z is lower-cased, words end at ASCII white space, repeats count, and fewer words than a
    shingle are one shingle. Null or wordless text gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle_words, len(words))
    shingles = len(words) - size + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, shingles, BLOCK):
        part = words[start : min(start + BLOCK, shingles) + size - 1]
        grams = zip(*(part[i:] for i in range(size)), strict=False)
        hashes = [xxhash.xxh64_intdigest(b" ".join(gram), SEED) for gram in grams]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > shingles, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint_column(text: Column, shingle_words: int) -> Column:
    """The fingerprint of a text column as a long; texts go to Python in Arrow batches."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [text_fingerprint(text, shingle_words) for text in texts], dtype="int64"
            )

    return fingerprints(text)


def segment_widths(max_bits: int) -> list[int]:
    """Widths of the `max_bits + 1` segments that the 64 bits are cut into, high bits first."""
    count = max_bits + 1
    return [BITS // count + (i < BITS % count) for i in range(count)]


def near_links(fingerprints: DataFrame, max_bits: int) -> DataFrame:
    """Pairs `(a, b)` of distinct `fp` values at 1 to `max_bits` differing bits; none is lost.

    With n = max_bits + 1 segments on a ring, fingerprints that differ in at most max_bits
    bits have a segment from which every chain of the next l segments (l = 1 .. n) differs in
    at most l * max_bits / n bits, that is in at most l - 1. So the first segment of the chain
    is equal and the second differs in one bit at most: this is the join key, one row per
    start for one side and one row per start and flipped bit for the other. The join checks
    the longer chains by their budgets, and last the whole distance. A pair is found once for
    each of its chains; the order `a < b` of the turned bits leaves one direction.
    """
    if max_bits < 1:
        return fingerprints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a < b")
    widths = segment_widths(max_bits)
    starts = range(len(widths))
    offsets = [sum(widths[:i]) for i in starts]
    rings = [widths[i:] + widths[:i] for i in starts]
    keyed = [
        fingerprints.select(
            F.lit(i).cast("byte").alias("start"),
            turned("fp", offsets[i]).alias("bits"),
            F.lit(BITS - rings[i][0] - rings[i][1]).alias("rest"),
            F.lit(rings[i][1]).alias("second"),
        )
        for i in starts
    ]
    table = reduce(DataFrame.unionByName, keyed)
    plain = F.expr("shiftrightunsigned(bits, rest)")
    flips = F.expr(
        "concat(array(0L), transform(sequence(0, second - 1), i -> shiftleft(1L, i)))"
    )
    index = table.select("start", plain.alias("key"), F.col("bits").alias("b"))
    probe = table.select(
        "start", plain.alias("plain"), F.col("bits").alias("a"), F.explode(flips).alias("flip")
    ).select("start", F.col("plain").bitwiseXOR(F.col("flip")).alias("key"), "a")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chains = reduce(or_, [(F.col("start") == i) & _within(differ, rings[i]) for i in starts])
    pairs = probe.join(index, ["start", "key"]).where((F.col("a") < F.col("b")) & chains)
    back = [F.when(F.col("start") == i, F.lit(BITS - offsets[i])) for i in starts]
    return pairs.withColumn("back", F.coalesce(*back) % BITS).select(
        _turn_back("a").alias("a"), _turn_back("b").alias("b")
    )


def turned(name: str, places: int) -> Column:
    """The bits of a long column rotated to the left."""
    if not places % BITS:
        return F.col(name)
    high = F.shiftleft(name, places)
    return high.bitwiseOR(F.shiftrightunsigned(name, BITS - places))


def _turn_back(name: str) -> Column:
    return F.expr(
        f"if(back = 0, {name}, shiftleft({name}, back) | shiftrightunsigned({name}, {BITS} - back))"
    )


def _within(differ: Column, ring: list[int]) -> Column:
    """Whether each chain from the top bits down differs in fewer bits than it has segments."""
    ends = [sum(ring[: i + 1]) for i in range(len(ring))]
    return reduce(
        and_,
        [
            F.bit_count(F.shiftrightunsigned(differ, BITS - end)) <= i
            for i, end in enumerate(ends)
            if i >= 1
        ],
    )


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 3,
) -> DataFrame:
    """One row `(id, fp, component_id, component_size)` per row of `docs`.

    Fingerprints link at `max_bits` or fewer differing bits; component_id is the smallest id
    that links reach, the row's own included. Only distinct fingerprints are compared, so a
    group of exact copies of any size is one of them. The component is joined back by
    fingerprint, where one that many documents share is broadcast. Work and output depend on
    the columns named alone; other columns of any name are ignored. A null or wordless text
    has fingerprint 0. Repeated rows are members each. A null id is never the smallest;
    component_id is null if all ids of the component are. An empty table gives no rows.
    """
    with few_rows(docs.sparkSession, TEXT_ROWS):
        rows = stored(
            docs.select(
                F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")
            ),
            "fingerprints",
        )
    groups = stored(
        rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first")), "groups"
    )
    roots = connected_components(near_links(groups.select("fp"), max_bits))
    linked = groups.join(roots.withColumnRenamed("node", "fp"), "fp")
    whole = linked.groupBy("root").agg(
        F.min("first").alias("component_id"), F.sum("n").alias("component_size")
    )
    linked = linked.select("fp", "root").join(whole, "root").drop("root")
    table = groups.join(linked, "fp", "left").select(
        "fp",
        "n",
        F.when(F.col("component_size").isNull(), F.col("first"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
        F.coalesce("component_size", "n").alias("component_size"),
    )
    return join_by_key(rows, stored(table, "components"), "fp", "n").drop("n")


def hex_digits(bits: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
