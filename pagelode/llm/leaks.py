"""Benchmark items inside documents: size-partitioned MinHash containment search."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import stored

#: Bytes of item text that are searched for in one pass over the documents; their index is
#: some twenty times as large.
BLOCK_BYTES = 2_000_000
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CACHED_WORDS = 500_000
FIELDS = ("item_id", "shared", "item_shingles")


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


def shingles_of(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(gram) for gram in zip(*(words[i:] for i in range(size)), strict=False)}


class Hasher:
    """Hashes of word shingles; words are hashed once while they fit the cache."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known, own = self.known, set(words)
        if len(known) + len(own) > CACHED_WORDS:
            known.clear()
        for word in own:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter((known[word] for word in words), dtype=np.uint64, count=len(words))

    @staticmethod
    def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
        count = max(0, len(hashes) - size + 1)
        mixed = np.zeros(count, dtype=np.uint64)
        for i in range(size):
            mixed = (mixed ^ hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        return mixed


class ItemIndex:
    """MinHash sketches of items, partitioned by shingle length and size.

    An item of n distinct shingles is contained in a set that has `need` of them or more, so
    such a set has one of any n - need + 1. The sketch of an item is the n - need + 1 smallest
    hashes of its shingles: a document with none of them does not contain the item. Sketches
    lie in partitions by the bit length of `need`, and a document is looked up only in those
    that its own size can meet. So short items meet long documents by a few hashes each, no
    item is lost, and what is found is verified on the shingles themselves.
    """

    def __init__(self, items: list[tuple], shingle_words: int, containment: float) -> None:
        self.items, hasher = [], Hasher()
        sketches: dict = defaultdict(list)
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(shingle_words, len(words))
            shingles = shingles_of(words, size)
            need = max(1, math.ceil(round(containment * len(shingles), 9)))
            hashes = np.unique(hasher.shingles(hasher.words(words), size))
            least = hashes[: max(1, len(shingles) - need + 1)]
            sketches[size, need.bit_length()].append((least, len(self.items)))
            self.items.append((key, shingles, need))
        self.partitions: dict = defaultdict(list)
        for (size, bits), parts in sorted(sketches.items(), key=lambda part: part[0]):
            hashes = np.concatenate([least for least, _ in parts])
            owners = np.concatenate([np.full(len(least), owner) for least, owner in parts])
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[hashes >> np.uint64(44)] = True
            self.partitions[size].append((bits, hashes[order], owners[order], seen))

    def contained(self, text: str | None, hasher: Hasher) -> list[tuple]:
        """`(key, shared, shingles)` for each item that the text contains."""
        words = words_of(text)
        hashes, found = hasher.words(words), []
        for size, partitions in self.partitions.items():
            grams = hasher.shingles(hashes, size)
            owners: set[int] = set()
            for bits, sketch, owned, seen in partitions:
                if bits > len(grams).bit_length():
                    break
                near = grams[seen[grams >> np.uint64(44)]]
                first = np.searchsorted(sketch, near, "left")
                last = np.searchsorted(sketch, near, "right")
                met = first < last
                for a, b in set(zip(first[met].tolist(), last[met].tolist(), strict=True)):
                    owners.update(owned[a:b].tolist())
            if not owners:
                continue
            own = shingles_of(words, size)
            for owner in sorted(owners):
                key, shingles, need = self.items[owner]
                shared = len(shingles & own)
                if shared >= need:
                    found.append((key, shared, len(shingles)))
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The distinct items in lists of about BLOCK_BYTES of text each."""
    items = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    octets = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(octets / BLOCK_BYTES))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for block in range(blocks):
        yield sorted(
            ((row["id"], row["text"]) for row in items.where(place == block).collect()),
            key=lambda item: (item[0] is None, item[0], item[1] or ""),
        )


def with_items(
    docs: DataFrame,
    text: Column,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    shingle_words: int = 5,
    containment: float = 0.8,
    name: str = "items",
) -> DataFrame:
    """`docs` with an array column of the items that each text contains.

    An entry is `(item_id, shared, item_shingles)`: an item is contained if at least
    `containment` of its distinct shingles stand in the text. A-Z is lower-cased; words are
    letters and digits; an item of fewer words than a shingle is one shingle of all its words.
    Whole texts are searched where they lie: nothing is shuffled, whatever passage many
    documents share. Items are broadcast in blocks of BLOCK_BYTES. With more than one block the
    documents are written with a number, each block is a pass over them that is written before the
    next one's broadcast is made, and the matches, which are few, are joined by the number.

    Null and wordless items are in no document, and such documents have none. Items alike in
    id and text count once. A null item id is reported as null. Documents come back as they
    are, repeated rows too, with a column called as `name` replaced; an empty item table
    gives empty arrays.
    """
    kind = dict(items.dtypes)[item_id]
    schema = f"array<struct<item_id:{kind},shared:bigint,item_shingles:bigint>>"
    blocks = item_blocks(items, item_id, item_text)
    first = ItemIndex(next(blocks), shingle_words, containment)
    second = next(blocks, None)
    context = docs.sparkSession.sparkContext
    if second is None:
        return docs.withColumn(name, _finder(context.broadcast(first), schema)(text))
    numbered = docs.withColumns({"_leak_row": F.monotonically_increasing_id(), "_leak_text": text})
    numbered = stored(numbered.drop(name), "leak-documents")
    found = []
    indexes = (ItemIndex(block, shingle_words, containment) for block in chain([second], blocks))
    for index in chain([first], indexes):
        told = context.broadcast(index)
        matches = numbered.select("_leak_row", _finder(told, schema)(F.col("_leak_text")).alias("_found"))
        found.append(stored(matches.where(F.size("_found") > 0), "leaks"))
        told.unpersist()
    own = F.array_sort(F.flatten(F.collect_list("_found")))
    matches = reduce(DataFrame.unionByName, found).groupBy("_leak_row").agg(own.alias(name))
    columns = [c for c in docs.columns if c != name]
    return numbered.join(matches, "_leak_row", "left").select(
        *columns, F.coalesce(name, F.array().cast(schema)).alias(name)
    )


def _finder(shared, schema: str):
    @F.pandas_udf(schema)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, hasher = shared.value, Hasher()
        for texts in batches:
            yield pd.Series(
                [
                    [dict(zip(FIELDS, item, strict=True)) for item in index.contained(text, hasher)]
                    for text in texts
                ],
                dtype=object,
            )

    return found
