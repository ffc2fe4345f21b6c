"""Ranked lexical search: posting lists cut into blocks of similar documents, with summaries."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.common import BLOCK_OPTIONS, UPPER, few_rows, short_numbers, stored

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
#: Most documents of a shard, and most documents times terms: a byte each while it is made.
SHARD_ROWS = 1024
SHARD_CELLS = 16 << 20
#: Documents that are taken from Arrow, or given to it, at a time.
TAKE_ROWS = 512
#: Documents of a block; a list of no more is one block, which is read without a summary.
BLOCK_ROWS = 128
#: Most bytes of the terms that a broadcast brings, of an index for some terms or of items.
BROADCAST_BYTES = 16 << 20


def text_terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def document_norm(length: int, documents: int, total: int) -> int:
    return 100 - 25 + (25 * length * documents) // total


def term_weight(documents: Column, df: Column) -> Column:
    ratio = (2 * documents + 2).cast("double") / (2 * df + 1).cast("double")
    return F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long")


class Shard:
    """The postings of some documents, by document and by term, and the blocks of each list.

    Documents are rows `ids`; those without id come last among equal scores. Row i has the
    terms `cols[rows[i]:rows[i + 1]]` and what an occurrence of weight 1 adds, `impacts`.
    The list of a term is `docs[lists[t]:lists[t + 1]]`, in blocks of BLOCK_ROWS. Block b of a
    long list has the summary `tops[at[b]:at[b + 1]]` of the terms `terms_of[...]`: for each
    term the largest impact in the block, rounded up to a multiple of `step`.
    """

    FIELDS = ("rows", "cols", "impacts", "lists", "docs", "first", "at", "terms_of", "tops")

    def __init__(self, ids, lengths, terms, counts, documents: int, total: int) -> None:
        self.ids = np.array([-1 if i is None else i for i in ids], dtype=np.int64)
        self.nameless = np.array([i is None for i in ids], dtype=bool)
        self.vocabulary = sorted({term for own in terms for term in own})
        number = {term: i for i, term in enumerate(self.vocabulary)}
        sizes = np.array([len(own) for own in terms], dtype=np.int64)
        self.rows = np.concatenate([[0], np.cumsum(sizes)])
        self.cols = np.array([number[term] for own in terms for term in own], dtype=np.int64)
        tf = np.array([count for own in counts for count in own], dtype=np.int64)
        norms = np.array([document_norm(n, documents, total) for n in lengths], dtype=np.int64)
        self.impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(norms, sizes))

        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(self.cols, kind="stable")
        self.docs = owner[order]
        counted = np.bincount(self.cols, minlength=len(self.vocabulary))
        self.lists = np.concatenate([[0], np.cumsum(counted)])
        self.step = max(1, -(-int(self.impacts.max(initial=0)) // 255))
        self._block(self._sketches(counted))
        self._most()

    def _sketches(self, counted: np.ndarray) -> np.ndarray:
        """Unit vectors of 32 numbers whose products tell how alike documents are: sums of
        the impacts, rare terms counting more, with a sign for each term and number."""
        hashes = np.array([zlib.crc32(term.encode()) for term in self.vocabulary], dtype=np.int64)
        signs = ((hashes[:, None] >> np.arange(32)) & 1).astype(np.float32) * 2 - 1
        worth = np.log1p(len(self.ids) / np.maximum(1, counted))
        out = np.zeros((len(self.ids), 32), dtype=np.float32)
        for start in range(0, len(self.ids), 256):
            stop = min(len(self.ids), start + 256)
            own = slice(self.rows[start], self.rows[stop])
            values = (self.impacts[own] * worth[self.cols[own]]).astype(np.float32)
            rows = self.rows[start:stop] - self.rows[start]
            if len(values):  # a row without terms would take the next one's number
                sums = np.add.reduceat(
                    np.vstack([values[:, None] * signs[self.cols[own]], np.zeros((1, 32), np.float32)]),
                    rows,
                )
                out[start:stop] = sums * (np.diff(self.rows[start : stop + 1]) > 0)[:, None]
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    def _block(self, sketches: np.ndarray) -> None:
        """Order each long list by cluster, cut it into blocks, and sum these up."""
        first, entries, cols, tops = [0], [0], [], []
        dense = np.zeros((len(self.ids), len(self.vocabulary)), dtype=np.uint8)
        rows = np.repeat(np.arange(len(self.ids)), np.diff(self.rows))
        dense[rows, self.cols] = -(-self.impacts // self.step)
        for start, stop in zip(self.lists[:-1], self.lists[1:], strict=True):
            blocks = -(-(stop - start) // BLOCK_ROWS)
            first.append(first[-1] + (blocks if blocks > 1 else 0))
            if blocks <= 1:
                continue
            own = self.docs[start:stop]
            centres = sketches[own[np.arange(blocks) * len(own) // blocks]]
            own = own[np.argsort((sketches[own] @ centres.T).argmax(axis=1), kind="stable")]
            self.docs[start:stop] = own
            for block in range(blocks):
                most = dense[own[block * BLOCK_ROWS : (block + 1) * BLOCK_ROWS]].max(axis=0)
                cols.append(np.flatnonzero(most).astype(np.int32))
                tops.append(most[cols[-1]])
                entries.append(entries[-1] + len(cols[-1]))
        self.first, self.at = np.array(first), np.array(entries)
        self.terms_of = np.concatenate(cols or [np.zeros(0, dtype=np.int32)])
        self.tops = np.concatenate(tops or [np.zeros(0, dtype=np.uint8)])

    def _most(self) -> None:
        """The largest impact of each list."""
        self.most = np.zeros(len(self.vocabulary), dtype=np.int64)
        np.maximum.at(self.most, self.cols, self.impacts)
        self.number = {term: i for i, term in enumerate(self.vocabulary)}

    def _gathered(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of some documents, and how many each of them has."""
        return _places(self.rows[docs], self.rows[docs + 1])

    def __getstate__(self) -> dict:
        state = {name: short_numbers(getattr(self, name)) for name in self.FIELDS}
        return state | {n: getattr(self, n) for n in ("ids", "nameless", "vocabulary", "step")}

    def __setstate__(self, state: dict) -> None:
        for name, value in state.items():
            whole = name in self.FIELDS and name not in ("terms_of", "tops")
            setattr(self, name, value.astype(np.int64) if whole else value)
        self._most()

    def search(self, terms: list[tuple[str, int]], best: Best) -> int:
        """Offer the documents with some of the weighted terms to `best`; returns how many were scored.

        Lists come in the order of the most they can add. Once what the rest can add is below
        the kth score, documents that are only in the rest can be left out. A block is left out
        only if its summary allows no document to reach the kth score; equal scores are looked at.
        """
        known = [(self.number[term], weight) for term, weight in terms if term in self.number]
        if not known:
            return 0
        weights = np.zeros(len(self.vocabulary), dtype=np.int64)
        for col, weight in known:
            weights[col] = weight
        cols = np.array([col for col, _ in known])
        cols = cols[np.argsort(-weights[cols] * self.most[cols], kind="stable")]
        rest = np.cumsum((weights[cols] * self.most[cols])[::-1])[::-1]
        seen = np.zeros(len(self.ids), dtype=bool)
        for col, possible in zip(cols, rest, strict=True):
            if possible < best.least:
                break
            for docs in self._blocks(col, weights, best):
                docs = docs[~seen[docs]]
                if len(docs):
                    seen[docs] = True
                    at, sizes = self._gathered(docs)
                    gains = np.concatenate([weights[self.cols[at]] * self.impacts[at], [0]])
                    starts = np.cumsum(sizes) - sizes
                    best.offer(np.add.reduceat(gains, starts), self.nameless[docs], self.ids[docs])
        return int(seen.sum())

    def _blocks(self, col: int, weights: np.ndarray, best: Best) -> Iterator[np.ndarray]:
        """The documents of a list, block by block from the highest bound, as long as one can do."""
        own = self.docs[self.lists[col] : self.lists[col + 1]]
        start, stop = self.first[col], self.first[col + 1]
        if start == stop:
            yield own
            return
        inside = slice(self.at[start], self.at[stop])
        allowed = weights[self.terms_of[inside]] * (self.tops[inside] * np.int64(self.step))
        bounds = np.add.reduceat(allowed, self.at[start:stop] - self.at[start])
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] < best.least:
                return
            yield own[block * BLOCK_ROWS : (block + 1) * BLOCK_ROWS]


def _places(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, one range after the other, and their lengths."""
    sizes = stops - starts
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), sizes


class Best:
    """The k best `(score, nameless, id)` offered so far: highest score first, then smallest id."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.nameless = np.zeros(0, bool)

    def offer(self, scores: np.ndarray, nameless: np.ndarray, ids: np.ndarray) -> None:
        enough = scores >= self.least
        if not enough.any():
            return
        self.scores = np.concatenate([self.scores, scores[enough]])
        self.nameless = np.concatenate([self.nameless, nameless[enough]])
        self.ids = np.concatenate([self.ids, ids[enough]])
        order = np.lexsort((self.ids, self.nameless, -self.scores))[: self.k]
        self.scores, self.nameless, self.ids = self.scores[order], self.nameless[order], self.ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


@dataclass
class LexicalIndex:
    """`shards (shard binary)`, `doc_freq (term, df)`, and the documents and terms there are."""

    shards: DataFrame
    doc_freq: DataFrame
    documents: int
    total: int


def build(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None
) -> LexicalIndex:
    """An index of all documents, written to the shared folder.

    Terms are the runs of letters and digits of the whole text, only A-Z lower-cased; null and
    empty texts have none and take no part. With `only (term)` the lists are those of the
    named terms, as long as these are few enough for a broadcast; counts always cover all.

    A pass over the texts writes the terms of each document. From those, each task makes
    shards of at most SHARD_ROWS documents and SHARD_CELLS documents times terms as they lie, and
    clusters and sums up their lists. A frequent term so has a bounded list in every shard, and no posting is shuffled. Documents
    with equal ids, or without, count each.
    """
    counts = "id long, length long, terms array<string>, counts array<long>"
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = stored(chosen.mapInArrow(_counted(_few(only)), counts), "lexical-terms")
    documents, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    doc_freq = counted.select(F.explode("terms").alias("term")).groupBy("term")
    shards = counted.mapInArrow(_sharded(documents, total), "shard binary")
    return LexicalIndex(
        stored(shards, "lexical-shards", **BLOCK_OPTIONS),
        stored(doc_freq.agg(F.count(F.lit(1)).alias("df")), "lexical-df"),
        documents,
        total,
    )


def search(index: LexicalIndex, terms: DataFrame, k: int = 20) -> DataFrame:
    """`(item_id, rank, id, score)`: the k documents of highest score above 0 for each item.

    `terms (item_id, term, times)` are those of the items, as `item_terms` gives them. Equal
    scores are ranked by id, documents without id last. Items are taken in blocks of about
    BROADCAST_BYTES, each a pass over the shards of its own that is written before the next
    one. Each task carries the kth score of an item from shard to shard and gives at most k
    rows of it.
    """
    spark = index.shards.sparkSession
    weight = term_weight(F.lit(index.documents), F.col("df")) * F.col("times")
    asked = terms.join(index.doc_freq, "term").select("item_id", "term", weight.alias("weight"))
    asked = stored(asked.where("weight > 0"), "lexical-items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BROADCAST_BYTES))
    found = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        told = spark.sparkContext.broadcast(_items(own))
        rows = index.shards.mapInArrow(_searched(told, k), "item_id long, id long, score long")
        with few_rows(spark):
            found.append(stored(rows, "lexical-found"))
        told.unpersist()
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (
        reduce(DataFrame.unionByName, found)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "id", "score")
    )


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """`(item_id, term, times)`; rows of one id, or all without, are one item whose terms add up."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = "id long, length long, terms array<string>, counts array<long>"
    told = rows.mapInArrow(_counted(None), counts)
    pairs = told.select(
        F.col("id").alias("item_id"), F.explode(F.arrays_zip("terms", "counts")).alias("pair")
    )
    return pairs.groupBy("item_id", F.col("pair.terms").alias("term")).agg(
        F.sum("pair.counts").alias("times")
    )


def _few(only: DataFrame | None) -> Broadcast | None:
    """The named terms for every task; None if they are too many, or none are named."""
    if only is None:
        return None
    terms = stored(only.select("term").where("term is not null").distinct(), "lexical-vocabulary")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return None
    return only.sparkSession.sparkContext.broadcast({row["term"] for row in terms.collect()})


def _items(asked: DataFrame) -> list[tuple[int | None, list[tuple[str, int]]]]:
    items: dict[int | None, list[tuple[str, int]]] = {}
    for row in asked.collect():
        items.setdefault(row["item_id"], []).append((row["term"], row["weight"]))
    return list(items.items())


def _counted(vocabulary: Broadcast | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else vocabulary.value
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), TAKE_ROWS):
                rows, taken = [], batch.slice(at, TAKE_ROWS)
                for id_, text in zip(taken.column(0).to_pylist(), taken.column(1), strict=True):
                    counts = Counter(text_terms(text.as_py()))
                    if counts:
                        kept = {t: n for t, n in counts.items() if known is None or t in known}
                        rows.append((id_, counts.total(), list(kept), list(kept.values())))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "length", "terms", "counts"])

    return count


def _sharded(documents: int, total: int):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        vocabulary: set[str] = set()

        def made() -> pa.RecordBatch:
            data = pickle.dumps(Shard(*zip(*waiting, strict=True), documents, total))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["shard"])

        for batch in batches:
            for at in range(0, batch.num_rows, TAKE_ROWS):
                taken = batch.slice(at, TAKE_ROWS)
                for row in zip(*(column.to_pylist() for column in taken.columns), strict=True):
                    waiting.append(row)
                    vocabulary.update(row[2])
                    if len(waiting) >= SHARD_ROWS or len(waiting) * len(vocabulary) >= SHARD_CELLS:
                        yield made()
                        waiting, vocabulary = [], set()
        if waiting:
            yield made()

    return shard


def _searched(told: Broadcast, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(item, terms, Best(k)) for item, terms in told.value]
        for batch in batches:
            for data in batch.column(0):
                shard = pickle.loads(data.as_py())
                for _, terms, own in best:
                    shard.search(terms, own)
        rows = [
            (item, None if nameless else id_, score)
            for item, _, own in best
            for score, nameless, id_ in zip(
                own.scores.tolist(), own.nameless.tolist(), own.ids.tolist(), strict=True
            )
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        arrays = [pa.array(list(column), pa.int64()) for column in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "id", "score"])

    return search
