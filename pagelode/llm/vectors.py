"""Exact top-k by inner product, with a KD-tree for every shard of the vectors."""

from __future__ import annotations

import heapq
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.common import BLOCK_OPTIONS, few_rows, short_numbers, stored

SHARD_ROWS = 8192
#: Most queries of one broadcast, and about its most bytes.
QUERY_ROWS = 16_384
QUERY_BYTES = 32 << 20
LEAF_ROWS = 64
LONG_MAX = 2**63 - 1
#: A result `(-score, without id, id)`: the best ones sort first.
Found = tuple[int, bool, int]


class KdTree:
    """A balanced tree over integer vectors: median splits, tight boxes, best-first search.

    A node covers a range of the vectors as the splits have ordered them. Numbers are float64 while
    every inner product is exact in it, else Python's integers.
    """

    def __init__(
        self, rows: np.ndarray, ids: np.ndarray, nameless: np.ndarray, vectors: np.ndarray,
        leaf_rows: int = LEAF_ROWS,
    ) -> None:
        order, lows, highs, ranges = np.arange(len(rows)), [], [], []
        pending = [(0, len(rows))]
        self.children: list[tuple[int, int] | None] = []
        at = 0
        while at < len(pending):
            start, stop = pending[at]
            own = vectors[order[start:stop]]
            low, high = own.min(axis=0), own.max(axis=0)
            lows.append(low)
            highs.append(high)
            ranges.append((start, stop))
            spread = high - low
            axis = int(np.argmax(spread)) if spread.size else 0
            if stop - start > leaf_rows and spread.size and spread[axis] > 0:
                middle = (stop - start) // 2
                values = own[:, axis].astype(np.float64)
                order[start:stop] = order[start:stop][np.argpartition(values, middle)]
                self.children.append((len(pending), len(pending) + 1))
                pending += [(start, start + middle), (start + middle, stop)]
            else:
                self.children.append(None)
            at += 1
        self.ranges = ranges
        self.lows, self.highs = np.array(lows), np.array(highs)
        self.rows, self.ids, self.nameless = rows[order], ids[order], nameless[order]
        self.sorted = vectors[order]

    def __getstate__(self) -> dict:
        state = {name: short_numbers(getattr(self, name)) for name in ("sorted", "lows", "highs")}
        return self.__dict__ | state

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        for name in ("sorted", "lows", "highs"):
            numbers = state[name]
            setattr(self, name, numbers if numbers.dtype == object else numbers.astype(np.float64))

    def exact_with(self, most: float) -> KdTree:
        """The tree itself, or with Python's integers if products with such components need them."""
        own = max(np.abs(ends.astype(np.float64)).max(initial=0.0) for ends in (self.lows, self.highs))
        if self.sorted.dtype == object or own * most * max(1, self.sorted.shape[1]) < 2**52:
            return self
        other = object.__new__(KdTree)
        other.__dict__ |= self.__dict__
        for name in ("sorted", "lows", "highs"):
            setattr(other, name, getattr(self, name).astype(np.int64).astype(object))
        return other

    def search(self, own: int, query: np.ndarray, k: int, best: list[Found]) -> list[Found]:
        """`best` with the k best of it and of this tree, but for the row `own`.

        Nodes are visited in the order of the highest inner product that their box allows. The
        kth score found so far, in this shard or one before, ends the search when no box left
        can reach it; boxes that can only tie it are still opened.
        """
        tops = np.maximum(query, 0) @ self.highs.T + np.minimum(query, 0) @ self.lows.T
        heap, found = [(-tops[0], 0)], best
        kth = -best[-1][0] if len(best) >= k else None
        while heap:
            top, node = heapq.heappop(heap)
            if kth is not None and -top < kth:
                break
            if children := self.children[node]:
                for child in children:
                    if kth is None or tops[child] >= kth:
                        heapq.heappush(heap, (-tops[child], child))
                continue
            start, stop = self.ranges[node]
            scores = self.sorted[start:stop] @ query
            keep = self.rows[start:stop] != own
            if kth is not None:
                keep &= (scores >= kth).astype(bool)
            at = np.flatnonzero(keep)
            if len(at):
                told = zip(scores[at], self.nameless[start + at], self.ids[start + at], strict=True)
                found = heapq.nsmallest(k, [*found, *((-int(s), bool(n), int(i)) for s, n, i in told)])
                kth = -found[-1][0] if len(found) >= k else None
        return sorted(found)


def exact_numbers(vectors: np.ndarray) -> np.ndarray:
    """Integer vectors as float64 if all their inner products are exact in it, else as objects."""
    most = np.abs(vectors.astype(np.float64)).max(initial=0.0)
    if most * most * max(1, vectors.shape[1]) < 2**52:
        return vectors.astype(np.float64)
    return vectors.astype(object)


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    odd = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    return vector.isNotNull() & ~odd


def top_k(
    rows: DataFrame,
    queries: Callable[[Column], Column],
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: float = 64.0,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Rows `(query_id, rank, vec_id, score)`: the k highest inner products for each query.

    Each component x becomes floor(scale * x). `queries` says by its id whether a row is a
    query; its candidates are all rows but itself. Equal scores go to the smaller id. Vectors
    are dealt once to shards of about `shard_rows`, each of which builds one tree that is
    written. Queries come in blocks of at most about `query_rows` and QUERY_BYTES, each a
    broadcast and a pass over the trees that is written before the next. A task takes its
    shards one after the other, and the kth score of a query goes on from each to the next, where
    most leaves and results fall away; it gives at most k rows of a query.

    Null vectors and those with a null or non-finite component take no part. Vectors of
    another length than the query's are no candidates; empty ones score 0. Every row counts:
    of rows with one id each is a query and a candidate of the others, and a row without id
    is a candidate that comes last among equal scores, without id. Components and scores
    beyond a long are cut to its ends. An empty table, or one without queries, gives no rows.
    """
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    clean = rows.where(usable(F.col(vector_col))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), whole.alias("vector")
    )
    clean = stored(clean, "vectors")
    total = clean.count()
    dealt = clean.repartition(max(1, -(-total // shard_rows)), "row")
    trees = stored(dealt.mapInArrow(_planted(shard_rows), "size int, tree binary"), "kd-trees", **BLOCK_OPTIONS)
    wanted = stored(clean.where(queries(F.col("id"))), "queries")
    size = F.coalesce(F.sum(8 * F.size("vector") + 32), F.lit(0))
    asked, octets = wanted.agg(F.count(F.lit(1)), size).first()
    blocks = max(1, -(-asked // query_rows), -(-octets // QUERY_BYTES))
    found = []
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        told = rows.sparkSession.sparkContext.broadcast(_questions(own))
        schema = "row long, query_id long, vec_id long, score long"
        with few_rows(rows.sparkSession):
            found.append(stored(trees.mapInArrow(_searched(told, k), schema), "found"))
        told.unpersist()
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        reduce(DataFrame.unionByName, found)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _questions(own: DataFrame) -> dict[int, list[tuple[int, int, list[int]]]]:
    """By length of the vector: row, id and vector of each query."""
    found = defaultdict(list)
    for row in own.collect():
        found[len(row["vector"])].append((row["row"], row["id"], row["vector"]))
    return dict(found)


def _planted(shard_rows: int):
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = defaultdict(list)

        def planted(size: int) -> pa.RecordBatch:
            rows, ids, vectors = zip(*waiting.pop(size), strict=True)
            numbers = exact_numbers(np.array(vectors, dtype=np.int64).reshape(len(rows), size))
            tree = KdTree(
                np.array(rows),
                np.array([0 if i is None else i for i in ids], dtype=np.int64),
                np.array([i is None for i in ids]),
                numbers,
            )
            columns = [pa.array([size], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["size", "tree"])

        for batch in batches:
            vectors = batch.column("vector")
            for at, (row, id_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "id")), strict=True)):
                vector = vectors[at].values.to_numpy()
                waiting[len(vector)].append((row, id_, vector))
                if len(waiting[len(vector)]) >= 2 * shard_rows:
                    yield planted(len(vector))
        for size in list(waiting):
            yield planted(size)

    return plant


def _searched(told, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {
            size: (own, np.array([v for *_, v in own], dtype=np.int64).reshape(len(own), size))
            for size, own in told.value.items()
        }
        best: dict[int, list[Found]] = defaultdict(list)
        for batch in batches:
            for size, data in zip(batch.column("size").to_pylist(), batch.column("tree"), strict=True):
                if size not in asked:
                    continue
                own, vectors = asked[size]
                tree = pickle.loads(data.as_py())
                mosts = np.abs(vectors.astype(np.float64)).max(axis=1, initial=0.0)
                exact = tree.exact_with(mosts.max(initial=0.0))
                numbers = vectors.astype(object if exact.sorted.dtype == object else np.float64)
                for (row, *_), vector in zip(own, numbers, strict=True):
                    best[row] = exact.search(row, vector, k, best[row])
        long = lambda score: max(-LONG_MAX - 1, min(LONG_MAX, score))
        rows = [
            (row, id_, None if nameless else found, long(-score))
            for own, _ in asked.values()
            for row, id_, _ in own
            for score, nameless, found in best.get(row, [])
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        arrays = [pa.array(list(column), pa.int64()) for column in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "query_id", "vec_id", "score"])

    return search
