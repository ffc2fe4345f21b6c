"""Vector code compression: Lloyd's rounds over cover trees, one codebook for each part of a vector."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.common import BLOCK_OPTIONS, few_rows, join_by_key, short_numbers, stored
from pagelode.llm.vectors import LONG_MAX, usable

#: Most vectors of one tree, and most components of them together.
BLOCK_ROWS = 1024
BLOCK_COMPONENTS = 1 << 20
#: Share by which sums and differences of rounded distances may be off.
SLACK = 1e-9
#: Holds the sum of as many longs as there can be rows.
WIDE = "decimal(38,0)"


class CoverTree:
    """A cover tree over integer points: nested centres, siblings apart, a bounding radius each.

    The children of a node cover its points within the largest power of two below its radius,
    and their centres are further apart than that; the first one has the centre of the node. A leaf is one point with all its repeats. A node is a range of the points as the
    tree orders them, so running sums over that order give the sum of any subtree.
    """

    def __init__(self, points: np.ndarray) -> None:
        places: dict[tuple, int] = {}
        own = np.array([places.setdefault(tuple(p), len(places)) for p in points.tolist()], dtype=np.int64)
        distinct = points[np.unique(own, return_index=True)[1]]
        order = np.arange(len(distinct))
        starts, stops, radii, children = [], [], [], []
        pending, at = [(0, len(distinct))], 0
        while at < len(pending):
            start, stop = pending[at]
            here = order[start:stop].copy()
            parts, radius = _net(distinct[here])
            starts.append(start)
            stops.append(stop)
            radii.append(radius)
            children.append((len(pending), len(pending) + len(parts)))
            for part in parts:
                order[start : start + len(part)] = here[part]
                pending.append((start, start + len(part)))
                start += len(part)
            at += 1
        self.points = distinct[order]
        self.starts, self.stops = np.array(starts), np.array(stops)
        self.radii, self.children = np.array(radii), np.array(children)
        #: The place of each given point in the order of the tree.
        self.places = np.argsort(order)[own]
        self._add_up()

    def _add_up(self) -> None:
        counts = np.bincount(self.places, minlength=len(self.points))
        whole = self.points if self.points.dtype == object else self.points.astype(np.int64)
        self.counts = np.concatenate([[0], np.cumsum(counts)])
        zero = np.zeros((1, whole.shape[1]), whole.dtype)
        self.sums = np.concatenate([zero, np.cumsum(whole * counts[:, None], axis=0)])

    def __getstate__(self) -> dict:
        """What a stored tree has: no running sums, and numbers as short as they are."""
        state = {name: getattr(self, name) for name in ("starts", "stops", "children", "places", "points")}
        return {name: short_numbers(numbers) for name, numbers in state.items()} | {"radii": self.radii}

    def __setstate__(self, state: dict) -> None:
        for name, numbers in state.items():
            kind = np.float64 if name in ("points", "radii") else np.int64
            setattr(self, name, numbers if numbers.dtype == object else numbers.astype(kind))
        self._add_up()

    def decided(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes whose points are all nearest to one entry of the codebook, and that entry.

        Going down level by level: if the second nearest entry is further from the centre than
        the nearest one by more than twice the radius, no point of the node can be nearer to
        another. Only nodes without that gap go on to their children. A leaf is compared
        exactly, ties going to the lower index.
        """
        nodes = np.array([0])
        while len(nodes):
            squares = squared_distances(self.points[self.starts[nodes]], book)
            best = squares.argmin(axis=1)
            radius = self.radii[nodes]
            settled = radius == 0
            if len(book) == 1:
                settled[:] = True
            else:
                near, next_ = np.sqrt(np.partition(squares.astype(np.float64), 1, axis=1)[:, :2]).T
                settled |= next_ - near > 2 * radius + SLACK * (next_ + near + radius)
            yield nodes[settled], best[settled]
            spans = self.children[nodes[~settled]]
            nodes = np.concatenate([np.arange(a, b) for a, b in spans]) if len(spans) else nodes[:0]

    def entries(self, book: np.ndarray) -> np.ndarray:
        """The nearest entry of each given point."""
        found = np.zeros(len(self.points), dtype=np.int64)
        for nodes, best in self.decided(book):
            for start, stop, entry in zip(self.starts[nodes], self.stops[nodes], best, strict=True):
                found[start:stop] = entry
        return found[self.places]

    def add(self, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Add the sums and counts of the points of each entry, whole subtrees at once."""
        for nodes, best in self.decided(book):
            starts, stops = self.starts[nodes], self.stops[nodes]
            np.add.at(sums, best, (self.sums[stops] - self.sums[starts]).astype(object))
            np.add.at(counts, best, self.counts[stops] - self.counts[starts])


def _net(points: np.ndarray) -> tuple[list[np.ndarray], float]:
    """The points dealt to centres, the first point being the first centre, and their radius
    around it, rounded up; no parts if all points are one.

    The point that is furthest from all centres becomes the next one, until all are covered.
    """
    nearest = squared_distances(points, points[:1])[:, 0]
    most = nearest.max()
    if most == 0:
        return [], 0.0
    radius = float(np.sqrt(float(most))) * (1 + SLACK)
    cover = 4 ** (((int(most) - 1).bit_length() - 1) // 2) if most > 1 else 0  # below `most`
    owner = np.zeros(len(points), dtype=np.int64)
    centres = [0]
    while (far := int(nearest.argmax())) and nearest[far] > cover:
        own = squared_distances(points, points[far : far + 1])[:, 0]
        closer = own < nearest
        owner[closer] = len(centres)
        nearest[closer] = own[closer]
        centres.append(far)
    parts = []
    for number, centre in enumerate(centres):
        members = np.flatnonzero(owner == number)
        parts.append(np.concatenate([[centre], members[members != centre]]))
    return parts, radius


def squared_distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact for integers, which are float64 only where these distances are exact in it."""
    own = (points * points).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :]
    return own - 2 * (points @ book.T)


@dataclass
class Compressed:
    """`rows (id, label, code, error)`, and the codebook of each part: entries by components."""

    rows: DataFrame
    codebooks: list[list[list[int]]]


def compress(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: float = 1024.0,
) -> Compressed:
    """Vectors as one codebook index for each of `parts` equal consecutive parts.

    Each component x becomes floor(scale * x). A codebook starts as that part of the `entries`
    first vectors by id. In each round every part goes to the nearest entry of its codebook by
    squared Euclidean distance, ties to the lower index, and each entry becomes the
    componentwise floor of the mean of its parts; an entry without parts stays. Codes and
    errors, squared distances summed over the parts, are those of the last codebooks.

    Blocks of at most BLOCK_ROWS vectors, as they lie in the partitions, get a cover tree for
    each part, which is written once and read in every round. A round sends sums and counts by
    entry, so shuffles and the driver get numbers for `parts * entries` entries, whatever the
    number of vectors, and repeated vectors are one leaf.

    Null vectors and those with a null or non-finite component are left out. Repeated rows
    count each; rows with equal ids are ordered by vector, those without id come last.
    Vectors of another length than the first one's, or of one that `parts` does not divide, get a
    null code and error and teach nothing. With fewer vectors than entries there are as many
    entries as vectors; an empty table gives no rows. Components beyond a long are cut to its
    ends, errors to its largest value.
    """
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    clean = stored(
        rows.where(usable(F.col(vector_col))).select(
            F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("vector")
        ),
        "whole-vectors",
    )
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    leading = clean.orderBy(*order).limit(1).collect()
    size = len(leading[0]["vector"]) if leading else 0
    fits = (F.size("vector") == size) & F.lit(size % parts == 0)
    kept = clean.where(fits)
    first = [row["vector"] for row in kept.orderBy(*order).limit(entries).collect()]
    width = size // parts
    books = [[vector[p * width : (p + 1) * width] for vector in first] for p in range(parts)]

    spark = rows.sparkSession
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(clean.schema["id"].dataType)),
        T.StructField("labels", T.ArrayType(clean.schema["label"].dataType)),
        T.StructField("trees", T.ArrayType(T.BinaryType())),
    ])
    trees = stored(kept.mapInArrow(_planted(parts, width), schema), "cover-trees", **BLOCK_OPTIONS)
    for _ in range(rounds if first else 0):
        told = spark.sparkContext.broadcast(books)
        sums = trees.select("trees").mapInArrow(
            _summed(told), "part int, entry int, count long, sums array<string>"
        )
        with few_rows(spark):
            sums = stored(sums, "sums")
        total = _totals(sums)
        told.unpersist()
        books = [
            [_mean(total.get((p, e)), entry) for e, entry in enumerate(book)]
            for p, book in enumerate(books)
        ]
    told = spark.sparkContext.broadcast(books)
    schema = T.StructType([
        T.StructField("id", clean.schema["id"].dataType),
        T.StructField("label", clean.schema["label"].dataType),
        T.StructField("code", T.ArrayType(T.IntegerType())),
        T.StructField("error", T.LongType()),
    ])
    with few_rows(spark):
        coded = stored(trees.mapInArrow(_coded(told), schema), "codes")
    other = clean.where(~fits).select(
        "id",
        "label",
        F.lit(None).cast("array<int>").alias("code"),
        F.lit(None).cast("long").alias("error"),
    )
    return Compressed(coded.unionByName(other), books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Rows of `compress` with the sum of the errors of their label, null labels together.

    Rows should be stored, as those of `compress` are. Sums combine before the shuffle, and labels
    of many rows are joined by a broadcast. Sums
    beyond a long are cut to its largest value; a label without any error has 0.
    """
    total = F.coalesce(F.sum(F.col("error").cast(WIDE)), F.lit(0).cast(WIDE))
    table = rows.groupBy("label").agg(
        F.least(total, F.lit(LONG_MAX).cast(WIDE)).cast("long").alias("label_error"),
        F.count(F.lit(1)).alias("label_rows"),
    )
    return join_by_key(rows, stored(table, "label-errors"), "label", "label_rows")


def _totals(sums: DataFrame) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sums of the parts of each (part, entry)."""
    counts = sums.groupBy("part", "entry").agg(F.sum("count").alias("count"))
    places = (
        sums.select("part", "entry", F.posexplode("sums").alias("at", "sum"))
        .groupBy("part", "entry", "at")
        .agg(F.sum(F.col("sum").cast(WIDE)).alias("sum"))
    )
    found = {(row["part"], row["entry"]): (row["count"], {}) for row in counts.collect()}
    for row in places.collect():
        found[row["part"], row["entry"]][1][row["at"]] = int(row["sum"])
    return {key: (count, [own[i] for i in sorted(own)]) for key, (count, own) in found.items()}


def _mean(total: tuple[int, list[int]] | None, entry: list[int]) -> list[int]:
    return entry if total is None else [value // total[0] for value in total[1]]


def _planted(parts: int, width: int):
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // max(1, parts * width)))
        for block in _blocks(batches, most):
            vectors = np.asarray(block["vector"].combine_chunks().flatten(), dtype=np.int64)
            vectors = vectors.reshape(len(block), parts * width)
            most = np.abs(vectors.astype(np.float64)).max(initial=0.0)
            exact = 4 * most * most * max(1, width) < 2**52  # of any squared distance
            vectors = vectors.astype(np.float64 if exact else object)
            trees = [
                pickle.dumps(CoverTree(vectors[:, p * width : (p + 1) * width])) for p in range(parts)
            ]
            columns = [block[name].combine_chunks() for name in ("id", "label")]
            lists = [pa.ListArray.from_arrays([0, len(block)], column) for column in columns]
            lists.append(pa.array([trees], pa.list_(pa.binary())))
            yield pa.RecordBatch.from_arrays(lists, names=["ids", "labels", "trees"])

    return plant


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of `most` rows each, the last one of what is left."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = most - sum(other.num_rows for other in waiting)
            waiting.append(batch.slice(0, room))
            batch = batch.slice(min(room, batch.num_rows))
            if sum(other.num_rows for other in waiting) == most:
                yield pa.Table.from_batches(waiting)
                waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting)


def _book(entries: list[list[int]], like: np.ndarray) -> np.ndarray:
    return np.array(entries, dtype=like.dtype).reshape(len(entries), like.shape[1])


def _summed(told):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = told.value
        width = len(books[0][0])
        sums = [np.zeros((len(book), width), dtype=object) for book in books]
        counts = [np.zeros(len(book), dtype=np.int64) for book in books]
        for batch in batches:
            for trees in batch.column("trees").to_pylist():
                for p, stored_tree in enumerate(trees):
                    tree = pickle.loads(stored_tree)
                    tree.add(_book(books[p], tree.points), sums[p], counts[p])
        rows = [
            (p, e, int(counts[p][e]), [str(int(value)) for value in sums[p][e]])
            for p in range(len(books))
            for e in np.flatnonzero(counts[p]).tolist()
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "count", "sums"])

    return add


def _coded(told):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (batch.column(name)[row].values for name in ("ids", "labels"))
                codes = np.zeros((len(ids), len(told.value)), dtype=np.int32)
                errors = np.zeros(len(ids), dtype=object)
                for p, stored_tree in enumerate(batch.column("trees")[row].as_py()):
                    tree = pickle.loads(stored_tree)
                    book = _book(told.value[p], tree.points)
                    codes[:, p] = tree.entries(book)
                    apart = tree.points[tree.places] - book[codes[:, p]]
                    errors += np.array([int(e) for e in (apart * apart).sum(axis=1)], dtype=object)
                flat = pa.array(codes.reshape(-1))
                at = np.arange(0, codes.size + 1, max(1, codes.shape[1]), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), flat)
                error = pa.array([min(LONG_MAX, int(e)) for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, lists, error], names=["id", "label", "code", "error"]
                )

    return code
