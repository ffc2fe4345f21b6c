import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import codes
from tests.llm.tables import clashing, rows

LONG = 2**63 - 1


def vectors(count=400, size=8, seed=5):
    pick = random.Random(seed)
    near = [[pick.choice([-0.5, 0.0, 0.25, pick.uniform(-1, 1)]) for _ in range(size)] for _ in range(9)]
    out = []
    for i in range(count):
        base = pick.choice(near) if i % 3 else [pick.uniform(-1, 1) for _ in range(size)]
        out.append((i * 3 % 401, [x + pick.choice([0, 0, 0.001]) for x in base], pick.choice([None, 1, 2])))
    return out


ODD = [
    (900, None, 1),
    (901, [0.5, None, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0], 1),
    (902, [float("nan")] * 8, None),
    (903, [float("-inf")] * 8, 2),
    (904, [1.0, 2.0], 7),
    (905, [], None),
    (None, [0.125] * 8, 3),
    (3, [0.25] * 8, 3),
    (3, [0.25] * 8, 3),
]


def whole(vector, scale=1024):
    return [max(-LONG - 1, min(LONG, math.floor(scale * x))) for x in vector]


def wanted(data, parts, entries, rounds):
    kept = [
        (i, whole(v), label)
        for i, v, label in data
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda row: (row[0] is None, row[0] or 0, row[1]))
    size = len(kept[0][1]) if kept else 0
    usual = [row for row in kept if len(row[1]) == size and size % parts == 0]
    width = size // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, v, _ in usual[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in usual:
                own[nearest(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [
                [sum(column) // len(column) for column in zip(*members, strict=True)] if members else entry
                for members, entry in zip(own, book, strict=True)
            ]
    out = []
    for i, v, label in kept:
        if len(v) != size or size % parts:
            out.append((i, label, None, None))
            continue
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, [k for _, k in best], min(LONG, sum(d for d, _ in best))))
    return sorted(out, key=repr), books


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize(("parts", "entries", "block"), [(4, 256, 1024), (4, 16, 37), (2, 5, 64), (8, 1, 50)])
def test_equal_brute_force(spark, monkeypatch, parts, entries, block):
    monkeypatch.setattr(codes, "BLOCK_ROWS", block)
    data = vectors() + ODD
    found = codes.compress(
        clashing(frame(spark, data)).repartition(3), parts=parts, entries=entries, rounds=3
    )
    own, books = wanted(data, parts, entries, 3)
    assert found.codebooks == books
    assert rows(found.rows.select("id", "label", "code", "error")) == own


def test_huge_numbers_stay_exact(spark):
    pick = random.Random(2)
    data = [(i, [pick.choice([1e15, -3e14, 1e30, 5e13]) * pick.randrange(9) for _ in range(4)], 1) for i in range(60)]
    found = codes.compress(frame(spark, data), parts=2, entries=4, rounds=2)
    own, books = wanted(data, 2, 4, 2)
    assert found.codebooks == books and rows(found.rows) == own
    errors = {r["label_error"] for r in codes.with_label_error(found.rows).collect()}
    assert errors == {min(LONG, sum(row[3] for row in own))}


def test_label_errors_and_repeated_rows(spark):
    data = vectors() * 2 + ODD
    out = codes.with_label_error(codes.compress(frame(spark, data), parts=4, entries=9, rounds=1).rows)
    own, _ = wanted(data, 4, 9, 1)
    sums = {}
    for _, label, _, error in own:
        sums[label] = sums.get(label, 0) + (error or 0)
    found = out.collect()
    assert len(found) == len(own)
    assert all(row["label_error"] == sums[row["label"]] for row in found)


def test_empty_tables_and_lengths_that_do_not_divide(spark):
    empty = codes.compress(frame(spark, []))
    assert rows(codes.with_label_error(empty.rows)) == [] and empty.codebooks == [[]] * 4
    odd = codes.compress(frame(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [1.0] * 4, 1)]))
    assert rows(odd.rows) == [(1, 1, None, None), (2, 1, None, None)]
    bare = codes.compress(frame(spark, [(1, [], 1), (2, [], None)]))
    assert rows(bare.rows) == [(1, 1, [0] * 4, 0), (2, None, [0] * 4, 0)]


def test_tree_settles_whole_subtrees():
    pick = np.random.default_rng(3)
    points = np.concatenate([pick.integers(-30, 30, (500, 3)) + 1000 * k for k in range(4)]).astype(float)
    tree = codes.CoverTree(points)
    book = np.array([[1000.0 * k] * 3 for k in range(4)])
    nodes = np.concatenate([nodes for nodes, _ in tree.decided(book)])
    assert len(nodes) < 60 and (tree.stops[nodes] - tree.starts[nodes]).sum() == len(tree.points)
    assert (tree.entries(book) == codes.squared_distances(points, book).argmin(axis=1)).all()
    for node, (first, last) in enumerate(tree.children):
        inside = tree.points[tree.starts[node] : tree.stops[node]]
        apart = codes.squared_distances(inside, tree.points[tree.starts[node]][None])
        assert np.sqrt(apart.max()) <= tree.radii[node] + 1e-6
        centres = tree.points[tree.starts[np.arange(first, last)]]
        if len(centres) > 1:
            between = codes.squared_distances(centres, centres) + 1e18 * np.eye(len(centres))
            assert 4 * between.min() >= tree.radii[node] ** 2 / 4


def test_digest_of_codebooks(spark, tmp_path):
    from pagelode.llm.queries import QUERIES

    frame(spark, vectors(50)).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op12_vector_codes"](spark, str(tmp_path))
    own, books = wanted(vectors(50), 4, 256, 4)
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    row = found.where(F.col("vec_id") == own[0][0]).first()
    assert row["codebooks_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["code"] == "".join(f"{k:02x}" for k in own[0][2])
