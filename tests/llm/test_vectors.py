import math
import random

import pytest

from pagelode.llm.vectors import top_k
from tests.llm.tables import clashing, rows


def vectors(count=300, size=6, seed=3):
    pick = random.Random(seed)
    return [(i, [pick.choice([-0.5, 0.0, 0.25, 1.0, pick.random()]) for _ in range(size)]) for i in range(count)]


ODD = [
    (400, None),
    (420, [0.5, None, 0.1, 0.0, 0.0, 0.0]),
    (440, [float("nan")] * 6),
    (460, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]),
    (None, [1.0] * 6),
    (480, [1.0, 2.0]),
    (500, [3.0, -1.0]),
    (501, [0.5, 0.5]),
    (520, []),
    (521, []),
    (540, [1e19, -1e30, 0.0]),
    (541, [1e19, 1e3, 0.0]),
    (542, [2.0, 1.0, 0.0]),
    (20, [9.0] * 6),
    (20, [9.0] * 6),
    (None, [9.0] * 6),
    (7, [9.0] * 6),
]


def wanted(data, k, every):
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    usable = [
        (i, [long(math.floor(64 * x)) for x in vector])
        for i, vector in data
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    out = []
    for own, (q, vector) in enumerate(usable):
        if q is not None and q % every == 0:
            scores = [
                (-long(sum(a * b for a, b in zip(vector, v, strict=True))), i is None, i or 0)
                for at, (i, v) in enumerate(usable)
                if at != own and len(v) == len(vector)
            ]
            best = enumerate(sorted(scores)[:k], 1)
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in best]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "block"), [(8192, 2048), (40, 5), (7, 100)])
def test_equal_brute_force(spark, shard, block):
    data = vectors() + ODD
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = top_k(clashing(table), lambda i: i % 20 == 0, k=20, shard_rows=shard, query_rows=block)
    assert rows(found) == wanted(data, 20, 20)


def test_ties_and_fewer_than_k(spark):
    data = [(i, [1.0, 1.0]) for i in range(30)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert rows(top_k(table, lambda i: i % 10 == 0, k=4, shard_rows=3)) == wanted(data, 4, 10)
    assert rows(top_k(table, lambda i: i % 10 == 0, k=50, shard_rows=3)) == wanted(data, 50, 10)


def test_repeated_and_missing_ids_all_count(spark):
    data = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = rows(top_k(table, lambda i: i % 20 == 0, k=20))
    assert len(found) == 8 and found == wanted(data, 20, 20)
    assert [r[2] for r in found if r[1] == 3] == [None, None]


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rows(top_k(table, lambda i: i % 20 == 0)) == []
