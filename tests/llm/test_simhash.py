import random

import pytest
from pyspark.sql import functions as F

from pagelode.llm import common, simhash
from pagelode.llm.components import connected_components
from pagelode.llm.simhash import hex_digits, near_links, simhash_groups
from tests.llm import brute
from tests.llm.tables import clashing, documents, rows, texts


def test_groups_equal_brute_force(spark):
    found = simhash_groups(documents(spark)).select("id", hex_digits(F.col("fp")), "component_id")
    prints = [brute.fingerprint(text) for text in texts()]
    wanted = [
        (i, f"{fp:016x}", root)
        for i, (fp, root) in enumerate(zip(prints, brute.components(prints), strict=True))
    ]
    assert rows(found) == sorted(wanted, key=repr)


def test_wordless_texts_link_at_zero(spark):
    found = {r["id"]: r for r in simhash_groups(documents(spark, [None, "", " ", "a b c"])).collect()}
    assert [found[i]["fp"] for i in range(3)] == [0, 0, 0]
    assert [found[i]["component_id"] for i in range(3)] == [0, 0, 0]
    assert found[3]["component_id"] == 3


def test_extra_columns_change_nothing(spark):
    plain = simhash_groups(documents(spark))
    assert rows(plain) == rows(simhash_groups(clashing(documents(spark))))


def test_null_and_repeated_ids(spark):
    found = simhash_groups(documents(spark, ["a b c d"] * 3 + ["x y z"], [None, 5, 5, None]))
    assert sorted((r["id"], r["component_id"]) for r in found.collect() if r["id"]) == [(5, 5), (5, 5)]
    assert {r["component_id"] for r in found.collect() if r["id"] is None} == {5, None}


def test_empty_table(spark):
    assert simhash_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 6])
def test_links_lose_nothing(spark, bits):
    pick = random.Random(bits)
    values = {pick.getrandbits(64) for _ in range(40)}
    for value in list(values):
        for flips in range(1, 8):
            values.add(value ^ sum(1 << b for b in pick.sample(range(64), flips)))
    signed = [v - (v >> 63 << 64) for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {frozenset(map(_unsigned, pair)) for pair in near_links(table, bits).collect()}
    ordered = sorted(values)
    wanted = {
        frozenset((a, b))
        for i, a in enumerate(ordered)
        for b in ordered[i + 1 :]
        if (a ^ b).bit_count() <= bits
    }
    assert found == wanted


def _unsigned(value):
    return value % (1 << 64)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame([*path, *hub, *hub, (7, 7)], "a long, b long")
    found = dict(map(tuple, connected_components(links).collect()))
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_a_plan_without_cross_join(spark):
    table = spark.range(100).select(F.xxhash64("id").alias("fp"))
    plan = near_links(table, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_texts_go_to_python_a_few_at_a_time(spark, monkeypatch):
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", {}

    def stored(df, table, **options):
        rows[table] = int(spark.conf.get(name))
        return common.stored(df, table, **options)

    monkeypatch.setattr(simhash, "stored", stored)
    before = spark.conf.get(name)
    simhash.simhash_groups(documents(spark)).collect()
    assert rows["fingerprints"] <= 256 and rows["components"] == int(before)
    assert spark.conf.get(name) == before
