from collections import defaultdict

from pagelode.llm.common import word_count
from pagelode.llm.mixing import mix, source_ranks, water_fill
from pagelode.llm.queries import rotating_weights
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.tables import clashing, documents, rows, texts


def fill(sizes, weights, budget, most):
    """Water-filling by clamping one round after the other."""
    targets, clamped = {}, {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left = budget - sum(clamped.values())
        total = sum(weights[s] for s in free)
        targets = clamped | {s: left * weights[s] / total for s in free}
        over = [s for s in free if targets[s] > most * sizes[s]]
        if not over:
            return targets
        clamped |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    found = mix(documents(spark), rotating_weights).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for row, text in zip(sorted(found, key=lambda r: r["id"]), texts(), strict=True):
        assert row["size"] == len(brute.spaced_words(text or ""))
        assert 0 <= row["taken"] <= 2 * row["size"]
        sizes[row["source"]] += row["size"]
        taken[row["source"]] += row["taken"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    wanted = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for row in found:
        assert row["source_size"] == sizes[row["source"]]
        assert abs(row["target"] - wanted[row["source"]]) < 1e-6
    assert all(abs(taken[s] - wanted[s]) <= 0.5 + 1e-6 for s in sizes)


def test_reruns_and_extra_columns_agree(spark):
    first = rows(mix(documents(spark), rotating_weights))
    assert first == rows(mix(documents(spark).repartition(7), rotating_weights))
    assert first == rows(mix(clashing(documents(spark)), rotating_weights))


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["a b c"] * 4 + [None], [None, None, 3, 3, 4])
    found = mix(docs, rotating_weights).collect()
    assert len(found) == 5 and all(r["taken"] <= 2 * r["size"] for r in found)


def test_empty_table(spark):
    assert mix(documents(spark, []), rotating_weights).count() == 0


def test_budget_beyond_all_caps(spark):
    table = spark.createDataFrame(
        [("a", 10, 1.0), ("b", 0, 5.0), ("c", 7, None)], "source string, source_size long, weight double"
    )
    found = {r["source"]: r["target"] for r in water_fill(table, 1000.0, 2.0).collect()}
    assert found == {"a": 20.0, "b": 0.0, "c": 0.0}


def test_ranks_by_code_point_null_last(spark):
    names = ["b", None, "a", "Z", "ä", "\U0001f600", "￮"]
    found = source_ranks(spark.createDataFrame([(n,) for n in names], "source string"))
    ordered = [r["source"] for r in found.orderBy("rank").collect()]
    assert ordered == ["Z", "a", "b", "ä", "￮", "\U0001f600", None]


def test_word_count(spark):
    found = documents(spark).select(word_count(F.col("text")).alias("n"), "text").collect()
    assert all(r["n"] == len(brute.spaced_words(r["text"] or "")) for r in found)
