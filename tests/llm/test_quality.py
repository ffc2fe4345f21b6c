import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pagelode.llm import quality
from pagelode.llm.quality import score_quality
from tests.llm.tables import clashing, documents, prose, rows

BAD = "BUY!!! $$$ now### win*** free%%%"


def corpus(spark, count=400):
    data = [
        (
            i,
            f"{prose(i, 40)} {BAD if i % 4 == 0 else ''} {prose(i + 999, 5)}",
            ["en", None][i % 2],
            "bad" if i % 4 == 0 and i % 8 else f"src{i % 3}",
            200,
        )
        for i in range(count)
    ]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def labels(spark, ids):
    return spark.createDataFrame([(i, int(i % 4 != 0)) for i in ids], "doc_id long, quality int")


def test_held_out_documents(spark):
    found = score_quality(corpus(spark), labels(spark, range(0, 400, 3))).collect()
    assert len(found) == 400 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["id"] % 3]
    assert sum(r["good"] == (r["id"] % 4 != 0) for r in held) >= 0.97 * len(held)


def test_odd_rows_and_extra_columns(spark):
    odd = documents(spark, [None, "", "x" * 100_000, "same", "same"], [None, None, 1000, 1001, 1001])
    docs = corpus(spark).unionByName(odd)
    more = spark.createDataFrame([(None, 1), (5, None), (6, 7), (9, 0), (9, 1), (9, 1)], "doc_id long, quality int")
    known = labels(spark, range(0, 400, 2)).unionByName(more)
    found = score_quality(clashing(docs), known)
    assert found.count() == docs.count()
    assert found.where("score is null or good is null").count() == 0


def test_without_labels_all_are_even(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = score_quality(corpus(spark, 20), none)
    assert {(r["score"], r["good"]) for r in found.collect()} == {(0.5, True)}
    assert rows(score_quality(documents(spark, []), none)) == []


def test_one_class_gives_its_share(spark):
    only = spark.createDataFrame([(i, 1) for i in range(38)], "doc_id long, quality int")
    found = score_quality(corpus(spark, 40), only)
    assert {r["score"] for r in found.collect()} == {39 / 40}
    assert found.select(F.count("*")).first()[0] == 40


def test_calibration_equals_logistic_regression(spark):
    draw = np.random.default_rng(1)
    margins = np.concatenate([draw.normal(3, 4, 300), draw.normal(-2, 2, 200)])
    given = np.repeat([1.0, 0.0], [300, 200])
    slope, shift = quality.platt(given, margins, np.ones(500))
    table = spark.createDataFrame(list(zip(given.tolist(), margins.tolist(), strict=True)), "label double, m double")
    table = VectorAssembler(inputCols=["m"], outputCol="one").transform(table)
    fit = LogisticRegression(featuresCol="one", labelCol="label", regParam=0.001, tol=1e-10).fit(table)
    assert math.isclose(slope, fit.coefficients[0], rel_tol=1e-3)
    assert math.isclose(shift, fit.intercept, abs_tol=1e-3)
    twice = quality.platt(np.tile(given, 2), np.tile(margins, 2), np.ones(1000))
    counted = quality.platt(given, margins, np.full(500, 2.0))
    assert np.allclose(twice, counted)


def test_calibration_of_equal_or_separable_margins():
    slope, shift = quality.platt(np.array([0.0, 1.0]), np.array([2.0, 2.0]), np.array([1.0, 3.0]))
    assert slope == 0 and math.isclose(shift, math.log(3), abs_tol=1e-6)
    slope, shift = quality.platt(np.array([0.0, 1.0]), np.array([-64.0, 64.0]), np.array([50.0, 50.0]))
    assert 0 < slope < 1 and abs(shift) < 1e-6


def test_views_exchange_what_they_are_sure_of(spark):
    """The labels of the next round and the score against plain arithmetic."""
    known = labels(spark, range(0, 300, 2)).select(
        F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("label")
    )
    docs = corpus(spark, 300).select(
        F.col("doc_id").alias("key"),
        F.col("text").alias("content"),
        F.array("source", "lang").alias("metadata"),
        F.col("n_chars").cast("double").alias("chars"),
    )
    table = quality.with_views(docs.join(known, "key", "left")).select("key", "label", "text", "meta").cache()
    model = quality.co_train(table, rounds=3)
    told = quality._exchanged(table, model.views, 0.95).select("key", "label", "y_text", "y_meta")
    scored = model.score(table).select("key", "p_text", "p_meta", "score")
    for row in told.join(scored, "key").collect():
        for other, name in (("meta", "text"), ("text", "meta")):
            p = row[f"p_{name}"]
            if abs(p - 0.95) > 1e-4 and abs(p - 0.05) > 1e-4:
                sure = 1.0 if p >= 0.95 else 0.0 if p <= 0.05 else None
                assert row[f"y_{other}"] == (sure if row["label"] is None else row["label"])
        parts = [row["p_text"], row["p_meta"], model.prior]
        if all(0.0001 < p < 0.9999 for p in parts):
            text, meta, prior = (math.log(p / (1 - p)) for p in parts)
            assert abs(row["score"] - 1 / (1 + math.exp(prior - text - meta))) < 0.02
    given = told.where("label is null and (y_text is not null or y_meta is not null)")
    assert given.count() > 100
    table.unpersist()


def test_words_seen_only_in_unlabelled_rows_are_learned(spark):
    """The metadata view teaches the text view a word that no labelled row has."""
    words = {True: ("badword", "strangeword"), False: ("", "")}
    data = [
        (i, f"{prose(i, 30)} {words[i % 4 == 0][i >= 200]}", "en", "bad" if i % 4 == 0 else "src", 200)
        for i in range(600)
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["id"]: r for r in score_quality(docs, labels(spark, range(200))).collect()}
    low = sum(found[i]["p_text"] for i in range(200, 600) if i % 4 == 0) / 100
    high = sum(found[i]["p_text"] for i in range(200, 600) if i % 4) / 300
    assert low < high
