import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelode.functions import scoring, text


def evaluate(spark, column, *values):
    rows = [(i, value) for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, s string")
    return [row[0] for row in frame.orderBy("i").select(column.alias("r"), "i").collect()]


def test_normalize(spark):
    given_, wanted = ["  Hello,   World!! ", "", "İstanbul", "où?"], ["hello world", "", "istanbul", "o"]
    assert evaluate(spark, text.normalize(F.col("s")), *given_) == wanted


def test_tokens(spark):
    found = evaluate(
        spark, text.tokens(F.col("s")), "İstanbul Kelvin Straße C++ a_b", "", "!!!", "A1 b2\nA1"
    )
    assert found == [
        ["istanbul", "kelvin", "stra", "e", "c", "a", "b"],
        [],
        [],
        ["a1", "b2", "a1"],
    ]


def test_indexed_text_joins_title_and_body(spark):
    frame = spark.createDataFrame([("t", "b"), ("", ""), (None, "b")], "title string, body string")
    rows = frame.select(text.indexed_text(F.col("title"), F.col("body"))).collect()
    assert [row[0] for row in rows] == ["t b", " ", " b"]


def test_whitespace_tokens_split_like_python(spark):
    # U+1C89 is a capital letter only in later versions of Unicode than Python's.
    every = [f"a{chr(c)}b" for c in range(1, 0x3100) if c != 0x1C89]
    every += [" x, É. ", "", "A b　c\x1cd  e"]
    found = evaluate(spark, text.whitespace_tokens(F.col("s")), *every)
    assert found == [t.lower().split() for t in every]


def test_truncate_stops_at_a_character(spark):
    cut = text.truncate_utf8(F.col("s"), 4)
    assert evaluate(spark, cut, "abcé", "abcd", "abcde", "ab€", "a€", "😀x", "é") == [
        "abc",
        "abcd",
        "abcd",
        "ab",
        "a€",
        "😀",
        "é",
    ]


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text(alphabet="aBc é,\n1　€", max_size=40), min_size=1, max_size=20))
def test_text_functions_match_plain_python(spark, texts):
    s = F.col("s")
    assert evaluate(spark, text.tokens(s), *texts) == [
        re.findall("[a-z0-9]+", t.lower()) for t in texts
    ]
    counts = evaluate(spark, text.value_counts(text.whitespace_tokens(s)), *texts)
    for found, t in zip(counts, texts, strict=True):
        words = t.lower().split()
        assert {(row.term, row.tf) for row in found} == {(w, words.count(w)) for w in words}
        assert len(found) == len(set(words))
    assert evaluate(spark, text.truncate_utf8(s, 7), *texts) == [
        t.encode()[:7].decode("utf8", "ignore") for t in texts
    ]


def test_bow_vector_has_unit_length(spark):
    (vector, empty) = evaluate(spark, text.bow_vector(F.col("s")), "a b b C", " ")
    assert {row.token: pytest.approx(row.weight) for row in vector} == {
        "a": 1 / math.sqrt(6),
        "b": 2 / math.sqrt(6),
        "c": 1 / math.sqrt(6),
    }
    assert empty == []


def test_norm_of_nothing_is_one(spark):
    counts = text.value_counts(text.whitespace_tokens(F.col("s")), "token", "count")
    assert evaluate(spark, text.vector_norm(counts), "", "a a b") == [1.0, math.sqrt(5)]


@pytest.mark.parametrize(
    ("df", "wanted"),
    [(0, 0.6931471805599453), (1, 0.6931471805599453), (2, 0.1823215567939546), (3, -0.15415067982725822)],
)
def test_idf_of_two_documents(spark, df, wanted):
    row = spark.range(1).select(scoring.idf(F.lit(2), F.lit(df))).first()
    assert row[0] == pytest.approx(wanted, abs=1e-15)


def test_pool_bounds(spark):
    frame = spark.createDataFrame([(0,), (20,), (21,), (-3,)], "k int")
    assert [row[0] for row in frame.select(scoring.pool_size(F.col("k"))).collect()] == [20, 20, 21, 20]
