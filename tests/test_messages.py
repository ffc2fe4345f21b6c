import json

import pytest

import pagelode as pl
from pagelode.schemas import MESSAGE
from pagelode.sources import messages as m
from pagelode.sources.pages import seed_pages

PAGES = [
    ('{"id":"1","url":"u","title":"t","body":"b"}', ("1", "u", "t", "b")),
    ('{"ID":"1","Body":"b"}', ("1", "", "", "b")),
    ('{"id":null,"body":"x"}', ("", "", "", "x")),
    ('{"id":"1","extra":5}', ("1", "", "", "")),
    ('{"id":"1","id":"2"}', ("2", "", "", "")),
    ("null", ("", "", "", "")),
    ("{}", ("", "", "", "")),
    (' \n{"id":"1"}\t', ("1", "", "", "")),
    ('{"id":"1","body":"line\\nbreak \\u00e9 {}"}', ("1", "", "", "line\nbreak é {}")),
    # Known difference: of two spellings the lower-case one counts, not the last.
    ('{"id":"1","ID":"9"}', ("1", "", "", "")),
]
REJECTS = [
    '{"id":1}',
    '{"id":"1","title":{"a":1}}',
    '{"id":"1","body":["b"]}',
    "{'id':'1'}",
    '{"id":true}',
    "{bad",
    "",
    "[]",
    '"str"',
    '{"id":"1"} junk',
    "5",
    '{"id":"1"}{"id":"2"}',
    '{"id":"1"},{"id":"2"}',
    '{"id":"1"} ] {}',
    '{"id":"1"} junk}',
    '{"id":"1"}\x85',
    '{"id":"1"},"v":{"id":"2"}',
]


def messages(spark, values):
    rows = [(b"key", bytearray(value.encode())) for value in values]
    return spark.createDataFrame(rows, MESSAGE)


@pytest.mark.parametrize(("value", "page"), PAGES)
def test_decode_accepts(spark, value, page):
    assert [tuple(row) for row in pl.decode_messages(messages(spark, [value])).collect()] == [page]


def test_decode_drops_what_is_no_page(spark):
    assert pl.decode_messages(messages(spark, REJECTS)).count() == 0


def test_decode_drops_a_missing_value(spark):
    frame = spark.createDataFrame([(b"k", None)], MESSAGE)
    assert pl.decode_messages(frame).count() == 0


def test_decode_keeps_rejects_on_request(spark):
    both = messages(spark, [PAGES[0][0], *REJECTS])
    rows = pl.decode_messages(both, keep_rejects=True).collect()
    assert sorted(bytes(row.value).decode() for row in rows if not row.accepted) == sorted(REJECTS)
    assert [row.id for row in rows if row.accepted] == ["1"]
    assert [row.value for row in rows if row.accepted] == [None]


def test_decode_leaves_the_session_settings_alone(spark):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys", None)
    pl.decode_messages(messages(spark, ["{}"]))
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", None) == before


def test_decode_replaces_broken_characters(spark):
    frame = spark.createDataFrame([(b"k", bytearray(b'{"id":"a\xffb"}'))], MESSAGE)
    assert pl.decode_messages(frame).first().id == "a�b"


def test_decode_passes_other_columns_through(spark):
    frame = messages(spark, ["{}"]).selectExpr("*", "7L AS offset")
    assert pl.decode_messages(frame).first().offset == 7


def test_encode(spark):
    row = pl.encode_messages(seed_pages(spark)).first()
    assert bytes(row.key) == b"1"
    assert json.loads(bytes(row.value)) == {
        "id": "1",
        "url": "https://example.com",
        "title": "Example Domain",
        "body": "This domain is for use in illustrative examples in documents.",
    }


def test_round_trip(spark):
    odd = [("1", "u", 'a "quote"', "tab\t{} é 😀 \\ <b>&</b>"), ("", "", "", "")]
    pages = spark.createDataFrame(odd, "id string, url string, title string, body string")
    assert sorted(map(tuple, pl.decode_messages(pl.encode_messages(pages)).collect())) == sorted(odd)


def test_publish_to_files(spark, tmp_path):
    pl.publish(seed_pages(spark), "parquet", f"{tmp_path}/topic")
    pl.publish(seed_pages(spark), "parquet", f"{tmp_path}/topic")
    stored = spark.read.parquet(f"{tmp_path}/topic")
    assert stored.columns == ["key", "value"]
    assert pl.decode_messages(stored).count() == 4


def test_connector_options():
    assert m.consumer_options("h:9092") == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "pages",
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    assert m.producer_options()["kafka.delivery.timeout.ms"] == "5000"


def test_as_pages_fills_in_missing_text(spark):
    frame = spark.createDataFrame([(1, None)], "n long, t string")
    assert tuple(pl.as_pages(frame, "n", body="t").first()) == ("1", "", "", "")
