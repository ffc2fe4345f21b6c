import gzip
import hashlib
import html
import re
from pathlib import Path

from pyspark.sql import functions as F

from pagelode.llm import warc
from pagelode.llm.warc import decoded, derive, page_responses, plain_text, write_warc
from tests.llm.tables import clashing, rows

PAGES = [
    (1, "http://a.example/", '<html lang="en"><head><title>A &amp; B\n C</title><style>p{}</style></head><body>'
     '<p>One&nbsp;two</p><script>if (a<b) "</p>"</script><!-- no --><a href="/x y">Link</a><br>&#233;&#x1F600;&#xD800; &lt;tag&gt; 1 < 2</body></html>'),
    (2, None, None),
    (3, "http://a.example/", ""),
    (None, "http://a.example/b", "plain"),
    (4, "http://long.example/", "<p>word</p>" * 20_000),
]


def pages(spark, data=PAGES):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_records_are_linked_and_digests_hold(spark):
    responses = page_responses(clashing(pages(spark)))
    sources = {r["record_id"]: r for r in responses.collect()}
    records = derive(responses).collect()
    assert len(records) == 2 * len(PAGES) and len(sources) == len(PAGES)
    assert len({r["record_id"] for r in records}) == len(records)
    for row in records:
        source = sources[row["refers_to"]]
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", row["record_id"])
        assert row["target_uri"] == source["target_uri"] and row["refers_to_date"] == source["date"]
        assert row["payload_digest"] == source["payload_digest"] and row["digest_matches"]
        payload = source["block"].split("\r\n\r\n", 1)[1]
        assert row["payload_digest"] == "sha256:" + hashlib.sha256(payload.encode()).hexdigest()
        assert row["block_digest"] == "sha256:" + hashlib.sha256(row["block"].encode()).hexdigest()
        assert row["content_length"] == len(row["block"].encode())
        assert row["source_headers"][0] == "Content-Type: text/html; charset=utf-8"


def test_text_and_metadata_of_a_page(spark):
    made = {r["record_type"]: r["block"] for r in derive(page_responses(pages(spark, PAGES[:1]))).collect()}
    assert made["conversion"] == "One two\nLink\né\U0001f600&#xD800; <tag> 1 < 2"
    fields = made["metadata"].split("\r\n")
    assert fields[0] == "status: 200"
    assert {"title: A & B C", "language: en", "outlink: /x y"} <= set(fields)
    assert any(f.startswith("source-header: Content-Length: ") for f in fields)


def test_other_types_and_odd_blocks(spark):
    data = [
        (1, "<a>", "u", "d", "HTTP/1.1 404 Not Found\r\nContent-Type: text/plain\r\nX: a: b\r\n\r\n<p> as is", None),
        (2, "<b>", "u", "d", "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nxyz", "sha1:OTHER"),
        (3, "<c>", None, None, None, None),
        (4, None, "u", "d", "no empty line", None),
    ]
    schema = "key long, record_id string, target_uri string, date string, block string, payload_digest string"
    found = {(r["key"], r["record_type"]): r for r in derive(spark.createDataFrame(data, schema)).collect()}
    assert found[1, "conversion"]["block"] == "<p> as is"
    assert found[1, "metadata"]["block"].startswith("status: 404\r\nsource-header: Content-Type: text/plain\r\nsource-header: X: a: b")
    assert (2, "conversion") not in found
    assert found[2, "metadata"]["payload_digest"] == "sha1:OTHER" and not found[2, "metadata"]["digest_matches"]
    assert found[3, "conversion"]["block"] == "" and found[3, "metadata"]["source_headers"] == []
    assert found[4, "conversion"]["block"] == "no empty line"


def test_references_equal_the_standard_ones(spark):
    values = ["&lt;&gt;&amp;&quot;&copy;&middot;", "&#65;&#x42;&#0067;", "&amp;lt;", "&unknown; & &#;", "none",
              "&#38;lt;b&#38;gt;", "&#38;#60; and &#60;", "&amp;&#97;&amp;#97;", "&#x1F600;&#xe9;|", ""]
    table = spark.createDataFrame([(v,) for v in values], "text string")
    for row in table.select("text", decoded(F.col("text")).alias("out")).collect():
        assert row["out"] == html.unescape(row["text"])


def test_unclosed_parts_and_bare_attributes(spark):
    data = [
        (1, "u", "<p>a</p><script>if (x) y()<p>b</p>"),
        (2, "u", "<p>a</p><!-- never closed <p>b</p>"),
        (3, "u", "<html class=x lang='fr'><a href='x y'>1</a><a id=q href=z>2</a><a data-href=no>3</a>"
         '<a title="t" HREF = "/p?a=1&amp;b=2">4</a><style>p {}'),
        (4, "u", "<html lang=de><header>head</header>text"),
    ]
    made = {(r["key"], r["record_type"]): r["block"] for r in derive(page_responses(pages(spark, data))).collect()}
    assert made[1, "conversion"] == made[2, "conversion"] == "a"
    fields = made[3, "metadata"].split("\r\n")
    assert "language: fr" in fields
    assert [f for f in fields if f.startswith("outlink: ")] == ["outlink: x y", "outlink: z", "outlink: /p?a=1&b=2"]
    assert made[3, "conversion"] == "1234"
    assert "language: de" in made[4, "metadata"] and made[4, "conversion"] == "head\ntext"


def test_written_files_are_records(spark, tmp_path):
    records = derive(page_responses(pages(spark)))
    write_warc(records, str(tmp_path / "out"), F.lit("2020-01-01T00:00:00Z"))
    content = b"".join(gzip.decompress(f.read_bytes()) for f in Path(tmp_path / "out").glob("part-*"))
    count = 0
    while content:
        head, content = content.split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"WARC-Refers-To: <urn:uuid:" in head
        assert content[size : size + 4] == b"\r\n\r\n"
        content, count = content[size + 4 :], count + 1
    assert count == records.count()


def test_repeated_rows_and_empty_table(spark):
    once = rows(derive(page_responses(pages(spark))))
    assert rows(derive(page_responses(pages(spark, PAGES + PAGES)))) == sorted(once * 2, key=repr)
    assert rows(derive(page_responses(pages(spark, [])))) == []
    assert spark.createDataFrame([("",)], "t string").select(plain_text(F.col("t"))).first()[0] == ""


def test_white_space_is_found_by_one_class_of_characters(spark):
    """Patterns that begin with one class, and replace what their alternatives replaced."""
    letters = "a \n\t\r\f\x0b\xa0"
    texts = ["".join(letters[n // 7**i % 7] for i in range(5)) for n in range(7**5)] + ["", "ü 𝄞\n b"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    alternatives = {
        warc.SPACES: (r"\s{2,}|[\t\n\x0B\f\r]", " "),
        warc.BLANKS: (r"[ \t\r\f\x0B\x{00A0}]{2,}|[\t\r\f\x0B\x{00A0}]", " "),
        warc.LINE_ENDS: (r" ?\n[ \n]*", "\n"),
    }
    for pattern, (plain, by) in alternatives.items():
        assert re.match(r"(\\s|\[[^]]+\])\(", pattern)
        same = F.regexp_replace("text", pattern, by) == F.regexp_replace("text", plain, by)
        assert frame.where(~same).isEmpty()
