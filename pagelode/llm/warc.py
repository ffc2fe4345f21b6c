"""WARC responses, and the metadata and plain-text conversion records derived from them.

Column expressions alone; nothing is shuffled. Blocks are strings; lengths count UTF-8 octets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.text import let

CRLF = "\r\n"
#: The named character references that are decoded.
ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "copy": "©",
    "reg": "®",
    "middot": "·",
    "ndash": "–",
    "mdash": "—",
    "hellip": "…",
    "laquo": "«",
    "raquo": "»",
    "amp": "&",
}
REFERENCE = rf"&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(ENTITIES)});"
UNSEEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)"
    r"|head\b.*?</head\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>)"
)
#: Every run of white space, or of blanks, but for single spaces, which stay as they are; and
#: every run with a line break in it. One class of characters comes first, so a search passes over
#: all others without trying alternatives.
SPACES = r"\s(?:\s+|(?<! ))"
BLANKS = r"[ \t\r\f\x0B\x{00A0}](?:[ \t\r\f\x0B\x{00A0}]+|(?<! ))"
LINE_ENDS = r"[ \n](?:(?<=\n)|\n)[ \n]*"
BREAKS = (
    r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|header|footer"
    r"|main|aside|blockquote|pre|form|figure|title|body|html)\b[^>]*>"
)
TAG = r"</?[a-zA-Z!?][^>]*>"


def urn(content: Column) -> Column:
    """A record id that depends on the content alone."""
    return F.regexp_replace(
        F.md5(content.cast("binary")),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "<urn:uuid:$1-$2-$3-$4-$5>",
    )


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def decoded(text: Column) -> Column:
    """The text with named and numbered character references replaced, in one pass: what a
    reference stands for is not looked at again. Unknown ones stay."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def character(reference: Column) -> Column:
        name = F.substring(reference, F.lit(2), F.length(reference) - 2)
        digits = F.regexp_extract(name, "([0-9a-fA-F]+)$", 1)
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        point = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        numbered = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(~name.startswith("#"), F.try_element_at(names, name)).otherwise(
            F.when(valid, numbered).otherwise(reference)
        )

    def joined(pieces: Column, references: Column) -> Column:
        return F.array_join(
            F.zip_with(
                pieces,
                references,
                lambda piece, r: F.concat(piece, F.when(r.isNull(), F.lit("")).otherwise(character(r))),
            ),
            "",
        )

    def replaced(own: Column) -> Column:
        whole = let(
            F.split(own, REFERENCE, -1),
            lambda pieces: let(
                F.regexp_extract_all(own, F.lit(REFERENCE), 0),
                lambda references: joined(pieces, references),
            ),
        )
        return F.when(F.contains(own, F.lit("&")), whole).otherwise(own)

    return let(text, replaced)


def squeezed(text: Column) -> Column:
    """One space for each run of blanks, one line feed for each run with a line break in it."""
    blanks = F.regexp_replace(text, BLANKS, " ")
    return F.trim(F.regexp_replace(blanks, LINE_ENDS, "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """What a page shows, block elements on lines of their own; scripts and the head are left out."""
    shown = F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), SPACES, " ")
    lines = F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), TAG, "")
    return squeezed(decoded(lines))


def attribute(tag: str, name: str) -> str:
    """A pattern whose group is the first such attribute of a tag: quoted either way, or bare."""
    return rf"""(?is)<{tag}\b[^>]*?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"']|[\"']$", "")


def page_responses(
    pages: DataFrame,
    id_col: str = "page_id",
    uri_col: str = "url",
    html_col: str = "html",
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Response records `(key, record_id, target_uri, date, block, payload_digest)` of pages.

    The block is an HTTP response whose payload is the page. A null page has an empty payload,
    a null address is empty.
    """
    html, uri = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(uri_col), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html),
        F.lit(CRLF + CRLF),
    )
    return pages.select(
        F.col(id_col).alias("key"),
        urn(F.concat_ws("\n", F.lit("response"), F.col(id_col), uri, html)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head, html).alias("block"),
        digest(html).alias("payload_digest"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response `(key, record_id, target_uri, date, block, payload_digest)`.

    A `metadata` record lists the status, every header of the source, the title, language and
    links of a page. A `conversion` record is the text: what an HTML payload shows, or a text
    payload as it is; responses of other types have metadata alone. Both refer to the
    response by its id, address and date, keep its payload digest (a missing one is computed;
    `digest_matches` tells whether a given one is that of the payload), and have a digest of
    their own block. Record ids depend on the content, so a rerun gives the same.

    A null or empty block has no headers and no payload, and is taken for an empty page; a
    block without an empty line is all payload; a null id or address is empty. Repeated rows
    give repeated records; an empty table gives none. Other columns are ignored.
    """
    block = F.coalesce(F.col("block"), F.lit(""))
    parts = responses.select(
        "key",
        F.coalesce("record_id", F.lit("")).alias("source_id"),
        F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        "date",
        F.col("payload_digest").alias("given"),
        block.alias("block"),
        F.when(F.contains(block, F.lit(CRLF * 2)), F.substring_index(block, CRLF * 2, 1))
        .otherwise(F.lit(""))
        .alias("head"),
    )
    parts = parts.withColumn(
        "payload",
        F.when(
            F.col("head") != "",
            F.substring("block", F.length("head") + 5, F.length("block")),
        ).otherwise(F.col("block")),
    ).withColumn("headers", F.filter(F.split("head", CRLF, -1), lambda line: F.contains(line, F.lit(":"))))
    kind = F.get(
        F.filter("headers", lambda line: F.lower(line).startswith("content-type:")), F.lit(0)
    )
    kind = F.coalesce(F.lower(F.trim(F.substring_index(kind, ":", -1))), F.lit("text/html"))
    parts = parts.withColumn("kind", kind)
    is_page = F.col("kind").startswith("text/html") | F.col("kind").startswith("application/xhtml")
    parts = parts.withColumn("is_page", is_page).withColumn(
        "text",
        F.when(F.col("is_page"), plain_text(F.col("payload"))).when(
            F.col("kind").startswith("text/"), F.col("payload")
        ),
    )
    page = F.when(F.col("is_page"), F.col("payload")).otherwise(F.lit(""))
    title = squeezed(decoded(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " ")))
    language = unquoted(F.regexp_extract(page, attribute("html", "lang"), 1))
    links = F.regexp_extract_all(page, F.lit(attribute("a", "href")), 1)
    links = F.transform(
        links,
        lambda link: F.concat(
            F.lit("outlink: "), decoded(F.regexp_replace(unquoted(link), r"\s+", " "))
        ),
    )
    fields = F.concat(
        F.array(F.concat(F.lit("status: "), F.regexp_extract("head", r"^HTTP/[0-9.]+ ([0-9]+)", 1))),
        F.transform("headers", lambda line: F.concat(F.lit("source-header: "), line)),
        F.array(F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), language)),
        links,
    )
    metadata = F.struct(
        F.lit("metadata").alias("record_type"),
        F.lit("application/warc-fields").alias("content_type"),
        F.array_join(F.transform(fields, lambda f: F.concat(f, F.lit(CRLF))), "").alias("block"),
    )
    conversion = F.struct(
        F.lit("conversion").alias("record_type"),
        F.lit("text/plain; charset=utf-8").alias("content_type"),
        F.col("text").alias("block"),
    )
    own = digest(F.col("payload"))
    records = parts.select(
        "key",
        "source_id",
        "target_uri",
        "date",
        "headers",
        F.coalesce("given", own).alias("payload_digest"),
        (F.col("given").isNull() | (F.col("given") == own)).alias("digest_matches"),
        F.explode(F.array(metadata, conversion)).alias("made"),
    ).where("made.block is not null")
    made = F.col("made.block")
    return records.select(
        "key",
        "made.record_type",
        urn(F.concat_ws("\n", "made.record_type", "source_id", made)).alias("record_id"),
        F.col("source_id").alias("refers_to"),
        "target_uri",
        F.col("date").alias("refers_to_date"),
        "made.content_type",
        "payload_digest",
        "digest_matches",
        digest(made).alias("block_digest"),
        F.octet_length(made).cast("long").alias("content_length"),
        F.col("headers").alias("source_headers"),
        made.alias("block"),
    )


def rendered(records: DataFrame, date: Column) -> Column:
    """A derived record as WARC/1.1 text without the two line ends behind it.

    Written by `write.text` with those as `lineSep`, a file is a sequence of records.
    """
    def field(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else records[value])

    lines = [
        F.lit("WARC/1.1"),
        field("WARC-Type", "record_type"),
        field("WARC-Record-ID", "record_id"),
        field("WARC-Refers-To", "refers_to"),
        field("WARC-Refers-To-Target-URI", "target_uri"),
        field("WARC-Refers-To-Date", F.coalesce(records["refers_to_date"], F.lit(""))),
        field("WARC-Target-URI", "target_uri"),
        field("WARC-Date", date),
        field("WARC-Payload-Digest", "payload_digest"),
        field("WARC-Block-Digest", "block_digest"),
        field("Content-Type", "content_type"),
        field("Content-Length", records["content_length"].cast("string")),
        F.lit(""),
        records["block"],
    ]
    return F.concat_ws(CRLF, *lines)


def write_warc(records: DataFrame, path: str, date: Column) -> None:
    """The records as gzipped WARC text files, one per partition."""
    records.select(rendered(records, date).alias("value")).write.text(
        path, compression="gzip", lineSep=CRLF * 2
    )
