"""Pages as key/value messages: encode, decode, publish, and message sources.

The sources and the sink are thin layers over Spark's connectors, so Kafka and a
folder of files are interchangeable as long as they carry `key` and `value`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelode.functions.text import let
from pagelode.schemas import MESSAGE, PAGE_FIELDS
from pagelode.session import session_conf

# Topic name and the producer's time limit in milliseconds.
PAGES_TOPIC = "pages"
SEND_TIMEOUT_MS = 5000

# A JSON object or null with nothing but blanks around it. The JSON parser itself would
# accept trailing text, also text that ends in a brace.
_WHOLE_VALUE = r"(?s)\A[ \t\r\n]*(\{.*\}|null)[ \t\r\n]*\z"
_VOID, _STRING = "VOID", "STRING"


def encode_messages(pages: DataFrame, *keep: str) -> DataFrame:
    """One message per page: the id as key, the page as JSON in the value."""
    page = [F.coalesce(F.col(name), F.lit("")).alias(name) for name in PAGE_FIELDS]
    return pages.select(
        F.coalesce(F.col("id"), F.lit("")).cast("binary").alias("key"),
        F.to_json(F.struct(*page)).cast("binary").alias("value"),
        *keep,
    )


def publish(pages: DataFrame, format: str = "kafka", path: str | None = None, **options: str) -> None:
    """Write pages as messages to a Kafka topic, or to files of any Spark format.

    Kafka places messages by key hash, which keeps the versions of one page in order.
    """
    if format == "kafka":
        options = {"topic": PAGES_TOPIC, **producer_options(), **options}
    encode_messages(pages).write.format(format).options(**options).mode("append").save(path)


def publish_stream(
    pages: DataFrame,
    checkpoint: str,
    format: str = "kafka",
    path: str | None = None,
    available_now: bool = False,
    interval: str = "1 second",
    **options: str,
) -> StreamingQuery:
    """Write a stream of pages as messages, from its checkpoint on; returns the running query.

    Files have each page once; Kafka may get a batch again after a failure, which the indexing
    stream takes as the same version of a page.
    """
    if format == "kafka":
        options = {"topic": PAGES_TOPIC, **producer_options(), **options}
    writer = encode_messages(pages).writeStream.format(format).options(**options)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    writer = writer.option("checkpointLocation", checkpoint).trigger(**trigger)
    return writer.start(path) if path else writer.start()


def producer_options() -> dict[str, str]:
    """Producer settings for the send time limit; the request limit must lie below it."""
    return {
        "kafka.delivery.timeout.ms": str(SEND_TIMEOUT_MS),
        "kafka.request.timeout.ms": str(SEND_TIMEOUT_MS - 1000),
        "kafka.linger.ms": "0",
    }


def consumer_options(brokers: str, topic: str = PAGES_TOPIC) -> dict[str, str]:
    """Read from the first offset; later progress lives in the checkpoint.

    Offsets that have expired stop the stream; pass `failOnDataLoss="false"` to go on.
    """
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }


def kafka_messages(
    spark: SparkSession, brokers: str, topic: str = PAGES_TOPIC, **options: str
) -> DataFrame:
    """Stream of a topic: key, value, topic, partition, offset, timestamp."""
    return (
        spark.readStream.format("kafka")
        .options(**{**consumer_options(brokers, topic), **options})
        .load()
    )


def file_messages(
    spark: SparkSession, path: str, format: str = "parquet", extra: str = "", **options: str
) -> DataFrame:
    """Stream of message files; `extra` names further columns as DDL, such as `seq BIGINT`."""
    schema = MESSAGE.simpleString()[len("struct<") : -1].replace(":", " ")
    if extra:
        schema = f"{schema}, {extra}"
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def decode_messages(messages: DataFrame, keep_rejects: bool = False) -> DataFrame:
    """Pages from messages; a value that is no page is dropped.

    A page is a JSON object (or null) whose fields id, url, title and body, matched
    in any letter case, are strings, null or absent. Other fields are ignored, and of
    a repeated name the last one counts. All further columns pass through.
    With `keep_rejects`, bad messages stay, with `accepted` false and `value` kept.
    """
    passed = [name for name in messages.columns if name not in ("key", "value", *PAGE_FIELDS)]
    # Read while the expression is built, so the session keeps its own setting.
    with session_conf(messages.sparkSession, spark__sql__variant__allowDuplicateKeys="true"):
        page = _page(F.col("value"))
        if keep_rejects:
            decoded = messages.select(page.alias("page"), *passed, "value")
        else:
            # A filter on what a generator yields is not pushed below it, where it
            # would parse every value a second time.
            decoded = messages.select(F.explode_outer(F.array(page)).alias("page"), *passed)
    if not keep_rejects:
        return decoded.filter(F.col("page").isNotNull()).select("page.*", *passed)
    accepted = F.col("page").isNotNull()
    fields = [F.coalesce(F.col(f"page.{name}"), F.lit("")).alias(name) for name in PAGE_FIELDS]
    return decoded.select(
        *fields,
        *passed,
        accepted.alias("accepted"),
        F.when(~accepted, F.col("value")).alias("value"),
    )


def _page(value: Column) -> Column:
    """The page in a message value as a struct, or null."""

    def from_json(json: Column) -> Column:
        kind = F.schema_of_variant(json)
        entries = F.map_entries(F.try_variant_get(json, "$", "map<string,variant>"))
        empty = F.struct(*[F.lit("").alias(name) for name in PAGE_FIELDS])
        return F.when(kind == _VOID, empty).when(
            F.startswith(kind, F.lit("OBJECT")), let(entries, from_entries)
        )

    def from_entries(entries: Column) -> Column:
        values = F.array(*[_last_entry(entries, name) for name in PAGE_FIELDS])
        return let(values, from_values)

    def from_values(values: Column) -> Column:
        fields = [
            F.coalesce(F.try_variant_get(F.get(values, i), "$", "string"), F.lit("")).alias(name)
            for i, name in enumerate(PAGE_FIELDS)
        ]
        return F.when(F.forall(values, _is_text), F.struct(*fields))

    return let(let(F.make_valid_utf8(value.cast("string")), _one_value), from_json)


def _one_value(text: Column) -> Column:
    """The JSON value that a text is, or null.

    It is parsed alone in an array and as the only field of an object: text behind the value
    breaks one or the other, or adds an element.
    """

    def checked(parsed: Column) -> Column:
        alone = F.size(F.try_variant_get(parsed["alone"], "$", "array<variant>"))
        field = F.size(F.try_variant_get(parsed["field"], "$", "map<string,variant>"))
        return F.when(
            (alone == 1) & (field == 1), F.try_variant_get(parsed["alone"], "$[0]", "variant")
        )

    whole = F.when(text.rlike(_WHOLE_VALUE), text)
    parsed = F.struct(
        F.try_parse_json(F.concat(F.lit("["), whole, F.lit("]"))).alias("alone"),
        F.try_parse_json(F.concat(F.lit('{"v":'), whole, F.lit("}"))).alias("field"),
    )
    return let(parsed, checked)


def _is_text(value: Column) -> Column:
    """Whether a field is a string, null or absent."""
    return F.coalesce(F.schema_of_variant(value), F.lit(_VOID)).isin(_VOID, _STRING)


def _last_entry(entries: Column, name: str) -> Column:
    """Value of the last entry of that name; the name is matched in any letter case."""
    named = F.filter(entries, lambda entry: F.lower(entry["key"]) == name)
    return F.try_element_at(named, F.lit(-1))["value"]
