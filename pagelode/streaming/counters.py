"""Running counters of a page stream, kept as the state of the stream itself.

Spark keeps document frequencies, the total length and the ids seen in its state store and
writes them with each batch's checkpoint. They can be read from there at any time, also
while the stream runs or after it has stopped, without an index. As in an index of mode
`cumulative`, every version of a page counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelode.operators.index import page_tokens, with_average
from pagelode.session import session_conf
from pagelode.sources.messages import decode_messages

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERM, PAGE, LENGTH = "term", "page", "length"


def count_stream(
    messages: DataFrame, checkpoint: str, available_now: bool = False, interval: str = "1 minute"
) -> StreamingQuery:
    """Start counting the pages of a stream of messages; returns the running query.

    A page adds 1 to each of its distinct terms and to its id, and its length to the total.
    Counts combine before the shuffle, so a frequent term or page is a row per task. The
    state lies in RocksDB on local disks, of which changes go to the checkpoint.
    """
    pages = decode_messages(messages).select("id", page_tokens().alias("words"))
    one = F.lit(1).cast("bigint")

    def counted(kind: str, name, adds):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), adds.alias("adds"))

    rows = F.concat(
        F.transform(F.array_distinct("words"), lambda word: counted(TERM, word, one)),
        F.array(
            counted(PAGE, F.col("id"), one),
            counted(LENGTH, F.lit(""), F.size("words").cast("bigint")),
        ),
    )
    counts = pages.select(F.inline_outer(rows)).groupBy("kind", "name").agg(F.sum("adds").alias("total"))
    writer = counts.writeStream.outputMode("update").foreachBatch(_state_only)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    with session_conf(messages.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKS_DB):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _state_only(changed: DataFrame, batch_id: int) -> None:
    """Runs the batch; what it changes is in the state."""
    changed.write.format("noop").mode("overwrite").save()


def read_counters(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """`(term, df)` and one row `(n, total_len, avgdl)`, as of the last batch that is done."""
    state = spark.read.format("statestore").load(checkpoint)
    state = state.select("key.kind", "key.name", F.col("value.sum").alias("total"))
    doc_freq = state.filter(F.col("kind") == TERM).select(
        F.col("name").alias("term"), F.col("total").alias("df")
    )
    zero = F.lit(0).cast("bigint")
    stats = state.agg(
        F.count_if(F.col("kind") == PAGE).alias("n"),
        F.coalesce(F.sum(F.when(F.col("kind") == LENGTH, F.col("total"))), zero).alias("total_len"),
    )
    return doc_freq, with_average(stats)
