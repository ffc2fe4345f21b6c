"""Continuous indexing: messages to a page log, and the page log to index versions.

The stream appends each micro-batch of decoded pages to a log, one folder per batch
that a replay overwrites, so the log holds every message once. The pages then extend
whatever index lies at the path. Each extension is a new version; readers go on with
the one they opened. The version names the last batch it has, so no batch counts twice.

    <path>/log/stream=S/batch_id=N/accepted=true|false    pages, or rejected values
    <path>/version=M-.../                                 index versions, see `store`
"""

from __future__ import annotations

import functools
import hashlib
import logging
import re
import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelode.operators.index import SearchIndex
from pagelode.operators.store import applied_batches, extend_index, file_names, open_index
from pagelode.schemas import PAGE_FIELDS
from pagelode.sources.messages import decode_messages

# Columns of a Kafka message that order the versions of a page.
KAFKA_ORDER = ("timestamp", "partition", "offset")

# Segments an index may have before the last of them are merged.
MAX_SEGMENTS = 16

MAIN = "main"

_log = logging.getLogger(__name__)


class IndexingQuery:
    """A running stream; like a StreamingQuery, but its last batches become visible at the end."""

    def __init__(self, query: StreamingQuery, finish) -> None:
        self._query, self._finish = query, finish

    def __getattr__(self, name: str):
        return getattr(self._query, name)

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802
        ended = self._query.awaitTermination(timeout)
        if ended is not False:
            self._finish()
        return ended


def index_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    order: Sequence[str] = KAFKA_ORDER,
    mode: str | None = None,
    refresh_every: int | None = 1,
    available_now: bool = False,
    interval: str = "1 minute",
    num_shards: int | None = None,
) -> IndexingQuery:
    """Start indexing a stream of messages; returns the running query.

    The stream extends the index at `path`, however it was written, or starts one of the
    given mode and number of shards. `order` names the message columns that order the
    versions of a page. With none, later batches win. Every `refresh_every`-th batch makes
    all batches so far visible as one new index version; the rest become so when
    `awaitTermination` returns, at the next refresh, or by `refresh_index`; with None,
    only by those. Restarts go on from the checkpoint, which belongs beside the index.

    A refresh analyses and writes the pages of its batches and reads the rows they replace;
    nothing grows with the index but the ids among which it looks for them. Above MAX_SEGMENTS
    segments, those of like size are merged.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, path, order, stream)
        if refresh_every and not (batch_id + 1) % refresh_every:
            _catch_up(batch.sparkSession, path, stream, batch_id, mode, num_shards)

    writer = messages.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    query = writer.trigger(**trigger).start()

    def finish() -> None:
        if refresh_every:
            _catch_up(messages.sparkSession, path, stream, None, mode, num_shards)

    return IndexingQuery(query, finish)


def keep_running(
    start: Callable[[], StreamingQuery | IndexingQuery],
    restarts: int | None = None,
    wait: float = 1.0,
    longest_wait: float = 60.0,
) -> int:
    """Run a stream until it is stopped, and start it again when it fails; returns how often it failed.

    `start` starts the stream, which goes on from its checkpoint. A failure is logged; the wait
    after it doubles from `wait` to `longest_wait` seconds, and starts anew once a run has
    lasted longer than that. With `restarts`, one failure more is raised.
    """
    failures, pause = 0, wait
    while True:
        began = time.monotonic()
        try:
            start().awaitTermination()
            return failures
        except StreamingQueryException as error:
            failures += 1
            if restarts is not None and failures > restarts:
                raise
            if time.monotonic() - began > longest_wait:
                pause = wait
            _log.warning("the stream failed and starts again in %s s: %s", pause, error)
            time.sleep(pause)
            pause = min(2 * pause, longest_wait)


def append_batch(
    messages: DataFrame, batch_id: int, path: str, order: Sequence[str], stream: str = MAIN
) -> None:
    """Decode one batch into its own folder of the log, in one pass over the messages."""
    seq = [F.col(name) for name in order] or [F.lit(batch_id).cast("bigint").alias("batch")]
    (
        decode_messages(messages, keep_rejects=True)
        .select(*PAGE_FIELDS, F.struct(*seq).alias("seq"), "value", "accepted")
        .write.mode("overwrite")
        .partitionBy("accepted")
        .parquet(_folder(path, stream, batch_id))
    )


def _folder(path: str, stream: str, batch_id: int) -> str:
    return f"{path}/log/stream={stream}/batch_id={batch_id}"


def _catch_up(
    spark: SparkSession,
    path: str,
    stream: str,
    last: int | None,
    mode: str | None,
    num_shards: int | None,
) -> None:
    """Extend the index by the batches of a stream's log that it does not have, up to `last`.

    The log tells which batches there are, also those of a run that failed after it wrote them.
    Only the folders of the missing ones are read.
    """
    done = applied_batches(spark, path).get(stream, -1)
    batches = [
        number
        for number in _logged(spark, path, stream)
        if number > done and (last is None or number <= last)
    ]
    if not batches:
        return
    log = functools.reduce(
        DataFrame.unionByName, [spark.read.parquet(_folder(path, stream, number)) for number in batches]
    )
    extend_index(_pages(log), path, mode, num_shards, {stream: max(batches)}, MAX_SEGMENTS)


def _logged(spark: SparkSession, path: str, stream: str) -> list[int]:
    """Numbers of the batches of a stream that are written whole and had messages."""
    names = file_names(spark, f"{path}/log/stream={stream}")
    numbers = sorted(int(match[1]) for name in names if (match := re.fullmatch(r"batch_id=(\d+)", name)))
    found = []
    for number in numbers:
        files = file_names(spark, _folder(path, stream, number))
        if "_SUCCESS" in files and any(name.startswith("accepted=") for name in files):
            found.append(number)
    return found


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """All decoded messages by batch, good and bad; None while there are none."""
    try:
        return spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log")
    except AnalysisException:
        return None


def read_rejects(spark: SparkSession, path: str) -> DataFrame | None:
    """Message values that were no pages, by batch."""
    log = read_log(spark, path)
    return None if log is None else log.filter(~accepted()).select("batch_id", "value")


def refresh_index(
    spark: SparkSession, path: str, mode: str | None = None, num_shards: int | None = None
) -> SearchIndex | None:
    """Extend the index by all batches of the log that it does not have, as a job of its own.

    None while there is neither a log nor an index.
    """
    applied, log = applied_batches(spark, path), read_log(spark, path)
    seen = F.lit(False)
    for stream, last in applied.items():
        seen = seen | ((F.col("stream") == stream) & (F.col("batch_id") <= last))
    rows = [] if log is None else log.filter(~seen).groupBy("stream").agg(F.max("batch_id")).collect()
    if not rows:
        try:
            return open_index(spark, path)
        except ValueError:
            return None
    latest = {stream: last for stream, last in rows}
    return extend_index(_pages(log.filter(~seen)), path, mode, num_shards, latest, MAX_SEGMENTS)


def _pages(log: DataFrame) -> DataFrame:
    return log.filter(accepted()).select(*PAGE_FIELDS, "seq")


def accepted() -> Column:
    return F.col("accepted") == "true"
