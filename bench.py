"""Headline timings as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each job runs twice and the
faster run counts, so that the JVM's start does not.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import tempfile
import time
from collections.abc import Callable

import pagelode as pl
from checks import queries as q
from pagelode.session import build_session, shared_dir

RUNS = 2


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    def consume(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    def build() -> None:
        pl.write_index(q.documents(spark, sf), shared_dir(spark, "bench"))

    def stream() -> float:
        source, path = shared_dir(spark, "bench"), shared_dir(spark, "bench")
        pl.encode_messages(q.documents(spark, sf)).repartition(8).write.parquet(source)
        start = time.perf_counter()
        messages = pl.file_messages(spark, source, maxFilesPerTrigger="4")
        pl.index_stream(
            messages, path, f"{path}/checkpoint", order=(), available_now=True
        ).awaitTermination()
        return time.perf_counter() - start

    index = q.stored_index(spark, sf)
    requests = q.requests(spark, sf)
    jobs: dict[str, Callable[[], float | None]] = {
        "index_build": build,
        "search_batch": lambda: consume(pl.search_many(index, requests)),
        "search_batch_bm25": lambda: consume(pl.search_many(index, requests, None)),
        "search_batch_python_reranker": lambda: consume(
            pl.search_many(index, requests, q.overlap_reranker)
        ),
        "search_single": lambda: consume(pl.search(index, q.SINGLE_QUERY, q.K)),
        "bm25_scores": lambda: consume(q.bm25_scores(spark, sf)),
        "doc_frequency": lambda: consume(q.doc_frequency(spark, sf)),
        "upsert_cumulative": lambda: consume(q.upsert_cumulative(spark, sf)),
        "decode_messages": lambda: consume(q.decode_bad_rows(spark, sf)),
        "stream_catch_up": stream,
    }
    seconds = {name: min(_timed(job) for _ in range(RUNS)) for name, job in jobs.items()}
    report = {
        "metric": "total time of the headline jobs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(report))


def _timed(job: Callable[[], float | None]) -> float:
    start = time.perf_counter()
    with contextlib.redirect_stdout(sys.stderr):
        own = job()
    return own if own is not None else time.perf_counter() - start


if __name__ == "__main__":
    main()
