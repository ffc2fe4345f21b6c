"""The registered queries: each operator over whole driver tables.

Documents are pages (id=doc_id, url=source, title='', body=text), benchmark texts are
queries, conversations are a page log (id=conv_id, seq=turn, title=role, body=text)
whose pages are sent again and again, and raw web pages are message payloads.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import pagelode as pl
from pagelode.functions import scoring, text
from pagelode.operators import index as ix
from pagelode.operators import rerank, retrieval
from pagelode.plans.search import rerank_candidates
from pagelode.schemas import MESSAGE, PAGE, PAGE_FIELDS
from pagelode.session import session_conf, shared_dir
from pagelode.streaming.indexing import read_rejects

# Parameters that the SQL checks use as well.
SINGLE_QUERY = "The ouen of that, ELLE les una spark the"
K = 10
OTHER_K1, OTHER_B = 2.0, 0.3
MESSAGE_KINDS = 21
WORSE = 1_000_000
STREAM_REFRESH = 3

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return pl.as_pages(table(spark, sf, "documents"), "doc_id", url="source", body="text")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return pl.as_queries(table(spark, sf, "benchmark"), "item_id", "text", K)


def requests_of_any_k(spark: SparkSession, sf: str) -> DataFrame:
    """Queries whose k runs from -2 to 32, around both bounds of the pool."""
    k = (F.col("item_id") % 35 - 2).cast("int")
    return pl.as_queries(table(spark, sf, "benchmark"), "item_id", "text", k)


def page_log(spark: SparkSession, sf: str) -> DataFrame:
    return pl.as_pages(
        table(spark, sf, "conversations"), "conv_id", title="role", body="text", seq="turn"
    )


@functools.cache
def _stored(spark: SparkSession, sf: str) -> str:
    path = shared_dir(spark, "index")
    pl.write_index(documents(spark, sf), path, unique_ids=True)
    return path


def stored_index(spark: SparkSession, sf: str) -> pl.SearchIndex:
    """The index over the documents, stored once per session and read many times."""
    return pl.open_index(spark, _stored(spark, sf))


@functools.cache
def _extended(spark: SparkSession, sf: str) -> str:
    path = shared_dir(spark, "index")
    odd = F.col("id").cast("long") % 2 == 1
    pl.write_index(documents(spark, sf).filter(odd), path, unique_ids=True, vectors=True)
    pl.extend_index(documents(spark, sf).filter(~odd), path)
    return path


def extended_index(spark: SparkSession, sf: str) -> pl.SearchIndex:
    """The same documents in two segments, with their vectors."""
    return pl.open_index(spark, _extended(spark, sf))


# Text functions


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.normalize(F.col("text")).alias("normalized"))


def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return _elements(docs, "doc_id", text.tokens(F.col("text")), "token")


def indexed_text(spark: SparkSession, sf: str) -> DataFrame:
    return page_log(spark, sf).select(
        "id", "seq", text.indexed_text(F.col("title"), F.col("body")).alias("indexed")
    )


def body_truncate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.truncate_utf8(F.col("text")).alias("body"))


def whitespace_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return _elements(docs, "doc_id", text.whitespace_tokens(F.col("text")), "word")


def pool_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return requests_of_any_k(spark, sf).select(
        "qid",
        "k",
        scoring.pool_size(F.col("k")).alias("pool"),
        F.least(F.col("k"), F.lit(scoring.MIN_POOL)).alias("least"),
    )


# Index statistics


def doc_length(spark: SparkSession, sf: str) -> DataFrame:
    index = pl.build_index(documents(spark, sf), unique_ids=True)
    return index.documents.select("id", "dl")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    index = pl.build_index(documents(spark, sf), unique_ids=True)
    return index.postings.select("id", "term", "tf", "dl")


def doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return pl.build_index(documents(spark, sf), unique_ids=True).doc_freq


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = pl.build_index(documents(spark, sf), unique_ids=True)
    return index.corpus_stats.withColumn("avgdl", F.round("avgdl", 6))


def index_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Stored index: statistics together with the document frequencies they belong to."""
    index = stored_index(spark, sf)
    stats = index.corpus_stats
    return index.doc_freq.select(
        "term",
        "df",
        stats.select("n").scalar().alias("n"),
        F.round(stats.select("avgdl").scalar(), 6).alias("avgdl"),
    )


def term_idf(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of queries and conversations; many of them are in no document."""
    asked = _elements(requests(spark, sf), "qid", text.tokens(F.col("query")), "term")
    told = _elements(page_log(spark, sf), "id", text.tokens(F.col("body")), "term")
    terms = asked.select("term").unionByName(told.select("term"))
    stats = pl.term_stats(stored_index(spark, sf), terms)
    return stats.withColumn("idf", F.round("idf", 6))


# Retrieval


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.candidates(stored_index(spark, sf), requests(spark, sf))


def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = retrieval.bm25_scores(stored_index(spark, sf), requests(spark, sf))
    return scores.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(pl.search_many(stored_index(spark, sf), requests(spark, sf), None)).select(
        "qid", "rank", "id", "score"
    )


def bm25_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores with documents left out that can't reach a pool, on an index of two segments."""
    queries = requests_of_any_k(spark, sf).filter(F.col("k") > 0)
    pool = retrieval.rerank_pool(extended_index(spark, sf), queries, prune_rows=0)
    return _rounded(pool)


def pruning_report(spark: SparkSession, sf: str) -> DataFrame:
    """For each query its candidates, and how many of them were scored for its pool."""
    index, queries = stored_index(spark, sf), requests(spark, sf)
    pruned = retrieval.pruned_scores(index, queries, prune_rows=0)
    scored = pruned.scored.groupBy("qid").agg(F.count(F.lit(1)).alias("scored"))
    every = retrieval.candidates(index, queries).groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"))
    return every.join(scored, "qid", "left")


def rerank_pool(spark: SparkSession, sf: str) -> DataFrame:
    queries = requests_of_any_k(spark, sf).filter(F.col("k") > 0)
    return _rounded(retrieval.rerank_pool(stored_index(spark, sf), queries))


# Reranking


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    counts = text.value_counts(text.whitespace_tokens(F.col("text")), "token", "count")
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.round(text.vector_norm(counts), 6).alias("norm"))


def bow_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = rerank.bow_vectors(table(spark, sf, "documents"), "doc_id", "text")
    return vectors.withColumn("weight", F.round("weight", 6))


def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = rerank.with_cosine(rerank_candidates(stored_index(spark, sf), requests(spark, sf)))
    return scored.select("qid", "id", F.round("cosine", 6).alias("cosine"))


def rerank_order(spark: SparkSession, sf: str) -> DataFrame:
    return pl.cosine_rerank(rerank_candidates(stored_index(spark, sf), requests(spark, sf)))


# Search


def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(pl.search_many(stored_index(spark, sf), requests(spark, sf)))


def search_any_k(spark: SparkSession, sf: str) -> DataFrame:
    found = pl.search_many(stored_index(spark, sf), requests_of_any_k(spark, sf))
    return _rounded(found).select("qid", "rank", "id", "score")


def search_single(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(pl.search(stored_index(spark, sf), SINGLE_QUERY, K))


def search_stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The batch search on documents that keep their vectors, in two segments."""
    return _rounded(pl.search_many(extended_index(spark, sf), requests(spark, sf)))


def search_by_term(spark: SparkSession, sf: str) -> DataFrame:
    """The single search on postings stored by term, in two segments."""
    path = shared_dir(spark, "by-term")
    odd = F.col("id").cast("long") % 2 == 1
    pl.write_index(documents(spark, sf).filter(odd), path, by_term=True)
    return _rounded(pl.search(pl.extend_index(documents(spark, sf).filter(~odd), path), SINGLE_QUERY, K))


def search_unstored(spark: SparkSession, sf: str) -> DataFrame:
    """The same search on an index that is derived on the fly, with repeated ids."""
    found = pl.search_many(pl.build_index(page_log(spark, sf)), requests(spark, sf))
    return _rounded(found)


def some_answers(candidates: DataFrame) -> DataFrame:
    """A reranker that fails for every third query, and orders only every other document of
    the rest, by id."""
    order = Window.partitionBy("qid").orderBy(F.col("id").cast("long").desc())
    answered = candidates.filter(
        (F.col("qid").cast("long") % 3 != 0) & (F.col("id").cast("long") % 2 == 0)
    )
    return answered.select("qid", "id", (F.row_number().over(order) - 1).alias("pos"))


def search_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 order where the reranker says nothing, for a whole query or for a document."""
    found = pl.search_many(stored_index(spark, sf), requests(spark, sf), some_answers)
    return _rounded(found)


def search_other_parameters(spark: SparkSession, sf: str) -> DataFrame:
    found = pl.search_many(stored_index(spark, sf), requests(spark, sf), k1=OTHER_K1, b=OTHER_B)
    return _rounded(found)


def reranker_beyond_pool(spark: SparkSession, sf: str) -> DataFrame:
    """A reranker that names all matching ids, in the pool or not, the smallest first."""
    index, queries = stored_index(spark, sf), requests(spark, sf)
    known = retrieval.candidates(index, queries)

    def reranker(candidates: DataFrame) -> DataFrame:
        pos = F.col("id").cast("long")
        pool = candidates.select("qid", "id", (WORSE + F.col("bm25_rank")).alias("pos"))
        return known.select("qid", "id", pos.alias("pos")).unionByName(
            pool.join(known, ["qid", "id"], "left_anti")
        )

    return _rounded(pl.search_many(index, queries, reranker))


def external_order(spark: SparkSession, sf: str) -> DataFrame:
    """An order from elsewhere: all labelled documents that match, good ones first.

    It reaches outside the pool, leaves out most candidates, names some twice, and is
    empty for every fifth query.
    """
    index, queries = stored_index(spark, sf), requests(spark, sf)
    matches = retrieval.candidates(index, queries).filter(F.col("qid").cast("int") % 5 != 0)
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("id"), "quality", "toxic"
    )
    bad_after_good = (1 - F.col("quality")) * WORSE + F.col("id").cast("long") % WORSE
    listed = matches.join(labels, "id").withColumn("pos", bad_after_good)
    again = F.when(F.col("toxic") == 1, F.col("pos") + 2 * WORSE)
    order = listed.select("qid", "id", F.explode(F.array("pos", again)).alias("pos"))
    order = order.filter(F.col("pos").isNotNull())
    return _rounded(pl.search_with_order(index, queries, order))


def overlap_reranker(candidates: DataFrame) -> DataFrame:
    """A reranker with a model in Python: distinct words shared with the query."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch["query"].str.lower().str.split()
            told = (batch["title"] + " " + batch["body"]).str.lower().str.split()
            shared = [len(set(a) & set(b)) for a, b in zip(asked, told, strict=True)]
            yield batch[["qid", "id", "bm25_rank"]].assign(shared=shared)

    schema = "qid string, id string, bm25_rank int, shared long"
    order = Window.partitionBy("qid").orderBy(F.col("shared").desc(), F.col("bm25_rank"))
    scored = candidates.select("qid", "query", "id", "title", "body", "bm25_rank")
    return scored.mapInPandas(score, schema).select(
        "qid", "id", (F.row_number().over(order) - 1).alias("pos")
    )


def pluggable_reranker(spark: SparkSession, sf: str) -> DataFrame:
    found = pl.search_many(stored_index(spark, sf), requests(spark, sf), overlap_reranker)
    return _rounded(found)


# Repeated ids


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return pl.build_index(page_log(spark, sf)).postings.select("id", "term", "tf", "dl")


def upsert_latest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _with_stats(pl.build_index(page_log(spark, sf)))


def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    return pl.build_index(page_log(spark, sf)).documents.select(*PAGE_FIELDS, "dl")


def upsert_extended(spark: SparkSession, sf: str) -> DataFrame:
    """An index over what users said, extended by all other turns, earlier or later."""
    path, log = shared_dir(spark, "extended"), page_log(spark, sf)
    pl.extend_index(log.filter(F.col("title") == "user"), path)
    return _with_stats(pl.extend_index(log.filter(F.col("title") != "user"), path))


def extend_unordered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, then the same ids without an order: every body is the new one."""
    path, docs = shared_dir(spark, "unordered"), documents(spark, sf)
    pl.extend_index(docs, path)
    again = docs.withColumn("body", F.concat(F.reverse("url"), F.lit(" "), "body"))
    return pl.extend_index(again, path).documents.select(*PAGE_FIELDS, "dl")


def extend_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """The page log in mode cumulative in three calls, the newest turns not last."""
    path, log = shared_dir(spark, "cumulative"), page_log(spark, sf)
    for part in (1, 2, 0):
        index = pl.extend_index(log.filter(F.col("seq") % 3 == part), path, "cumulative")
    return _with_stats(index)


def extend_cumulative_postings(spark: SparkSession, sf: str) -> DataFrame:
    path, log = shared_dir(spark, "cumulative"), page_log(spark, sf)
    for user in (True, False):
        part = log.filter((F.col("title") == "user") == user)
        index = pl.extend_index(part, path, "cumulative")
    return index.postings.select("id", "term", "tf", "dl")


def upsert_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    index = pl.build_index(page_log(spark, sf), mode="cumulative")
    return index.postings.select("id", "term", "tf", "dl")


def upsert_cumulative_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _with_stats(pl.build_index(page_log(spark, sf), mode="cumulative"))


def upsert_cumulative_search(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "cumulative")
    index = pl.write_index(page_log(spark, sf), path, mode="cumulative")
    return _rounded(pl.search_many(index, requests(spark, sf))).select(
        "qid", "rank", "id", "score"
    )


# Messages and streams


def encode_decode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    pages = pl.as_pages(table(spark, sf, "pages"), "page_id", url="url", body="html")
    return pl.decode_messages(pl.encode_messages(pages))


def message_keys(spark: SparkSession, sf: str) -> DataFrame:
    pages = pl.as_pages(table(spark, sf, "pages"), "page_id", url="url", body="html")
    messages = pl.encode_messages(pages)
    value = F.col("value").cast("string")
    return messages.select(
        F.col("key").cast("string").alias("key"),
        F.get_json_object(value, "$.id").alias("id"),
        F.get_json_object(value, "$.url").alias("url"),
        F.array_join(F.json_object_keys(value), ",").alias("fields"),
    )


def mixed_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a message, good or malformed in one of 21 ways by its id."""
    docs = documents(spark, sf).withColumn("doc_id", F.col("id").cast("long"))

    def obj(**fields) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})

    page_id, body = F.col("id"), F.col("body")
    whole = obj(**{name: F.col(name) for name in PAGE_FIELDS})
    values = [
        whole,
        obj(ID=page_id, Body=body),
        obj(id=F.lit(None).cast("string"), body=body),
        obj(id=page_id, extra=F.lit(5), body=body),
        F.concat(F.lit('{"id":"other","id":"'), page_id, F.lit('"}')),
        F.lit("null"),
        obj(id=F.col("doc_id"), body=body),
        obj(id=page_id, title=F.struct(body.alias("a"))),
        F.concat(F.lit("{'id':'"), page_id, F.lit("'}")),
        obj(id=F.lit(True), body=body),
        F.lit(" {} "),
        F.concat(F.lit("{bad"), body),
        F.lit(""),
        F.to_json(F.array(body)),
        F.concat(F.lit('"'), page_id, F.lit('"')),
        F.concat(whole, F.lit(" junk")),
        F.concat(whole, whole),
        F.concat(whole, F.lit(","), whole),
        F.concat(whole, F.lit(" ] {}")),
        F.concat(whole, F.lit(" junk}")),
        F.concat(whole, F.lit("\u0085")),
    ]
    value = F.coalesce(*[F.when(_kind() == number, value) for number, value in enumerate(values)])
    return docs.select(
        F.col("id").cast("binary").alias("key"), value.cast("binary").alias("value"), "doc_id"
    )


def _kind() -> Column:
    return F.col("doc_id") % MESSAGE_KINDS


def decode_bad_rows(spark: SparkSession, sf: str) -> DataFrame:
    return pl.decode_messages(mixed_messages(spark, sf))


@functools.cache
def _streamed(spark: SparkSession, sf: str) -> str:
    """The page log as message files, each page with a broken copy, streamed into an index."""
    source, path = shared_dir(spark, "messages"), shared_dir(spark, "stream")
    good = pl.encode_messages(page_log(spark, sf), "seq")
    bad = page_log(spark, sf).select(
        F.col("id").cast("binary").alias("key"),
        F.concat(F.lit("{bad "), F.col("body")).cast("binary").alias("value"),
        "seq",
    )
    good.unionByName(bad).repartition(4).write.parquet(source)
    messages = pl.file_messages(spark, source, extra="seq BIGINT", maxFilesPerTrigger="2")
    pl.index_stream(
        messages, path, f"{path}/checkpoint", order=["seq"], available_now=True
    ).awaitTermination()
    return path


def _log_files(spark: SparkSession, sf: str, prefix: str, files: int) -> str:
    source = shared_dir(spark, "messages")
    log = page_log(spark, sf).withColumn("id", F.concat(F.lit(prefix), "id"))
    pl.encode_messages(log, "seq").repartition(files).write.parquet(source)
    return source


def stream_onto_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by `write_index`, then conversations streamed in more batches than segments
    may be; the last of them don't fill a refresh."""
    path = shared_dir(spark, "onto")
    pl.write_index(documents(spark, sf), path)
    source = _log_files(spark, sf, "c", 20)
    messages = pl.file_messages(spark, source, extra="seq BIGINT", maxFilesPerTrigger="1")
    with session_conf(spark, spark__sql__shuffle__partitions="2"):
        pl.index_stream(
            messages, path, f"{path}/checkpoint", ["seq"], refresh_every=STREAM_REFRESH, available_now=True
        ).awaitTermination()
    return _with_stats(pl.open_index(spark, path))


def stream_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    path, source = shared_dir(spark, "stream"), _log_files(spark, sf, "", 3)
    messages = pl.file_messages(spark, source, extra="seq BIGINT", maxFilesPerTrigger="1")
    pl.index_stream(
        messages, path, f"{path}/checkpoint", ["seq"], mode="cumulative", available_now=True
    ).awaitTermination()
    return _with_stats(pl.open_index(spark, path))


def stream_restarted(spark: SparkSession, sf: str) -> DataFrame:
    """The page log from files whose reading fails in the first and the second run."""
    path, source = shared_dir(spark, "stream"), _log_files(spark, sf, "", 6)
    runs = iter(range(99))

    def start():
        number = next(runs)
        messages = pl.file_messages(spark, source, extra="seq BIGINT", maxFilesPerTrigger="2")
        broken = F.lit(number < 2) & (F.pmod(F.xxhash64("key"), F.lit(3)) == number)
        value = F.when(broken, F.raise_error(F.lit("read error")).cast("binary"))
        messages = messages.withColumn("value", value.otherwise(F.col("value")))
        return pl.index_stream(messages, path, f"{path}/checkpoint", ["seq"], available_now=True)

    failures = pl.keep_running(start, restarts=5, wait=0.1)
    return _with_stats(pl.open_index(spark, path)).withColumn("failures", F.lit(failures))


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the page log as the state of a stream over its messages."""
    checkpoint, source = shared_dir(spark, "counters"), _log_files(spark, sf, "", 3)
    messages = pl.file_messages(spark, source, extra="seq BIGINT", maxFilesPerTrigger="1")
    pl.count_stream(messages, checkpoint, available_now=True).awaitTermination()
    doc_freq, stats = pl.read_counters(spark, checkpoint)
    return doc_freq.select(
        "term",
        "df",
        stats.select("n").scalar().alias("n"),
        stats.select("total_len").scalar().alias("total_len"),
    )


def publish_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages from a stream of files, published as a stream of messages, and decoded."""
    topic, state = shared_dir(spark, "topic"), shared_dir(spark, "state")
    source = shared_dir(spark, "web")
    pl.as_pages(table(spark, sf, "pages"), "page_id", url="url", body="html").repartition(3).write.parquet(source)
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", "1").parquet(source)
    pl.publish_stream(pages, state, "parquet", topic, available_now=True).awaitTermination()
    return pl.decode_messages(spark.read.schema(MESSAGE).parquet(topic))


def two_writers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, and the two halves of the page log added by two writers at the same time."""
    path, log = shared_dir(spark, "writers"), page_log(spark, sf)
    log = log.withColumn("id", F.concat(F.lit("c"), "id"))
    pl.write_index(documents(spark, sf), path)
    halves = [log.filter((F.col("title") == "user") == user) for user in (True, False)]
    with ThreadPoolExecutor(2) as writers:
        list(writers.map(lambda pages: pl.extend_index(pages, path), halves))
    return _with_stats(pl.open_index(spark, path))


def publish_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages published to files, and read back as a stream of messages."""
    topic, out = shared_dir(spark, "topic"), shared_dir(spark, "pages")
    pages = pl.as_pages(table(spark, sf, "pages"), "page_id", url="url", body="html")
    pl.publish(pages, "parquet", topic)
    stream = pl.decode_messages(pl.file_messages(spark, topic))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    return spark.read.schema(PAGE).parquet(out)


def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    index = pl.open_index(spark, _streamed(spark, sf))
    return index.postings.select("id", "term", "tf", "dl")


def stream_search(spark: SparkSession, sf: str) -> DataFrame:
    index = pl.open_index(spark, _streamed(spark, sf))
    return _rounded(pl.search_many(index, requests(spark, sf)))


def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    rejects = read_rejects(spark, _streamed(spark, sf))
    return rejects.select(F.col("value").cast("string").alias("value"))


def _elements(frame: DataFrame, key: str, array: Column, name: str) -> DataFrame:
    """(key, pos, element) of an array; the outer form keeps it from being made twice."""
    return frame.select(key, F.posexplode_outer(array).alias("pos", name)).filter(
        F.col("pos").isNotNull()
    )


def _with_stats(index: pl.SearchIndex) -> DataFrame:
    stats = index.corpus_stats
    return index.doc_freq.select(
        "term",
        "df",
        stats.select("n").scalar().alias("n"),
        stats.select("total_len").scalar().alias("total_len"),
    )


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        text_normalize,
        text_tokens,
        indexed_text,
        body_truncate,
        whitespace_tokens,
        pool_bounds,
        doc_length,
        postings,
        doc_frequency,
        corpus_stats,
        index_snapshot,
        term_idf,
        candidates,
        bm25_scores,
        bm25_topk,
        bm25_pruned,
        pruning_report,
        rerank_pool,
        vector_norms,
        bow_vectors,
        cosine_scores,
        rerank_order,
        search_batch,
        search_any_k,
        search_single,
        search_stored_vectors,
        search_by_term,
        search_unstored,
        search_fallback,
        search_other_parameters,
        reranker_beyond_pool,
        external_order,
        pluggable_reranker,
        upsert_latest,
        upsert_latest_stats,
        upsert_documents,
        upsert_extended,
        extend_unordered,
        extend_cumulative,
        extend_cumulative_postings,
        upsert_cumulative,
        upsert_cumulative_stats,
        upsert_cumulative_search,
        encode_decode_roundtrip,
        message_keys,
        decode_bad_rows,
        publish_read_back,
        stream_onto_index,
        stream_cumulative,
        stream_restarted,
        two_writers,
        stream_counters,
        publish_streamed,
        stream_index,
        stream_search,
        stream_rejects,
    )
}
