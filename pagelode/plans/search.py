"""Search: BM25, rerank, merge and top k over a whole table of queries.

Results are rows (qid, rank, id, url, title, body, score). The body is cut to 512
bytes, and the score is the BM25 score even where the reranker changed the order.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.scoring import K1, B
from pagelode.functions.text import bow_vector, indexed_text, tokens, truncate_utf8
from pagelode.operators.index import SearchIndex, analysed_once, shard_of
from pagelode.operators.ranking import top_per_key
from pagelode.operators.rerank import (
    Reranker,
    bow_vectors,
    cosine_order,
    cosine_rerank,
    merge_order,
    pool_cosines,
    resolve_order,
)
from pagelode.operators.retrieval import (
    BROADCAST_ROWS,
    BatchSize,
    bm25_scores,
    feeding_tasks,
    measure,
    part_count,
    rerank_pool,
    score_order,
    small,
)
from pagelode.operators.store import BROADCAST_ID_BYTES
from pagelode.session import fits, shared_dir

RESULT = ("qid", "rank", "id", "url", "title", "body", "score")


def search(
    index: SearchIndex,
    query: str,
    k: int,
    reranker: Reranker | None = cosine_rerank,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """Answer one query. Its terms become literals, which prune the index scans."""
    request = index.spark.range(1).select(
        F.lit("0").alias("qid"), F.lit(query).alias("query"), F.lit(k).alias("k")
    )
    terms = request.select(F.array_distinct(tokens(F.col("query")))).first()[0]
    return search_many(index.for_terms(terms), request, reranker, k1, b).drop("qid")


def search_many(
    index: SearchIndex,
    queries: DataFrame,
    reranker: Reranker | None = cosine_rerank,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """Answer a table of queries (qid, query, k), qid being unique.

    Without a reranker the BM25 order stands. A reranker sees the pool, and its order may
    name any other document that matches. A query without terms, hits, or a positive k has
    no rows.
    """
    index, queries = analysed_once(index), _answerable(queries)
    size = measure(queries, index)
    pool = settle(index, rerank_pool(index, queries, size, k1=k1, b=b))
    limits = small(queries.select("qid", "k"), size.broadcast_queries)

    if reranker is None:
        top = pool.join(limits, "qid").filter(F.col("bm25_rank") <= F.col("k"))
        return _results(_shown(index, top, size), "bm25_rank")

    if reranker is cosine_rerank:
        # One read of the pooled documents gives both what is ranked and what is shown.
        pooled = pooled_documents(index, pool, size.broadcast_pool)
        vector = bow_vector(indexed_text(F.col("title"), F.col("body")))
        if "vector" in pooled.columns:
            vector = F.col("vector")
        cut = truncate_utf8(F.col("body")).alias("body")
        told = settle(index, pooled.select("id", "url", "title", cut, vector.alias("vector")))
        ranked = pool_cosines(
            pool,
            bow_vectors(queries, "qid", "query"),
            told.select("id", F.inline_outer("vector")),
            size.broadcast_pool_words,
        )
        ranked = top_per_key(ranked, "qid", cosine_order(), max(size.max_k, 1), "rank")
        top = ranked.join(limits, "qid").filter(F.col("rank") <= F.col("k"))
        shown = told.select("id", "url", "title", "body")
        return _results(shown.join(small(top, size.broadcast_pool), "id"), "rank")

    order = settle(index, resolve_order(reranker(_candidates(index, queries, pool, size))))
    # Behind what the order names come the best of the rest, and these are all in the pool.
    scored = pool.select("qid", "id", "score")
    beyond = order.select("qid", "id").join(scored, ["qid", "id"], "left_anti")
    if not beyond.isEmpty():
        whole = bm25_scores(index, queries, size, k1, b)
        if not fits(order, ["qid", "id"], BROADCAST_ROWS, BROADCAST_ID_BYTES):
            # The order is as large as the scores: they meet once, without being picked first.
            return _merged(index, whole, order, limits, size, feeding_tasks(index, size))
        scored = scored.unionByName(whole.join(F.broadcast(beyond), ["qid", "id"], "left_semi"))
    return _merged(index, scored, order, limits, size, feeding=1)


def rerank_candidates(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """What a reranker gets: (qid, query, id, title, body, bm25_rank), bodies whole."""
    index, queries = analysed_once(index), _answerable(queries)
    size = measure(queries, index)
    return _candidates(index, queries, settle(index, rerank_pool(index, queries, size)), size)


def search_with_order(
    index: SearchIndex, queries: DataFrame, order: DataFrame, k1: float = K1, b: float = B
) -> DataFrame:
    """Answer queries with an order (qid, id, pos) that comes from elsewhere.

    It may name any candidate, also outside the rerank pool, may repeat or miss ids,
    and may name documents that do not match, which are left out.
    """
    index, queries = analysed_once(index), _answerable(queries)
    size = measure(queries, index)
    scored = bm25_scores(index, queries, size, k1, b)
    limits = small(queries.select("qid", "k"), size.broadcast_queries)
    order = settle(index, resolve_order(order))  # it is counted, then joined
    return _merged(index, scored, order, limits, size, feeding_tasks(index, size))


def settle(index: SearchIndex, rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back.

    What led to them runs once, however often they are used, and is not repeated
    after the loss of an executor. A pool also becomes a plain table to prune the
    documents by: Spark prunes partitions by a join only if it finds the joined plan
    again unchanged, which a ranking window prevents.
    """
    path = shared_dir(index.spark, "search")
    rows.write.parquet(path)
    return index.spark.read.schema(rows.schema).parquet(path)


def fetch(index: SearchIndex, pool: DataFrame, broadcast: bool) -> DataFrame:
    """Add url, title and body to rows with an id."""
    return _documents_of(index, pool, broadcast, "inner")


def _shown(index: SearchIndex, top: DataFrame, size: BatchSize) -> DataFrame:
    """Add url, title and the cut body to rows with an id; a whole body goes nowhere."""
    if size.broadcast_pool:
        return fetch(index, top, True)
    cut = truncate_utf8(F.col("body")).alias("body")
    told = pooled_documents(index, top, False).select("id", "url", "title", cut)
    return top.join(told, "id")


def pooled_documents(index: SearchIndex, pool: DataFrame, broadcast: bool) -> DataFrame:
    """The documents of a pool, each once; see `_by_shard`."""
    return _by_shard(index, pool.select("id").distinct(), broadcast, "left_semi")


def _by_shard(index: SearchIndex, rows: DataFrame, broadcast: bool, how: str) -> DataFrame:
    """Documents joined with rows that have an id, where the documents lie.

    Rows for a stored index that are too many for one broadcast are taken shard by shard:
    each part of the shards is read once, with the rows whose ids lie in it, and no document is
    shuffled. Only beyond MAX_PARTS broadcasts documents are hashed by id.
    """
    if broadcast or not index.num_shards:
        return _documents_of(index, rows, broadcast, how)
    rows = settle(index, rows)
    texts = [F.octet_length(f.name) for f in rows.schema if f.dataType.typeName() == "string"]
    octets = F.coalesce(F.sum(functools.reduce(Column.__add__, texts) + 32), F.lit(0))
    count, octets = rows.agg(F.count(F.lit(1)), octets).first()
    parts = part_count((count, BROADCAST_ROWS), (octets, BROADCAST_ID_BYTES))
    if not parts:
        return _documents_of(index, rows, False, how)
    return functools.reduce(
        DataFrame.unionByName,
        [
            _documents_of(index, rows, True, how, F.col("shard") % parts == number)
            for number in range(min(parts, index.num_shards))
        ],
    )


def _documents_of(
    index: SearchIndex,
    pool: DataFrame,
    broadcast: bool,
    how: str,
    shards: Column | None = None,
) -> DataFrame:
    """Join documents with a pool, segment by segment.

    A pool of known small size is broadcast with the shard of each id, so that Spark
    reads only those partitions of a stored index and shuffles no document.
    """
    keys = ["id"]
    if index.num_shards:
        keys = ["shard", "id"]
        pool = pool.withColumn("shard", shard_of("id", index.num_shards))
        # Always true; tells Spark that pruning by this side is worth it.
        pool = pool.filter(F.col("shard") >= 0 if shards is None else shards)
    found = []
    for part in index.parts:
        stored = ["vector"] if "vector" in part.documents.columns and how == "left_semi" else []
        documents = part.documents.select(*keys, "url", "title", "body", *stored)
        documents = documents if shards is None else documents.filter(shards)
        found.append(part.live(documents.join(small(pool, broadcast), keys, how)))
    return functools.reduce(DataFrame.unionByName, found).drop("shard")


def _candidates(
    index: SearchIndex, queries: DataFrame, pool: DataFrame, size: BatchSize
) -> DataFrame:
    """Rows for a reranker. The queries are joined to the pool, which has no body yet; a body is
    read once and goes to all queries that pool it in the task that reads it."""
    asked = small(queries.select("qid", "query"), size.broadcast_queries)
    wanted = pool.select("qid", "id", "bm25_rank").join(asked, "qid")
    return _by_shard(index, wanted, size.broadcast_pool, "inner").select(
        "qid", "query", "id", "title", "body", "bm25_rank"
    )


def _answerable(queries: DataFrame) -> DataFrame:
    return queries.select("qid", "query", "k").filter(F.col("k") > 0)


def _merged(
    index: SearchIndex,
    scored: DataFrame,
    order: DataFrame,
    limits: DataFrame,
    size: BatchSize,
    feeding: int,
) -> DataFrame:
    few = feeding > 1 and fits(order, ["qid", "id"], BROADCAST_ROWS, BROADCAST_ID_BYTES)
    order = small(order, few)
    ranked = top_per_key(
        scored.join(order, ["qid", "id"], "left"),
        "qid",
        score_order(*merge_order()),
        max(size.max_k, 1),
        "rank",
        feeding,
    )
    top = settle(index, ranked.join(limits, "qid").filter(F.col("rank") <= F.col("k")))
    return _results(_shown(index, top, size), "rank")


def _results(ranked: DataFrame, rank: str) -> DataFrame:
    # Cutting a body that is cut already leaves it as it is.
    return ranked.select(
        "qid",
        F.col(rank).alias("rank"),
        "id",
        "url",
        "title",
        truncate_utf8(F.col("body")).alias("body"),
        "score",
    )
