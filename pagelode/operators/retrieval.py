"""From queries to scored documents: query terms, candidates, BM25, rerank pool."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import scoring
from pagelode.functions.text import tokens, value_counts, whitespace_tokens
from pagelode.operators.index import SearchIndex
from pagelode.operators.ranking import top_per_key
from pagelode.session import fits, shared_dir, shuffle_partitions

# Sizes up to which the small side of a join is broadcast; beyond, it is shuffled.
BROADCAST_QUERY_BYTES = 4 << 20
BROADCAST_ROWS = 200_000
BROADCAST_WORDS = 1_000_000
BROADCAST_POOL_BYTES = 64 << 20
# Bytes of an id where the index does not tell.
ID_BYTES = 64
# Most broadcasts, one after the other, that a pool is cut into; and a batch, each of whose
# parts reads all postings.
MAX_PARTS = 64
MAX_QUERY_PARTS = 8
# Most distinct terms to pick postings by before they are shuffled, and their most bytes.
BROADCAST_TERMS = 1_000_000
BROADCAST_TERM_BYTES = 32 << 20

# A term is hot if it holds more than this share of all tokens. There can be at most
# one term per share, so the table of hot terms has a bound whatever the corpus.
HOT_TERM_SHARE = 1e-4

# Queries of a broadcast batch whose scores are summed up side by side, as columns of a row of
# one document; and for candidates, as bits of a long.
SCORE_LANES = 16
CANDIDATE_LANES = 64

# From so many matching postings on, scores that can't reach a pool are left out.
PRUNE_ROWS = 20_000_000
# They are if at most this share of the matching postings is of terms that must be scored.
PRUNE_SHARE = 0.25
# One document in so many is scored beforehand where all are: the end of the pool among them tells
# which scores of the others need no sorting.
FLOOR_SHARE = 16
# The terms that give the first bound have at least so many documents for each place of the pool.
LEAD = 4
# By how much sums of doubles in another order may differ, and ranks be told apart.
SLACK = 1e-6


@dataclass(frozen=True)
class BatchSize:
    """Measured size of a batch of queries; decides what may be broadcast."""

    queries: int
    text_bytes: int
    max_k: int
    pool_rows: int
    pool_words: int
    pool_bytes: int
    classes: tuple[int, ...]

    @property
    def max_pool(self) -> int:
        return max(scoring.MIN_POOL, self.max_k)

    @property
    def broadcast_queries(self) -> bool:
        return self.text_bytes <= BROADCAST_QUERY_BYTES and self.queries <= BROADCAST_ROWS

    @property
    def query_parts(self) -> int:
        """Number of broadcasts that the queries make up; 0 if they are too many."""
        return part_count(
            (self.text_bytes, BROADCAST_QUERY_BYTES),
            (self.queries, BROADCAST_ROWS),
            most=MAX_QUERY_PARTS,
        )

    @property
    def broadcast_pool(self) -> bool:
        """Whether the pools are few rows, also with the ids and the queries."""
        return self.pool_rows <= BROADCAST_ROWS and self.pool_bytes <= BROADCAST_POOL_BYTES

    @property
    def broadcast_pool_words(self) -> bool:
        """Whether the words of every query, once per document of its pool, are few."""
        return self.pool_words <= BROADCAST_WORDS and self.pool_bytes <= BROADCAST_POOL_BYTES


def measure(queries: DataFrame, index: SearchIndex | None = None) -> BatchSize:
    """One pass over the queries that brings their totals to the driver."""
    pool = scoring.pool_size(F.col("k")).cast("bigint")
    known = index.id_bytes if index is not None else None
    id_bytes = ID_BYTES if known is None else known
    octets = F.octet_length("query")
    row = queries.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum(octets), F.lit(0)).alias("text_bytes"),
        F.coalesce(F.max("k"), F.lit(0)).alias("max_k"),
        F.coalesce(F.sum(pool), F.lit(0)).alias("pool_rows"),
        F.coalesce(F.sum(pool * F.size(whitespace_tokens(F.col("query")))), F.lit(0)).alias(
            "pool_words"
        ),
        F.coalesce(F.sum(pool * (octets + id_bytes + 32)), F.lit(0)).alias("pool_bytes"),
        F.collect_set(pool_class()).alias("classes"),
    ).first()
    return BatchSize(*row[:-1], tuple(sorted(row[-1])))


def pool_class() -> Column:
    """Queries whose pools are alike in size, within a factor of four."""
    return F.ceil(F.log2(scoring.pool_size(F.col("k")).cast("double")) / 2).cast("int")


def part_count(*sizes: tuple[int, int], most: int | None = None) -> int:
    """How many parts keep each `(size, limit)`; 0 if over `most`, or without limit to keep."""
    if any(limit <= 0 for _, limit in sizes):
        return 0
    parts = max(1, *(-(-size // limit) for size, limit in sizes))
    return parts if parts <= (most or MAX_PARTS) else 0


def small(side: DataFrame, broadcast: bool) -> DataFrame:
    return F.broadcast(side) if broadcast else side


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf): the terms of each query and how often it repeats them."""
    counts = value_counts(tokens(F.col("query")), "term", "qtf")
    keep = [name for name in ("qid", "_number") if name in queries.columns]
    return queries.select(*keep, F.inline_outer(counts)).filter(F.col("term").isNotNull())


def candidates(index: SearchIndex, queries: DataFrame, size: BatchSize | None = None) -> DataFrame:
    """(qid, id) of every document with at least one term of the query."""
    size = size or measure(queries)
    terms = _weighed(index, queries, size)
    if not size.broadcast_queries:
        return _matches(index, terms, size).select("qid", "id").distinct()
    row, lane = _place(CANDIDATE_LANES)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), lane)
    asked = terms.repartition(1).groupBy("term", row.alias("_row")).agg(F.bit_or(bit).alias("_asked"))
    found = index.postings.select("id", "term").join(F.broadcast(asked), "term")
    found = found.groupBy("id", "_row").agg(F.bit_or("_asked").alias("_asked"))
    lanes = F.explode(F.array(*[F.lit(lane) for lane in range(CANDIDATE_LANES)])).alias("_lane")
    found = found.select("id", "_row", "_asked", lanes).filter(F.getbit("_asked", "_lane") == 1)
    return _named(found, queries, CANDIDATE_LANES).select("qid", "id")


def bm25_scores(
    index: SearchIndex,
    queries: DataFrame,
    size: BatchSize | None = None,
    k1: float = scoring.K1,
    b: float = scoring.B,
) -> DataFrame:
    """(qid, id, score) of every candidate.

    Idf and the corpus averages are worked out once per query term; the postings
    only add their own arithmetic. A term that a query repeats counts each time.
    """
    size = size or measure(queries)
    return _scored(index, _weighed(index, queries, size), queries, size, k1, b)


def _weighed(index: SearchIndex, queries: DataFrame, size: BatchSize) -> DataFrame:
    """(qid, term, qtf, df, top_tf, low_dl, idf, avgdl) of the query terms that the index has, and
    for a broadcast batch the `_number` of the query."""
    n = index.corpus_stats.select("n").scalar()
    avgdl = index.corpus_stats.select("avgdl").scalar()
    asked = query_terms(_numbered(queries) if size.broadcast_queries else queries)
    few = asked.select("term").distinct() if len(index.parts) > 1 and size.broadcast_queries else None
    return (
        small(asked, size.broadcast_queries)
        .join(index.frequencies(few), "term")
        .withColumn("idf", scoring.idf(n, F.col("df")))
        .withColumn("avgdl", avgdl)
    )


def _scored(
    index: SearchIndex,
    terms: DataFrame,
    queries: DataFrame,
    size: BatchSize,
    k1: float,
    b: float,
    floors: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, score): what the given terms of each query add up to in each document; with
    `floors` (qid, bound) of a broadcast batch, scores below the bound of their query are left out.

    What a posting adds is its own part, which is worked out once, times the weight of its term
    in each query. A broadcast batch is dealt to rows of SCORE_LANES queries, so a posting meets
    a row of weights, null for queries without the term, and not every query that has the term.
    """
    if not size.broadcast_queries:
        score = F.col("qtf") * F.col("idf") * _own(k1, b)
        return _matches(index, terms, size).groupBy("qid", "id").agg(F.sum(score).alias("score"))
    lanes = range(max(1, min(SCORE_LANES, size.queries)))
    row, place = _place(len(lanes))
    weight = F.col("qtf") * F.col("idf")
    # In one task: the terms are few enough to be broadcast.
    weights = terms.repartition(1).groupBy("term", row.alias("_row")).agg(
        F.first("avgdl").alias("avgdl"),
        *[F.sum(F.when(place == lane, weight)).alias(f"_weight{lane}") for lane in lanes],
    )
    postings = index.postings.select("id", "term", "tf", "dl")
    found = postings.join(F.broadcast(weights), "term").withColumn("_own", _own(k1, b))
    found = found.groupBy("id", "_row").agg(
        *[F.sum(F.col(f"_weight{lane}") * F.col("_own")).alias(f"_score{lane}") for lane in lanes]
    )
    if floors is not None:
        numbered = _numbered(queries).select("qid", row.alias("_row"), place.alias("_place")).distinct()
        floors = numbered.join(F.broadcast(floors), "qid").groupBy("_row").agg(
            *[F.max(F.when(F.col("_place") == lane, F.col("bound"))).alias(f"_floor{lane}") for lane in lanes]
        )
        reached = [
            F.when(F.col(f"_score{lane}") >= F.col(f"_floor{lane}") - SLACK, F.col(f"_score{lane}"))
            for lane in lanes
        ]
        found = found.join(F.broadcast(floors), "_row").select(
            "id", "_row", *[score.alias(f"_score{lane}") for lane, score in enumerate(reached)]
        )
        found = found.filter(F.coalesce(*[f"_score{lane}" for lane in lanes]).isNotNull())
    scores = F.posexplode(F.array(*[f"_score{lane}" for lane in lanes])).alias("_lane", "score")
    found = found.select("id", "_row", scores).filter(F.col("score").isNotNull())
    return _named(found, queries, len(lanes)).select("qid", "id", "score")


def _own(k1: float, b: float) -> Column:
    """What a posting has of its score without the weight of its term in the query."""
    return scoring.term_score(F.lit(1.0), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)


def _numbered(queries: DataFrame) -> DataFrame:
    """Add the `_number` of a query from 0; a qid that comes again has the same. One task numbers
    them, of a batch that is small enough for a broadcast."""
    return queries.withColumn("_number", F.dense_rank().over(Window.orderBy("qid")) - 1)


def _place(lanes: int) -> tuple[Column, Column]:
    """The row and the lane of a query by its number."""
    return F.floor(F.col("_number") / lanes).cast("int"), (F.col("_number") % lanes).cast("int")


def _named(found: DataFrame, queries: DataFrame, lanes: int) -> DataFrame:
    """Rows of a `_row` and `_lane` with the qid of the query that these stand for."""
    row, lane = _place(lanes)
    names = _numbered(queries).select(row.alias("_row"), lane.alias("_lane"), "qid").distinct()
    return found.join(F.broadcast(names), ["_row", "_lane"])


@dataclass(frozen=True)
class Pruned:
    """`scores` (qid, id, score), exact, of all documents that can be in a pool; `scored` are the
    pairs of a query and a document that were scored for it; None if all were."""

    scores: DataFrame
    scored: DataFrame | None = None


def pruned_scores(
    index: SearchIndex,
    queries: DataFrame,
    size: BatchSize | None = None,
    k1: float = scoring.K1,
    b: float = scoring.B,
    prune_rows: int | None = None,
) -> Pruned:
    """Scores of the documents that can be among the best max(20, k) of their query.

    The rarest terms of a query are scored first; the score at the end of the pool among
    their documents is a bound that pool members reach. Terms in the order of the most they
    can add (by the highest tf and the lowest dl of any posting) then fall in two: once all
    from some term on together stay below the bound, a document that has only those can be
    left out. So only documents of the terms before are scored; those that can still
    reach the bound, raised by their own scores, look up the frequent terms by (id, term).

    Batches with fewer matching postings than `prune_rows` are scored whole; without that, also
    those of which it would leave out too little to be worth the tables that it writes.
    """
    size = size or measure(queries, index)
    if not (k1 >= 0 and 0 <= b <= 1):
        return Pruned(bm25_scores(index, queries, size, k1, b))
    terms = _weighed(index, queries, size)
    pools = queries.select("qid", scoring.pool_size(F.col("k")).alias("pool"))
    terms = _settle(index, _with_bounds(terms, k1, b).join(small(pools, size.broadcast_queries), "qid"))
    matching = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    if matching < (PRUNE_ROWS if prune_rows is None else prune_rows):
        return Pruned(_scored(index, terms, queries, size, k1, b))

    rare = Window.partitionBy("qid").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("df").over(rare), F.lit(0))
    leading = terms.withColumn("_before", before).filter(F.col("_before") < LEAD * F.col("pool"))
    first = _scored(index, leading, queries, size, k1, b)
    below = terms.groupBy("qid").agg(F.first("pool").alias("pool"), F.sum("least").alias("least"))
    bounds = _settle(index, _pool_ends(index, first, below, size))

    most = Window.partitionBy("qid").orderBy(F.desc("most"), "term")
    rest = F.sum("most").over(most.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    parted = terms.join(small(bounds.select("qid", "bound"), size.broadcast_queries), "qid")
    parted = parted.withColumn("_needed", rest >= F.col("bound") - SLACK)
    needed = _settle(index, parted.filter("_needed").select(*_carried(parted)))
    if prune_rows is None:
        share = needed.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] / max(matching, 1)
        if share > PRUNE_SHARE:
            floors = _floors(index, terms, bounds, queries, size, k1, b) if size.broadcast_queries else None
            return Pruned(_scored(index, terms, queries, size, k1, b, floors))
    others = _settle(index, parted.filter("not _needed").select(*TERM_COLUMNS, "most"))
    more = others.groupBy("qid").agg(F.sum("most").alias("more"))
    bounds = _settle(
        index, bounds.join(more, "qid", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    )

    scored = _scored(index, needed, queries, size, k1, b)
    known = small(bounds.select("qid", "bound", "more"), size.broadcast_queries)
    near = scored.join(known, "qid").filter(F.col("score") + F.col("more") >= F.col("bound") - SLACK)
    near = _settle(index, near.select("qid", "id", "score", "more"))
    raised = _pool_ends(index, near.select("qid", "id", "score"), bounds.select("qid", "pool", "least"), size)
    raised = small(raised.select("qid", "bound"), size.broadcast_queries)
    left = near.join(raised, "qid").filter(F.col("score") + F.col("more") >= F.col("bound") - SLACK)
    left = _settle(index, left.select("qid", "id", "score"))
    return Pruned(_looked_up(index, left, others, size, k1, b), scored.select("qid", "id"))


def _floors(
    index: SearchIndex,
    terms: DataFrame,
    bounds: DataFrame,
    queries: DataFrame,
    size: BatchSize,
    k1: float,
    b: float,
) -> DataFrame:
    """(qid, bound) that every member of a pool reaches: `bounds`, raised to the score at the end of
    the pool among one document in FLOOR_SHARE, which are scored whole. About FLOOR_SHARE times
    the pool reach it; other scores need not be sorted for it."""
    some = F.pmod(F.xxhash64("id"), F.lit(FLOOR_SHARE)) == 0
    part = replace(index, postings=index.postings.filter(some))
    whole = bounds.select("qid", "pool", F.lit(0.0).alias("least"))
    ends = _pool_ends(index, _scored(part, terms, queries, size, k1, b), whole, size)
    ends = F.broadcast(ends.select("qid", F.col("bound").alias("_raised")))
    raised = bounds.join(ends, "qid").select("qid", F.greatest("bound", "_raised").alias("bound"))
    return _settle(index, raised)


TERM_COLUMNS = ("qid", "term", "qtf", "df", "idf", "avgdl")


def _carried(terms: DataFrame) -> list[str]:
    return [name for name in (*TERM_COLUMNS, "_number") if name in terms.columns]


def _with_bounds(terms: DataFrame, k1: float, b: float) -> DataFrame:
    """Add the `most` and the `least` that a term can add to the score of a document."""
    ceiling = F.col("idf") * (k1 + 1.0)
    told = scoring.term_score(F.col("idf"), F.col("top_tf"), F.col("low_dl"), F.col("avgdl"), k1, b)
    most = F.least(ceiling, told)  # nulls are skipped
    return terms.select(
        *_carried(terms),
        (F.col("qtf") * F.greatest(most, F.lit(0.0))).alias("most"),
        (F.col("qtf") * F.least(ceiling, F.lit(0.0))).alias("least"),
    )


def _pool_ends(
    index: SearchIndex, scored: DataFrame, pools: DataFrame, size: BatchSize
) -> DataFrame:
    """`pools` (qid, pool, least) with the bound that the last score of each pool gives; without
    a full pool there is none, and all documents are above it."""
    best = top_per_key(
        scored, "qid", score_order(), size.max_pool, "_place", feeding_tasks(index, size)
    )
    pools = small(pools, size.broadcast_queries)
    last = best.join(pools.select("qid", "pool"), "qid").filter(F.col("_place") == F.col("pool"))
    ends = last.select("qid", F.col("score").alias("_end"))
    bound = F.coalesce(F.col("_end") + F.col("least"), F.lit(float("-inf")))
    return pools.join(small(ends, size.broadcast_queries), "qid", "left").select(
        "qid", "pool", "least", bound.alias("bound")
    )


def _looked_up(
    index: SearchIndex, left: DataFrame, others: DataFrame, size: BatchSize, k1: float, b: float
) -> DataFrame:
    """Add to scores what the other terms of the query give the same documents."""
    asked = left.select("qid", "id").join(
        small(others.select(*TERM_COLUMNS), size.broadcast_queries), "qid"
    )
    asked = _settle(index, asked)
    octets = F.coalesce(F.sum(F.octet_length("id") + F.octet_length("term") + 64), F.lit(0))
    rows, total = asked.agg(F.count(F.lit(1)), octets).first()
    if not rows:
        return left
    parts = part_count((rows, 5 * BROADCAST_ROWS), (total, BROADCAST_POOL_BYTES))
    if parts:
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        found = functools.reduce(
            DataFrame.unionByName,
            [
                index.postings.join(F.broadcast(asked.filter(part == number)), ["id", "term"])
                for number in range(parts)
            ],
        )
    else:
        found = index.postings.join(asked, ["id", "term"])
    score = F.col("qtf") * F.col("idf") * _own(k1, b)
    found = found.select("qid", "id", score.alias("score")).unionByName(left)
    return found.groupBy("qid", "id").agg(F.sum("score").alias("score"))


def _settle(index: SearchIndex, rows: DataFrame) -> DataFrame:
    path = shared_dir(index.spark, "pruning")
    rows.write.parquet(path)
    return index.spark.read.schema(rows.schema).parquet(path)


def _matches(index: SearchIndex, terms: DataFrame, size: BatchSize) -> DataFrame:
    """Postings of the query terms; `terms` has term and df."""
    if size.broadcast_queries:
        return index.postings.join(F.broadcast(terms), "term")
    terms = _settle(index, terms)
    if size.query_parts:
        # Several broadcasts: each part of the queries meets the postings where they lie.
        part = F.pmod(F.xxhash64("qid"), F.lit(size.query_parts))
        return functools.reduce(
            DataFrame.unionByName,
            [
                index.postings.join(F.broadcast(terms.filter(part == number)), "term")
                for number in range(size.query_parts)
            ],
        )
    # Too many queries for that: shuffle by term, the hot terms cut into slices
    # by document on one side and repeated for every slice on the other.
    slice_rows = F.greatest(
        index.corpus_stats.select("total_len").scalar() * F.lit(HOT_TERM_SHARE), F.lit(1.0)
    )
    slices = F.ceil(F.col("df") / slice_rows).cast("int")
    hot = (
        index.doc_freq.filter(F.col("df") > slice_rows)
        .select("term", slices.alias("_slices"))
    )
    postings, asked = index.postings, terms.select("term").distinct()
    if fits(asked, ["term"], BROADCAST_TERMS, BROADCAST_TERM_BYTES):
        postings = postings.join(F.broadcast(asked), "term", "left_semi")  # the rest stays where it is
    postings = (
        postings.join(F.broadcast(hot), "term", "left")
        .withColumn("_slice", F.pmod(F.xxhash64("id"), F.coalesce("_slices", F.lit(1))).cast("int"))
        .drop("_slices")
    )
    terms = terms.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return postings.join(terms, ["term", "_slice"]).drop("_slice")


def score_order(*first: Column) -> list[Column]:
    """Best score first, then by id. Scores are compared to 9 decimals, since sums of
    doubles differ in the last digits with the order in which Spark adds them."""
    return [*first, F.round("score", 9).desc(), F.col("id").asc()]


def rerank_pool(
    index: SearchIndex,
    queries: DataFrame,
    size: BatchSize | None = None,
    prune_rows: int | None = None,
    **bm25: float,
) -> DataFrame:
    """(qid, id, score, bm25_rank): the best max(20, k) candidates of each query.

    Queries are cut by the size of their pools, so that one of a large k does not make the
    others keep as many rows.
    """
    size = size or measure(queries, index)
    if len(size.classes) > 1:
        pools = []
        for number in size.classes:
            own = queries.filter(pool_class() == number)
            pools.append(rerank_pool(index, own, measure(own, index), prune_rows, **bm25))
        return functools.reduce(DataFrame.unionByName, pools)
    scored = pruned_scores(index, queries, size, prune_rows=prune_rows, **bm25).scores
    best = top_per_key(
        scored, "qid", score_order(), size.max_pool, "bm25_rank", feeding_tasks(index, size)
    )
    wanted = queries.select("qid", scoring.pool_size(F.col("k")).alias("_pool"))
    return (
        best.join(small(wanted, size.broadcast_queries), "qid")
        .filter(F.col("bm25_rank") <= F.col("_pool"))
        .drop("_pool")
    )


def feeding_tasks(index: SearchIndex, size: BatchSize) -> int:
    """Tasks that score documents: a task per shard where postings lie, else those of a shuffle."""
    if index.num_shards and size.query_parts:
        return index.num_shards
    return shuffle_partitions(index.spark)
