import random

import pytest
from pyspark.sql import functions as F

import pagelode as pl
from checks.queries import documents, overlap_reranker, reranker_beyond_pool
from pagelode.operators import ranking, rerank, retrieval
from pagelode.plans import search as plan
from pagelode.sources.pages import seed_pages
from tests.corpora import C_AGAIN, FIVE, ids, page_log, ranked, requests


@pytest.fixture(scope="module")
def seeds(spark, tmp_path_factory):
    return pl.write_index(seed_pages(spark), str(tmp_path_factory.mktemp("seeds")))


@pytest.fixture(scope="module")
def five(spark, tmp_path_factory):
    return pl.write_index(page_log(spark), str(tmp_path_factory.mktemp("five")))


def near(hits):
    return [(id, pytest.approx(score, abs=1e-9)) for id, score in hits]


SEED_RESULTS = {
    "example domain": [("1", 1.781403839427)],
    "domain domain": [("1", 2.035420353679)],
    "is": [("1", 0.200877708778), ("2", 0.166903760716)],
    "Go software": [("2", 1.530695797991)],
    "software": [("2", 0.634532049855)],
}
FIVE_RESULTS = {
    "spark sql": [("c", 1.402222259), ("a", 1.351982053), ("e", 0.798165557)],
    "streaming": [("b", 1.334298738), ("a", 0.845395384)],
    "Streaming,": [("a", 0.845395384), ("b", 1.334298738)],
    "spark spark sql": [("c", 2.103333388), ("a", 2.183482752), ("e", 1.287810494)],
}


def test_seed_results(spark, seeds):
    found = ranked(pl.search_many(seeds, requests(spark, *SEED_RESULTS, "zzz", "!!!", "")))
    assert found == {query: near(hits) for query, hits in SEED_RESULTS.items()}


@pytest.mark.parametrize("stored", [True, False])
def test_five_results(spark, five, stored):
    index = five if stored else pl.build_index(page_log(spark))
    found = ranked(pl.search_many(index, requests(spark, *FIVE_RESULTS)))
    assert found == {query: near(hits) for query, hits in FIVE_RESULTS.items()}


@pytest.mark.parametrize(("k", "kept"), [(-1, 0), (0, 0), (2, 2), (100, 3)])
def test_k(spark, five, k, kept):
    found = ids(pl.search_many(five, requests(spark, "spark sql", k=k)))
    assert found == ({"spark sql": ["c", "a", "e"][:kept]} if kept else {})


def test_k_differs_by_query(spark, five):
    queries = requests(spark, "spark sql", k=1).unionByName(requests(spark, "streaming", k=2))
    assert ids(pl.search_many(five, queries)) == {"spark sql": ["c"], "streaming": ["b", "a"]}


def test_without_a_reranker_scores_fall(spark, five):
    found = ranked(pl.search_many(five, requests(spark, *FIVE_RESULTS), None))
    assert [id for id, _ in found["spark spark sql"]] == ["a", "c", "e"]
    assert all(
        hits == sorted(hits, key=lambda hit: -hit[1]) for hits in found.values()
    )


@pytest.mark.parametrize("reranker", [None, pl.cosine_rerank, overlap_reranker])
def test_one_query_is_its_row_of_a_batch(spark, five, reranker):
    queries = requests(spark, "Streaming,", "spark spark sql")
    batch = ranked(pl.search_many(five, queries, reranker))
    for query, hits in batch.items():
        alone = pl.search(five, query, 10, reranker).orderBy("rank").collect()
        assert [(row.id, row.score) for row in alone] == near(hits)


def test_result_columns(spark, seeds):
    row = pl.search(seeds, "example domain", 5).first()
    assert row.asDict() == {
        "rank": 1,
        "id": "1",
        "url": "https://example.com",
        "title": "Example Domain",
        "body": "This domain is for use in illustrative examples in documents.",
        "score": pytest.approx(1.781403839427, abs=1e-12),
    }


@pytest.mark.parametrize("reranker", [None, pl.cosine_rerank, overlap_reranker])
def test_long_bodies_are_ranked_whole_and_shown_cut(spark, reranker):
    long = "é" * 400 + " needle"
    index = pl.build_index(page_log(spark, [("x", "", "", long, 1)]))
    row = pl.search(index, "needle", 1, reranker).first()
    assert row.body == "é" * 256


def test_stale_candidates_in_cumulative_mode(spark):
    log = page_log(spark, [*FIVE, C_AGAIN])
    found = ranked(pl.search_many(pl.build_index(log, "cumulative"), requests(spark, "spark sql")))
    assert found["spark sql"] == near([("a", 1.385991002), ("e", 0.836884487), ("c", 0.0)])
    found = ranked(pl.search_many(pl.build_index(log), requests(spark, "spark sql")))
    assert found["spark sql"] == near([("a", 2.195966058), ("e", 1.296425843)])


def test_a_page_sent_twice_lowers_its_score_in_cumulative_mode(spark):
    twice = seed_pages(spark).unionByName(seed_pages(spark).filter("id = '1'"))
    row = pl.search(pl.build_index(twice, "cumulative"), "example domain", 5).first()
    assert row.score == pytest.approx(0.508817465895, abs=1e-12)


def test_cosines(spark):
    pages = seed_pages(spark).withColumn("bm25_rank", F.col("id").cast("int"))
    queries = requests(spark, "example domain", "domain domain", "is", "Go software", "software")
    rows = rerank.with_cosine(queries.crossJoin(pages)).collect()
    found = {(row.qid, row.id): pytest.approx(row.cosine, abs=1e-11) for row in rows}
    assert found == {
        ("example domain", "1"): 0.530330085890,
        ("example domain", "2"): 0,
        ("domain domain", "1"): 0.5,
        ("domain domain", "2"): 0,
        ("is", "1"): 0.25,
        ("is", "2"): 0.218217890236,
        ("Go software", "1"): 0,
        ("Go software", "2"): 0.308606699924,
        ("software", "1"): 0,
        ("software", "2"): 0,
    }


def test_rerank_alone_keeps_the_order_of_equals(spark):
    rows = [("q", "x y", str(i), "", "z", i) for i in (3, 1, 2)] + [("q", "x y", "9", "X", "", 4)]
    candidates = spark.createDataFrame(
        rows, "qid string, query string, id string, title string, body string, bm25_rank int"
    )
    order = pl.cosine_rerank(candidates).orderBy("pos").collect()
    assert [(row.id, row.pos) for row in order] == [("9", 0), ("1", 1), ("2", 2), ("3", 3)]


def test_custom_reranker_with_an_empty_order_falls_back(spark, five):
    found = pl.search_many(
        five,
        requests(spark, "spark sql", "streaming"),
        lambda c: c.filter("qid = 'streaming'").selectExpr("qid", "id", "-bm25_rank + 2 AS pos"),
    )
    assert ids(found) == {"spark sql": ["c", "a", "e"], "streaming": ["a", "b"]}


def order_rows(spark, *rows):
    return spark.createDataFrame([("spark sql", *row) for row in rows], "qid string, id string, pos int")


@pytest.mark.parametrize(
    ("order", "wanted"),
    [
        ([("e", 0)], ["e", "c", "a"]),
        ([("a", 0), ("e", 1), ("a", 2)], ["e", "a", "c"]),
        ([("nowhere", 0), ("a", 1)], ["a", "c", "e"]),
        ([("b", 0), ("e", 1)], ["e", "c", "a"]),
    ],
    ids=["partial", "repeated", "unknown", "not matching"],
)
def test_external_order(spark, five, order, wanted):
    found = pl.search_with_order(five, requests(spark, "spark sql"), order_rows(spark, *order))
    assert ids(found) == {"spark sql": wanted}


def test_external_order_reaches_beyond_the_pool(spark):
    rows = [(f"d{i:02}", "", "", "needle " + "hay " * i, 1) for i in range(40)]
    index = pl.build_index(page_log(spark, rows))
    order = spark.createDataFrame([("needle", "d39", 0)], "qid string, id string, pos int")
    found = ids(pl.search_with_order(index, requests(spark, "needle", k=3), order))
    assert found == {"needle": ["d39", "d00", "d01"]}


@pytest.mark.parametrize("most", [200_000, 0])
def test_a_reranker_may_name_every_match(spark, tmp_path, monkeypatch, most):
    """Also an order too large for a broadcast, which meets the scores of all documents once."""
    monkeypatch.setattr(plan, "BROADCAST_ROWS", most)
    texts = ["hay", *("needle " + "hay " * (40 - i) for i in range(40))]
    spark.createDataFrame(
        [(i, f"s{i}", text) for i, text in enumerate(texts)], "doc_id long, source string, text string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "needle"), (6, "none")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    found = reranker_beyond_pool(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(row["qid"], row["rank"], row["id"]) for row in found] == [("5", i, str(i)) for i in range(1, 11)]
    index = pl.build_index(documents(spark, str(tmp_path)))
    scores = retrieval.bm25_scores(index, requests(spark, "needle")).select("id", "score")
    scores = dict(scores.collect())
    assert [row["score"] for row in found] == [pytest.approx(scores[row["id"]], abs=1e-6) for row in found]


@pytest.mark.parametrize("reranker", [None, pl.cosine_rerank, overlap_reranker])
def test_large_batches_give_the_same_without_broadcasts(spark, five, monkeypatch, reranker):
    queries = requests(spark, *FIVE_RESULTS)
    wanted = ranked(pl.search_many(five, queries, reranker))
    for name in ("BROADCAST_QUERY_BYTES", "BROADCAST_ROWS", "BROADCAST_WORDS"):
        monkeypatch.setattr(retrieval, name, -1)
    # Makes every term hot, so that each is cut into slices.
    monkeypatch.setattr(retrieval, "HOT_TERM_SHARE", 1 / 23)
    monkeypatch.setattr(ranking, "ROWS_PER_KEY", 2)
    assert {q: near(hits) for q, hits in wanted.items()} == ranked(
        pl.search_many(five, queries, reranker)
    )


def test_results_do_not_depend_on_the_order_of_pages(spark):
    wanted = ranked(pl.search_many(pl.build_index(page_log(spark)), requests(spark, *FIVE_RESULTS)))
    mixed = page_log(spark, FIVE[::-1]).repartition(3)
    found = ranked(pl.search_many(pl.build_index(mixed), requests(spark, *FIVE_RESULTS)))
    assert found == {query: near(hits) for query, hits in wanted.items()}


def test_candidates_have_a_term_of_the_query(spark, five):
    found = retrieval.candidates(five, requests(spark, "spark engine", "nothing here"))
    assert sorted(map(tuple, found.collect())) == [("spark engine", id) for id in "abce"]


def pruning_corpus(count=600):
    """Documents with a few frequent words and many rare ones, in lengths of their own."""
    pick = random.Random(8)
    frequent = ["the", "of", "and", "to"]
    rows = []
    for i in range(count):
        words = [pick.choice(frequent) for _ in range(pick.randrange(1, 30))]
        words += [f"rare{pick.randrange(60)}" for _ in range(pick.randrange(0, 4))]
        pick.shuffle(words)
        rows.append((f"d{i:04}", "", "", " ".join(words), i))
    return rows


PRUNED_QUERIES = [
    "the of rare3 rare7", "rare5 the the and to of", "the", "the of and to", "rare1 rare2 rare3 nowhere",
    "nowhere", "", "rare9 rare9 of",
]


@pytest.mark.parametrize("segments", [1, 3])
@pytest.mark.parametrize("mode", ["latest", "cumulative"])
@pytest.mark.parametrize(("k", "k1", "b"), [(3, 1.2, 0.75), (30, 2.0, 0.3), (900, 1.2, 0.75)])
def test_pruned_pools_equal_whole_scores(spark, tmp_path, segments, mode, k, k1, b):
    rows = pruning_corpus(200)
    for part in range(segments):
        index = pl.extend_index(page_log(spark, rows[part::segments]), str(tmp_path), mode)
    queries = requests(spark, *PRUNED_QUERIES, k=k)
    whole = retrieval.rerank_pool(index, queries, prune_rows=10**18, k1=k1, b=b)
    pruned = retrieval.rerank_pool(index, queries, prune_rows=0, k1=k1, b=b)
    rounded = [
        sorted((r.qid, r.id, r.bm25_rank, round(r.score, 9)) for r in pool.collect())
        for pool in (whole, pruned)
    ]
    assert rounded[0] == rounded[1] and rounded[0]


@pytest.mark.parametrize("k", [1, 900])
def test_few_scores_are_sorted_where_all_are_scored(spark, tmp_path, monkeypatch, k):
    """What can't reach the end of a pool is left out before it is ranked, and nothing else is."""
    index = pl.write_index(page_log(spark, pruning_corpus(1500)), str(tmp_path))
    queries = requests(spark, *PRUNED_QUERIES, *[f"of and rare{n}" for n in range(20)], k=k)
    whole = retrieval.rerank_pool(index, queries, prune_rows=10**18)
    monkeypatch.setattr(retrieval, "PRUNE_ROWS", 0)
    monkeypatch.setattr(retrieval, "PRUNE_SHARE", 0.0)
    pools = [
        sorted((r.qid, r.id, r.bm25_rank, round(r.score, 9)) for r in pool.collect())
        for pool in (whole, retrieval.rerank_pool(index, queries))
    ]
    assert pools[0] == pools[1] and pools[0]
    ranked = retrieval.pruned_scores(index, queries).scores.count()
    scored = retrieval.candidates(index, queries).count()
    assert len(pools[0]) <= ranked <= scored and (k > 1 or ranked < scored / 2)


def test_pruning_scores_few_candidates(spark, tmp_path):
    index = pl.write_index(page_log(spark, pruning_corpus()), str(tmp_path))
    queries = requests(spark, "the of rare3 rare7 rare11", "rare5 rare6 the and to of", k=5)
    scored = retrieval.pruned_scores(index, queries, prune_rows=0).scored.count()
    assert 40 <= scored < retrieval.candidates(index, queries).count() / 4


def test_negative_idf_is_not_pruned_wrongly(spark, tmp_path):
    """In mode cumulative a term may be in more versions than there are pages."""
    rows = [(f"d{i % 30:02}", "", "", f"same word{i % 7} {'same ' * (i % 5)}", i) for i in range(120)]
    index = pl.write_index(page_log(spark, rows), str(tmp_path), "cumulative")
    queries = requests(spark, "same word3", "word1 same word2", "same", k=3)
    pools = [
        sorted((r.qid, r.id, r.bm25_rank) for r in retrieval.rerank_pool(index, queries, prune_rows=n).collect())
        for n in (0, 10**18)
    ]
    assert pools[0] == pools[1] and len(pools[0]) == 60


def test_pools_of_different_sizes_are_cut_apart(spark, tmp_path):
    index = pl.write_index(page_log(spark, pruning_corpus(300)), str(tmp_path))
    rows = [("a", "the rare3", 5), ("b", "the rare3", 250), ("c", "of rare4", 21)]
    queries = spark.createDataFrame(rows, "qid string, query string, k int")
    size = retrieval.measure(queries, index)
    assert len(size.classes) == 2
    pool = retrieval.rerank_pool(index, queries, size).groupBy("qid").count().collect()
    counts = dict(map(tuple, pool))
    assert counts["a"] == 20 and counts["c"] == 21 and counts["b"] > 200


def test_ranks_in_ranges_equal_one_window(spark, monkeypatch):
    rows = [(f"q{i % 3}", f"d{i:05}", float(i * 37 % 101)) for i in range(3000)]
    table = spark.createDataFrame(rows, "qid string, id string, score double").repartition(5)
    order = retrieval.score_order()
    wanted = sorted(ranking.top_per_key(table, "qid", order, 700, "rank").collect())
    monkeypatch.setattr(ranking, "ROWS_PER_KEY", 100)
    found = ranking.top_per_key(table, "qid", order, 700, "rank", feeding_tasks=5)
    assert sorted(found.collect()) == wanted and len(wanted) == 2100
    biggest = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in biggest and "_range" in biggest
