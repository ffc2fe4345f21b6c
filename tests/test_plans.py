"""The physical plans the design relies on."""

from dataclasses import replace

import pytest

import pagelode as pl
from pagelode.operators import retrieval
from pagelode.session import session_conf
from tests.corpora import C_AGAIN, FIVE, page_log, ranked, requests


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    pages = page_log(spark, FIVE)
    return pl.write_index(pages, str(tmp_path_factory.mktemp("plans")))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scoring_moves_no_posting(spark, index):
    text = plan(retrieval.bm25_scores(index, requests(spark, "spark sql")))
    assert "Exchange hashpartitioning" not in text
    assert "Bucketed: true" in text
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_a_posting_meets_a_row_of_queries_and_not_each(spark, index):
    """Sums are by document and row of queries, so there is one row for up to 16 queries, or 64."""
    queries = requests(spark, *[f"spark sql {number}" for number in range(40)], "spark sql 1 engine")
    queries = queries.unionByName(queries.limit(3))  # a query that comes again counts again
    for found in (retrieval.bm25_scores(index, queries), retrieval.candidates(index, queries)):
        assert "HashAggregate(keys=[id" in plan(found) and "HashAggregate(keys=[qid" not in plan(found)
    size = retrieval.measure(queries)
    many = replace(size, queries=10**9)
    assert size.broadcast_queries and not many.broadcast_queries
    assert sorted(retrieval.bm25_scores(index, queries, size).collect()) == sorted(
        retrieval.bm25_scores(index, queries, many).collect()
    )
    told = sorted(retrieval.candidates(index, queries, size).collect())
    assert told == sorted(retrieval.candidates(index, queries, many).collect()) and len(told) > 64


def test_scoring_moves_no_posting_of_an_extended_index(spark, tmp_path):
    path = str(tmp_path)
    pl.extend_index(page_log(spark), path)
    index = pl.extend_index(page_log(spark, [C_AGAIN]), path)
    text = plan(retrieval.bm25_scores(index, requests(spark, "spark sql")))
    assert "Union" in text
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert all("hashpartitioning(term" in line for line in exchanges)  # frequencies of asked terms
    assert "LeftSemi" in text


def test_pool_is_cut_before_the_shuffle(spark, index):
    text = plan(retrieval.rerank_pool(index, requests(spark, "spark sql")))
    assert text.count("Exchange hashpartitioning(qid") == 1
    assert "row_number(), 20, Partial" in text


def test_single_search_pushes_its_terms_down(spark, index):
    text = plan(retrieval.bm25_scores(index.for_terms(["spark", "sql"]), requests(spark, "spark sql")))
    assert "PushedFilters: [In(term, [spark,sql])" in text
    assert "ReadSchema: struct<id:string,term:string,tf:bigint,dl:bigint>" in text


def test_documents_are_pruned_by_shard(spark, index):
    from pagelode.plans.search import fetch, settle

    pool = settle(index, retrieval.rerank_pool(index, requests(spark, "engine")))
    text = plan(fetch(index, pool, True))
    assert "dynamicpruningexpression(shard" in text
    rows = fetch(index, pool, True)
    rows.collect()
    assert "Exchange hashpartitioning" not in plan(rows)


def test_default_search_stays_in_the_jvm(spark, index):
    text = plan(pl.search_many(index, requests(spark, "spark sql")))
    assert "Python" not in text and "Pandas" not in text


def test_building_moves_each_page_once(spark):
    index = pl.build_index(page_log(spark))
    assert plan(index.postings).count("Exchange") == 1
    assert plan(pl.build_index(page_log(spark), unique_ids=True).postings).count("Exchange") == 0


def test_pages_are_placed_before_their_terms_are_counted(spark, tmp_path, monkeypatch):
    from pagelode.operators import store

    told, write = [], store._write_documents
    monkeypatch.setattr(store, "_write_documents", lambda rows, *rest: told.append(rows) or write(rows, *rest))
    pl.write_index(page_log(spark), str(tmp_path / "a"))
    pl.write_index(page_log(spark, FIVE), str(tmp_path / "b"), num_shards=3, unique_ids=True)
    pl.extend_index(page_log(spark, [C_AGAIN]), str(tmp_path / "a"))
    assert len(told) == 3 and not any("terms" in rows.columns for rows in told)


def test_an_order_is_worked_out_once(spark, index, monkeypatch):
    from pagelode.plans import search

    told, fits = [], search.fits
    monkeypatch.setattr(search, "fits", lambda rows, *rest: told.append(plan(rows)) or fits(rows, *rest))
    queries = requests(spark, "spark sql")
    order = retrieval.candidates(index, queries).selectExpr("qid", "id", "1 AS pos")
    monkeypatch.setattr(search, "feeding_tasks", lambda *_: 2)
    pl.search_with_order(index, queries, order)
    assert len(told) == 1 and "Aggregate" not in told[0] and "Join" not in told[0]


def test_pools_are_not_pruned_where_that_leaves_out_little(spark, index, monkeypatch):
    monkeypatch.setattr(retrieval, "PRUNE_ROWS", 0)
    queries = requests(spark, "spark sql", "engine", "note")
    whole = retrieval.pruned_scores(index, queries)
    assert whole.scored is None
    assert retrieval.pruned_scores(index, queries, prune_rows=0).scored is not None


def test_large_batches_move_no_posting_and_no_document(spark, index, monkeypatch):
    from pagelode.plans import search

    queries = requests(spark, "spark sql", "engine", "streaming", "notes")
    monkeypatch.setattr(retrieval, "BROADCAST_QUERY_BYTES", 12)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 3)
    size = retrieval.measure(queries)
    assert not size.broadcast_queries and size.query_parts > 1 and not size.broadcast_pool
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(retrieval.bm25_scores(index, queries, size))
        assert "SortMergeJoin" not in text.split("Scan parquet")[0]
        assert text.count("BroadcastHashJoin [term") >= size.query_parts
        pool = search.settle(index, retrieval.rerank_pool(index, queries, size))
        told = search.pooled_documents(index, pool, False)
        assert "Exchange hashpartitioning" not in plan(told) and "BroadcastHashJoin" in plan(told)
        assert told.count() == pool.select("id").distinct().count()
        found = {name: ranked(pl.search_many(index, queries, name)) for name in (None, pl.cosine_rerank)}
    monkeypatch.undo()
    for name, rows in found.items():
        assert rows == ranked(pl.search_many(index, queries, name))


def test_candidates_of_a_large_pool_move_no_body(spark, index, monkeypatch):
    from pagelode.plans import search

    queries = requests(spark, "spark sql", "engine", "streaming", "notes")
    pool = search.settle(index, retrieval.rerank_pool(index, queries))
    usual = sorted(search.rerank_candidates(index, queries).collect())
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 3)
    size = retrieval.measure(queries, index)
    assert not size.broadcast_pool
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        rows = search._candidates(index, queries, pool, size)
        text = plan(rows)
        assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text
        assert text.count("BroadcastHashJoin [shard") >= 2
        assert sorted(rows.collect()) == usual


def files_read(frame):
    """Files that the scans of a plan have opened, by the folder of their table."""
    frame.collect()
    found, pending = {}, [frame._jdf.queryExecution().executedPlan().executedPlan()]
    while pending:
        leaves = pending.pop().collectLeaves()
        for leaf in map(leaves.apply, range(leaves.size())):
            if leaf.getClass().getSimpleName().endswith("QueryStageExec"):
                pending.append(leaf.plan())
            elif leaf.metrics().get("numFiles").isDefined():
                name = leaf.relation().location().rootPaths().apply(0).getName()
                found[name] = found.get(name, 0) + leaf.metrics().get("numFiles").get().value()
    return found


def test_a_single_query_opens_the_files_of_its_terms(spark, tmp_path):
    rows = [(f"p{i}", "", "", f"word{i} common words {i % 7}", i) for i in range(200)]
    opened = {}
    for shards in (4, 32):
        path = f"{tmp_path}/{shards}"
        pl.write_index(page_log(spark, rows), path, num_shards=shards, by_term=True)
        index = pl.open_index(spark, path)
        own = index.for_terms(["word3", "common"])
        scores = retrieval.bm25_scores(own, requests(spark, "word3 common"))
        usual = retrieval.bm25_scores(index, requests(spark, "word3 common"))
        assert sorted(scores.select("id").collect()) == sorted(usual.select("id").collect())
        opened[shards] = files_read(scores)["by_term"]
    assert 1 <= opened[4] <= 2 and 1 <= opened[32] <= 2


def test_a_derived_index_analyses_a_text_once(spark):
    from pagelode.operators.index import analysed_once

    index = pl.build_index(page_log(spark))
    once = analysed_once(index)
    for table in (once.documents, once.postings, once.doc_freq, once.corpus_stats):
        assert "regexp_extract_all" not in plan(table)
    assert sorted(once.postings.collect()) == sorted(index.postings.collect())
    assert sorted(once.doc_freq.collect()) == sorted(index.doc_freq.collect())
    assert once.corpus_stats.collect() == index.corpus_stats.collect()


def test_stored_vectors_save_splitting_texts(spark, tmp_path):
    from pagelode.plans import search

    pl.write_index(page_log(spark), str(tmp_path), vectors=True)
    index = pl.extend_index(page_log(spark, [C_AGAIN]), str(tmp_path))
    queries = requests(spark, "spark sql", "streaming", "pregel graph")
    pool = search.settle(index, retrieval.rerank_pool(index, queries))
    told = search.pooled_documents(index, pool, True)
    assert "vector" in told.columns and "split(" not in plan(told)
    whole = pl.build_index(page_log(spark, [*FIVE, C_AGAIN]))
    assert ranked(pl.search_many(index, queries)) == ranked(pl.search_many(whole, queries))


def test_batches_beyond_broadcasts_shuffle_asked_postings_only(spark, index, monkeypatch):
    queries = requests(spark, "spark sql", "engine", "streaming", "notes")
    usual = sorted((r.qid, r.id, round(r.score, 9)) for r in retrieval.bm25_scores(index, queries).collect())
    for name in ("BROADCAST_QUERY_BYTES", "BROADCAST_ROWS"):
        monkeypatch.setattr(retrieval, name, -1)
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        scores = retrieval.bm25_scores(index, queries)
        text = plan(scores)
        assert "LeftSemi" in text and "hashpartitioning(term" in text
        found = sorted((r.qid, r.id, round(r.score, 9)) for r in scores.collect())
    assert found == usual
