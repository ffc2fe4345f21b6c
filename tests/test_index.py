import pytest
from pyspark.sql import functions as F

import pagelode as pl
from pagelode.operators import index as ix
from pagelode.operators import store
from pagelode.sources.pages import seed_pages
from tests.corpora import C_AGAIN, FIVE, page_log


def stats(index):
    return tuple(index.corpus_stats.select("n", "total_len", "avgdl").first())


def df(index):
    return {row.term: row.df for row in index.doc_freq.collect()}


def built(spark, path, rows, mode, stored):
    pages = page_log(spark, rows)
    if stored:
        return pl.write_index(pages, str(path), mode)
    return pl.build_index(pages, mode)


either = pytest.mark.parametrize("stored", [False, True], ids=["derived", "stored"])


@either
def test_five_documents(spark, tmp_path, stored):
    index = built(spark, tmp_path, FIVE, "latest", stored)
    assert stats(index) == (5, 23, 4.6)
    lengths = {row.id: row.dl for row in index.documents.collect()}
    assert lengths == {"a": 5, "b": 3, "c": 2, "d": 0, "e": 13}
    found = df(index)
    assert {t: n for t, n in found.items() if n > 1} == {"spark": 3, "sql": 3, "streaming": 2}
    a = {(r.term, r.tf, r.dl) for r in index.postings.filter("id = 'a'").collect()}
    assert a == {("spark", 3, 5), ("streaming", 1, 5), ("sql", 1, 5)}


@either
@pytest.mark.parametrize(
    ("mode", "wanted", "spark_df", "sql_df"),
    [("latest", (5, 23, 4.6), 2, 2), ("cumulative", (5, 25, 5.0), 3, 3)],
)
def test_adding_an_id_again(spark, tmp_path, stored, mode, wanted, spark_df, sql_df):
    index = built(spark, tmp_path, [*FIVE, C_AGAIN], mode, stored)
    assert stats(index) == wanted
    found = df(index)
    assert (found["spark"], found["sql"], found["graph"]) == (spark_df, sql_df, 1)
    c = {(r.term, r.tf, r.dl) for r in index.postings.filter("id = 'c'").collect()}
    stale = {("sql", 0, 2), ("spark", 0, 2)} if mode == "cumulative" else set()
    assert c == {("graph", 1, 2), ("pregel", 1, 2)} | stale
    assert index.documents.filter("id = 'c'").first().title == "Graph"


def test_the_same_page_twice_counts_twice_in_cumulative_mode(spark):
    twice = seed_pages(spark).unionByName(seed_pages(spark).filter("id = '1'"))
    assert stats(pl.build_index(twice, "cumulative")) == (2, 43, 21.5)
    assert stats(pl.build_index(twice)) == (2, 31, 15.5)


@pytest.mark.parametrize("mode", ix.MODES)
def test_modes_agree_on_unique_ids(spark, mode):
    one, two = pl.build_index(page_log(spark), mode), pl.build_index(page_log(spark), unique_ids=True)
    assert stats(one) == stats(two)
    assert sorted(one.postings.collect()) == sorted(two.postings.collect())


@either
def test_empty_corpus(spark, tmp_path, stored):
    index = built(spark, tmp_path, [], "latest", stored)
    assert stats(index) == (0, 0, 1.0)
    assert df(index) == {}


def test_versions_do_not_depend_on_arrival(spark):
    rows = [("x", "", "", f"word{i} same", 1) for i in range(30)]
    forth = pl.build_index(page_log(spark, rows)).documents.first().body
    back = pl.build_index(page_log(spark, rows[::-1]).repartition(3)).documents.first().body
    assert forth == back


def test_versions_of_an_index(spark, tmp_path):
    path = str(tmp_path)
    first = pl.write_index(page_log(spark), path)
    second = pl.write_index(page_log(spark, [*FIVE, C_AGAIN]), path, "cumulative")
    assert (first.version, second.version) == (1, 2)
    assert pl.open_index(spark, path).version == 2
    assert stats(pl.open_index(spark, path, 1)) == (5, 23, 4.6)
    with pytest.raises(ValueError, match="no index version"):
        pl.open_index(spark, path, 7)


def test_a_failed_build_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path)
    pl.write_index(page_log(spark), path)
    broken = page_log(spark).withColumn("body", F.raise_error(F.lit("no body")).cast("string"))
    with pytest.raises(Exception, match="no body"):
        pl.write_index(broken, path)
    assert pl.open_index(spark, path).version == 1


def test_opening_without_the_writing_session(spark, tmp_path):
    path = str(tmp_path)
    index = pl.write_index(page_log(spark), path)
    folder = next(tmp_path.glob("version=1-*"))
    spark.sql(f"DROP TABLE IF EXISTS {store._table_name(f'{path}/{folder.name}/postings')}")
    reopened = pl.open_index(spark, path)
    assert sorted(reopened.postings.collect()) == sorted(
        pl.build_index(page_log(spark)).postings.collect()
    )
    assert index.num_shards == reopened.num_shards == 2


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_placement_by_shard(spark, tmp_path, shards):
    index = pl.write_index(page_log(spark), str(tmp_path), num_shards=shards)
    wrong = index.documents.filter(F.col("shard") != ix.shard_of("id", shards))
    assert wrong.count() == 0
    assert index.documents.count() == 5
    assert index.postings.groupBy("id", "term").count().filter("count > 1").count() == 0


def test_term_stats(spark):
    index = pl.build_index(seed_pages(spark))
    terms = spark.createDataFrame([("domain",), ("is",), ("nowhere",), ("is",)], "term string")
    found = {row.term: (row.df, round(row.idf, 12)) for row in pl.term_stats(index, terms).collect()}
    assert found == {
        "domain": (1, 0.69314718056),
        "is": (2, 0.182321556794),
        "nowhere": (1, 0.69314718056),
    }


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode"):
        pl.build_index(page_log(spark), "newest")


def test_postings_are_sorted_a_few_documents_at_a_time(spark, tmp_path, monkeypatch):
    """Each task sorts the postings of few documents by their term, whatever the session's settings."""
    monkeypatch.setattr(store, "POSTING_TASK_BYTES", 4 << 10)
    rows = [(f"d{n:04}", "", f"t{n % 7}", " ".join(f"w{n * i % 601}" for i in range(60)), n) for n in range(900)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    index = pl.write_index(page_log(spark, rows), str(tmp_path), num_shards=3)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    files = sorted(tmp_path.glob("version=*/postings/*.parquet"))
    assert len(files) >= 3 * 2  # a shard is several row groups and so several tasks
    for file in files:
        found = [(row.term, row.shard) for row in spark.read.parquet(str(file)).select(
            "term", ix.shard_of("id", 3).alias("shard")
        ).collect()]
        terms = [term for term, _ in found]
        assert terms == sorted(terms) and len({shard for _, shard in found}) == 1
    columns = ["id", "term", "tf", "dl", "adds", "added_tf"]
    derived = pl.build_index(page_log(spark, rows)).postings.select(columns)
    assert sorted(index.postings.select(columns).collect()) == sorted(derived.collect())


def test_many_ids_that_come_again_move_no_document(spark, tmp_path, monkeypatch):
    """Replaced ids beyond one broadcast meet the documents shard by shard, and give the same."""
    rows = [(f"d{n:03}", f"u{n}", "", f"word{n % 9} of page {n}", None) for n in range(60)]
    again = [(id, url, title, f"new {body}", None) for id, url, title, body, _ in rows[::2]]

    def extended(name):
        path = str(tmp_path / name)
        pl.extend_index(page_log(spark, rows), path, num_shards=8)
        return pl.extend_index(page_log(spark, again), path)

    def told(index):
        shown = sorted(index.documents.select("id", "url", "title", "body", "dl").collect())
        return shown, sorted(index.postings.collect()), df(index), stats(index)

    wanted = told(extended("one"))
    monkeypatch.setattr(store, "BROADCAST_IDS", 7)
    monkeypatch.setattr(store, "LITERAL_IDS", 3)
    index = extended("several")
    plan = index.documents._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert told(index) == wanted
