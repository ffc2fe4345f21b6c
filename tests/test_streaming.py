from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import pagelode as pl
from pagelode.operators import store
from pagelode.schemas import PAGE
from pagelode.streaming import indexing
from tests.corpora import C_AGAIN, FIVE, ids, page_log, requests


def send(spark, folder, rows, bad=()):
    good = pl.encode_messages(page_log(spark, rows), "seq")
    junk = spark.createDataFrame([(v, 0) for v in bad], "v string, seq long").select(
        F.lit(b"k").alias("key"), F.col("v").cast("binary").alias("value"), "seq"
    )
    good.unionByName(junk).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, **options):
    stream = pl.file_messages(spark, folder, extra="seq BIGINT", maxFilesPerTrigger="1")
    query = pl.index_stream(
        stream, path, f"{path}/checkpoint", order=["seq"], available_now=True, **options
    )
    query.awaitTermination()


def content(index):
    return sorted(map(tuple, index.postings.select("id", "term", "tf", "dl").collect()))


@pytest.mark.parametrize("mode", ["latest", "cumulative"])
def test_stream_equals_batch(spark, tmp_path, mode):
    folder, path = f"{tmp_path}/topic", f"{tmp_path}/index"
    send(spark, folder, [C_AGAIN])
    send(spark, folder, FIVE[:2], bad=["{bad"])
    send(spark, folder, FIVE[2:], bad=["[]", '{"id":3}'])
    run(spark, folder, path, mode=mode, refresh_every=None)
    index = pl.refresh_index(spark, path, mode)
    batch = pl.build_index(page_log(spark, [*FIVE, C_AGAIN]), mode)
    assert content(index) == content(batch)
    assert index.corpus_stats.collect() == batch.corpus_stats.collect()
    rejects = indexing.read_rejects(spark, path)
    assert sorted(bytes(row.value).decode() for row in rejects.collect()) == [
        "[]",
        '{"id":3}',
        "{bad",
    ]


def test_each_batch_becomes_visible_and_a_restart_goes_on(spark, tmp_path):
    folder, path = f"{tmp_path}/topic", f"{tmp_path}/index"
    send(spark, folder, FIVE[:2])
    run(spark, folder, path)
    first = pl.open_index(spark, path)
    assert (first.version, first.documents.count()) == (1, 2)
    send(spark, folder, FIVE[2:])
    run(spark, folder, path)
    second = pl.open_index(spark, path)
    assert (second.version, second.documents.count()) == (2, 5)
    # A reader keeps the version it opened.
    assert first.documents.count() == 2
    assert ids(pl.search_many(second, requests(spark, "spark sql")))["spark sql"] == ["c", "a", "e"]


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    messages = pl.encode_messages(page_log(spark), "seq")
    for _ in range(2):
        indexing.append_batch(messages, 0, path, ["seq"])
    assert indexing.read_log(spark, path).count() == 5
    pages = page_log(spark)
    first = pl.extend_index(pages, path)
    again = pl.extend_index(pages, path)
    assert content(first) == content(again)
    assert first.doc_freq.exceptAll(again.doc_freq).count() == 0
    assert first.corpus_stats.collect() == again.corpus_stats.collect()


def test_without_an_order_later_batches_win(spark, tmp_path):
    path = str(tmp_path)
    for batch, body in enumerate(["old", "new"]):
        page = page_log(spark, [("x", "", "", body, 0)])
        indexing.append_batch(pl.encode_messages(page), batch, path, [])
    assert pl.refresh_index(spark, path).documents.first().body == "new"


def test_nothing_to_refresh(spark, tmp_path):
    assert pl.refresh_index(spark, str(tmp_path)) is None
    assert indexing.read_rejects(spark, str(tmp_path)) is None


def test_only_rejects(spark, tmp_path):
    folder, path = f"{tmp_path}/topic", f"{tmp_path}/index"
    send(spark, folder, [], bad=["{bad", "5"])
    run(spark, folder, path)
    assert pl.open_index(spark, path).documents.count() == 0
    assert indexing.read_rejects(spark, path).count() == 2


@pytest.mark.parametrize("broadcast", [True, False])
def test_extensions_equal_one_build(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(store, "BROADCAST_IDS", -1)
    path = str(tmp_path)
    late = ("b", "", "Old", "outdated streaming", 0)
    again = ("a", "", "Spark", "spark once more", 7)
    batches = [FIVE[:3], [*FIVE[3:], C_AGAIN], [late, again]]
    for rows in batches:
        index = pl.extend_index(page_log(spark, rows), path)
    assert (index.version, store.segment_count(spark, path)) == (3, 3)
    whole = pl.build_index(page_log(spark, [row for rows in batches for row in rows]))
    assert content(index) == content(whole)
    assert sorted(index.doc_freq.collect()) == sorted(whole.doc_freq.collect())
    assert index.corpus_stats.collect() == whole.corpus_stats.collect()
    columns = ["id", "url", "title", "body", "dl"]
    assert sorted(index.documents.select(columns).collect()) == sorted(
        whole.documents.select(columns).collect()
    )
    queries = requests(spark, "spark sql", "streaming", "pregel")
    assert ids(pl.search_many(index, queries)) == ids(pl.search_many(whole, queries))


def test_extensions_of_a_cumulative_index_equal_one_build(spark, tmp_path):
    path = str(tmp_path)
    late = ("b", "", "Old", "outdated streaming", 0)
    again = ("a", "", "Spark", "spark once more", 7)
    batches = [FIVE[:3], [*FIVE[3:], C_AGAIN], [late, again]]
    for rows in batches:
        index = pl.extend_index(page_log(spark, rows), path, "cumulative")
    whole = pl.build_index(page_log(spark, [row for rows in batches for row in rows]), "cumulative")
    assert content(index) == content(whole)
    assert sorted(index.doc_freq.collect()) == sorted(whole.doc_freq.collect())
    assert index.corpus_stats.collect() == whole.corpus_stats.collect()
    queries = requests(spark, "spark sql", "streaming", "pregel")
    assert ids(pl.search_many(index, queries)) == ids(pl.search_many(whole, queries))


def test_an_index_stays_in_its_mode(spark, tmp_path):
    pl.write_index(page_log(spark), str(tmp_path), "cumulative")
    with pytest.raises(ValueError, match="mode 'cumulative'"):
        pl.extend_index(page_log(spark), str(tmp_path), "latest")


def test_pages_without_an_order_always_replace(spark, tmp_path):
    path = str(tmp_path)
    pl.write_index(page_log(spark), path)
    for word in ("first", "second"):
        again = page_log(spark).drop("seq").withColumn("body", F.lit(word))
        index = pl.extend_index(again, path)
        assert {row.body for row in index.documents.collect()} == {word}
        assert index.documents.count() == 5


def test_a_stream_keeps_what_was_indexed_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "MAX_SEGMENTS", 3)
    folder, path = f"{tmp_path}/topic", f"{tmp_path}/index"
    base = [(f"base{i}", "", "", f"base words {i}", i) for i in range(20)]
    pl.write_index(page_log(spark, base).drop("seq"), path, num_shards=3)
    for i in range(7):
        send(spark, folder, [(f"new{i}", "", "", f"new words {i}", i), ("base3", "", "", f"again {i}", i)])
    run(spark, folder, path, refresh_every=3)
    index = pl.open_index(spark, path)
    assert index.num_shards == 3 and store.segment_count(spark, path) <= 3
    found = {row.id: row.body for row in index.documents.collect()}
    assert found.keys() == {f"base{i}" for i in range(20)} | {f"new{i}" for i in range(7)}
    assert found["base3"] == "again 6"
    assert index.corpus_stats.first().n == 27


def test_a_replayed_batch_counts_once(spark, tmp_path):
    path = str(tmp_path)
    messages = pl.encode_messages(page_log(spark), "seq")
    indexing.append_batch(messages, 0, path, ["seq"])
    first = pl.refresh_index(spark, path, "cumulative")
    indexing.append_batch(messages, 0, path, ["seq"])
    assert pl.refresh_index(spark, path, "cumulative").version == first.version == 1


def test_two_writers_are_both_visible(spark, tmp_path):
    path = str(tmp_path)
    pl.write_index(page_log(spark, FIVE[:1]), path)
    batches = [FIVE[1:3], FIVE[3:], [C_AGAIN]]
    with ThreadPoolExecutor(3) as writers:
        list(writers.map(lambda rows: pl.extend_index(page_log(spark, rows), path), batches))
    index = pl.open_index(spark, path)
    whole = pl.build_index(page_log(spark, [*FIVE, C_AGAIN]))
    assert index.version == 4 and content(index) == content(whole)
    assert sorted(index.doc_freq.collect()) == sorted(whole.doc_freq.collect())
    assert index.corpus_stats.collect() == whole.corpus_stats.collect()


def test_two_writers_of_a_first_version(spark, tmp_path):
    path = str(tmp_path)
    with ThreadPoolExecutor(2) as writers:
        list(writers.map(lambda rows: pl.extend_index(page_log(spark, rows), path), [FIVE[:2], FIVE[2:]]))
    index = pl.open_index(spark, path)
    assert index.version == 2 and index.documents.count() == 5


def test_a_version_is_committed_once(spark, tmp_path):
    path = str(tmp_path)
    pl.write_index(page_log(spark), path)
    entry = store._manifest_entry(spark, path)
    assert not store._commit(spark, path, entry)
    assert store._commit(spark, path, replace(entry, version=2))
    assert pl.open_index(spark, path).version == 2
    (tmp_path / "manifest" / "3.json").write_text('{"version": 3, "mo')  # not yet written
    assert pl.open_index(spark, path).version == 2


def test_a_batch_that_another_writer_has_added_counts_once(spark, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        index = pl.extend_index(page_log(spark), path, "cumulative", applied={"s": 4})
    assert index.version == 1 and index.corpus_stats.first().n == 5


def test_old_versions_expire_and_no_table_stays(spark, tmp_path):
    path, before = str(tmp_path), len(spark.catalog.listTables())
    for number in range(4):
        pl.write_index(page_log(spark, FIVE[: number + 1]), path)
    pl.extend_index(page_log(spark, [C_AGAIN]), path)
    assert pl.expire_versions(spark, path, keep=2) == 3
    assert pl.open_index(spark, path).documents.count() == 4
    assert pl.open_index(spark, path, 4).postings.count() > 0
    assert len(spark.catalog.listTables()) == before
    assert not list(tmp_path.glob("*scratch*")) + list(tmp_path.glob("*/scratch*"))


def test_an_extension_reads_no_posting_of_the_base(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path), []
    pl.write_index(page_log(spark), path)
    inner = store._bucketed_table

    def watched(session, location, shards):
        read.append(location)
        return inner(session, location, shards).filter(F.raise_error(F.lit("postings read")).isNull())

    monkeypatch.setattr(store, "_bucketed_table", watched)
    monkeypatch.setattr(store, "_write_postings", lambda postings, root, shards: postings)
    index = pl.extend_index(page_log(spark, [C_AGAIN]), path)
    assert read and index.doc_freq.filter("term = 'pregel'").first().df == 1


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "MAX_SEGMENTS", 2)
    folder, path = f"{tmp_path}/topic", f"{tmp_path}/index"
    for row in FIVE[:3]:
        send(spark, folder, [row])
    run(spark, folder, path)
    assert store.segment_count(spark, path) == 1
    index = pl.open_index(spark, path)
    assert (index.version, index.documents.count()) == (3, 3)


def failing(spark, folder, path, runs, failing_runs):
    def start():
        number = next(runs)
        stream = pl.file_messages(spark, folder, extra="seq BIGINT", maxFilesPerTrigger="1")
        broken = F.when(F.lit(number < failing_runs) & (F.col("seq") >= 3), F.raise_error(F.lit("gone")))
        stream = stream.withColumn("value", F.coalesce(broken.cast("binary"), "value"))
        return pl.index_stream(stream, path, f"{path}/checkpoint", ["seq"], available_now=True, refresh_every=2)

    return start


def test_a_failed_stream_starts_again(spark, tmp_path):
    folder, path = f"{tmp_path}/topic", f"{tmp_path}/index"
    for row in FIVE:
        send(spark, folder, [row])
    assert pl.keep_running(failing(spark, folder, path, iter(range(9)), 2), wait=0.01) == 2
    index = pl.open_index(spark, path)
    whole = pl.build_index(page_log(spark))
    assert content(index) == content(whole)
    assert index.corpus_stats.collect() == whole.corpus_stats.collect()


def test_restarts_have_an_end(spark, tmp_path):
    folder, path = f"{tmp_path}/topic", f"{tmp_path}/index"
    send(spark, folder, FIVE)
    with pytest.raises(StreamingQueryException, match="gone"):
        pl.keep_running(failing(spark, folder, path, iter(range(9)), 9), restarts=1, wait=0.01)


def test_batches_of_a_run_that_ended_early_become_visible(spark, tmp_path):
    folder, path = f"{tmp_path}/topic", f"{tmp_path}/index"
    for row in FIVE[:3]:
        send(spark, folder, [row])
    stream = pl.file_messages(spark, folder, extra="seq BIGINT", maxFilesPerTrigger="1")
    query = pl.index_stream(
        stream, path, f"{path}/checkpoint", ["seq"], available_now=True, refresh_every=100
    )
    query._query.awaitTermination()  # the process ends before its last batches become visible
    assert pl.refresh_index is not None and not (tmp_path / "index" / "manifest").exists()
    run(spark, folder, path, refresh_every=100)  # without new messages
    assert pl.open_index(spark, path).documents.count() == 3


def watched_plans(monkeypatch):
    """The plans of all tables that an extension writes on the way."""
    plans, inner = {}, store._stored

    def stored(rows, path):
        plans[path.rsplit("/", 1)[-1]] = rows._jdf.queryExecution().executedPlan().toString()
        return inner(rows, path)

    monkeypatch.setattr(store, "_stored", stored)
    return plans


@pytest.mark.parametrize("literal", [True, False])
def test_an_extension_reads_what_it_replaces(spark, tmp_path, monkeypatch, literal):
    """More ids than literals: bodies are not scanned, terms only where ids are found."""
    path, limit = str(tmp_path), 20
    monkeypatch.setattr(store, "LITERAL_IDS", 1000 if literal else limit)
    base = [(f"p{i:04}", "", "", f"words {i} here", i) for i in range(300)]
    pl.write_index(page_log(spark, base), path, num_shards=4)
    again = [(f"p{i:04}", "", "", f"other {i}", 1000 + i) for i in range(0, 300, 25)]
    new = [(f"q{i:04}", "", "", f"new {i}", i) for i in range(60)]
    plans = watched_plans(monkeypatch)
    index = pl.extend_index(page_log(spark, again + new), path)
    scans = [line for line in plans["met"].splitlines() if "ReadSchema" in line and "version" in line]
    assert scans and all("body" not in line and "terms" not in line for line in scans)
    wide = [line for line in plans["known"].splitlines() if "ReadSchema" in line and "terms" in line]
    assert wide and all("body" not in line for line in wide)
    assert "p0025" in wide[0] and "PushedFilters" in wide[0]  # the twelve ids found, as literals
    assert ("p0025" in plans["met"]) == literal
    assert not any("doc_freq" in text for text in plans.values())
    found = {row.term: row.df for row in index.doc_freq.collect()}
    assert (found["words"], found["other"], found["new"]) == (288, 12, 60)
    whole = pl.build_index(page_log(spark, base + again + new))
    assert sorted(index.doc_freq.collect()) == sorted(whole.doc_freq.collect())
    assert index.corpus_stats.collect() == whole.corpus_stats.collect()


def test_the_vocabulary_of_the_base_is_not_rewritten(spark, tmp_path):
    path = str(tmp_path)
    pl.write_index(page_log(spark, [(f"p{i}", "", "", f"word{i} all", i) for i in range(200)]), path)
    index = pl.extend_index(page_log(spark, [("p5", "", "", "other all", 999)]), path)
    newest = max(tmp_path.glob("version=2-*"))
    rows = {row.term: row.df for row in spark.read.parquet(f"{newest}/doc_freq").collect()}
    assert rows == {"other": 1, "word5": -1, "all": 0}
    found = {row.term: row.df for row in index.doc_freq.collect()}
    assert found["all"] == 200 and "word5" not in found and found["other"] == 1
    terms = spark.createDataFrame([("word7",), ("word5",)], "term string")
    text = pl.term_stats(index, terms)._jdf.queryExecution().executedPlan().toString()
    at = text.index("HashAggregate(keys=[term")
    assert "BroadcastHashJoin [term" in text[at:]  # asked terms are picked before they are added up


def test_counters_are_the_state_of_a_stream(spark, tmp_path):
    folder, checkpoint = f"{tmp_path}/topic", f"{tmp_path}/counters"
    for rows in ([*FIVE, C_AGAIN], FIVE[:2]):
        send(spark, folder, rows, bad=["{bad"])
        stream = pl.file_messages(spark, folder, extra="seq BIGINT", maxFilesPerTrigger="1")
        pl.count_stream(stream, checkpoint, available_now=True).awaitTermination()
    doc_freq, stats = pl.read_counters(spark, checkpoint)
    whole = pl.build_index(page_log(spark, [*FIVE, C_AGAIN, *FIVE[:2]]), "cumulative")
    assert sorted(doc_freq.collect()) == sorted(whole.doc_freq.collect())
    assert stats.collect() == whole.corpus_stats.collect()
    assert any("RocksDB" in f.read_text() for f in (tmp_path / "counters" / "offsets").glob("[0-9]*"))


@pytest.mark.parametrize("mode", ["latest", "cumulative"])
def test_postings_by_term_are_extended_and_merged(spark, tmp_path, mode):
    path = str(tmp_path)
    pl.write_index(page_log(spark, FIVE[:2]), path, mode, by_term=True)
    for rows in (FIVE[2:], [C_AGAIN], FIVE[:1]):
        index = pl.extend_index(page_log(spark, rows), path, max_segments=2)
    columns = ["id", "term", "tf", "dl", "adds", "added_tf"]
    assert sorted(index.by_term.select(columns).collect()) == sorted(index.postings.select(columns).collect())
    found = pl.search(index, "spark sql", 5).collect()
    usual = pl.search_many(index, requests(spark, "spark sql", k=5)).drop("qid").collect()
    assert found == usual and found


def test_pages_are_published_as_a_stream(spark, tmp_path):
    source, topic = f"{tmp_path}/pages", f"{tmp_path}/topic"
    page_log(spark).drop("seq").coalesce(1).write.parquet(source)
    pages = spark.readStream.schema(PAGE).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        pl.publish_stream(pages, f"{tmp_path}/state", "parquet", topic, available_now=True).awaitTermination()
    told = pl.decode_messages(spark.read.parquet(topic))
    assert sorted(map(tuple, told.collect())) == sorted(row[:4] for row in FIVE)
