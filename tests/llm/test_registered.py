"""Registered queries against their SQL on the smallest driver tables, and the pipeline."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from checks.compare import rows, same
from pagelode.llm.oracles import ORACLES
from pagelode.llm.queries import QUERIES
from tests.llm import brute

SF = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are missing")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in SF.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_all_are_registered():
    names = set(queries())
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14))
    assert "pipeline" in names and QUERIES.keys() | {"pipeline"} <= names
    assert ORACLES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    found, wanted = QUERIES[name](spark, str(SF)), db.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    ours = rows(found.columns, [tuple(row) for row in found.collect()])
    theirs = rows(wanted.columns, wanted.fetchall())
    assert len(ours) == len(theirs) > 0
    assert all(map(same, ours, theirs))


def test_scan_of_secrets_equals_brute_force(spark, db):
    texts = dict(db.sql("SELECT doc_id, text FROM documents").fetchall())
    found = QUERIES["op3_secret_scan"](spark, str(SF)).collect()
    assert len(found) == len(texts)
    for row in found:
        base = brute.base_spans(texts[row["doc_id"]])
        kinds = [span[3] for span in base]
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(
            map(kinds.count, ("assign", "access", "hex"))
        )
        assert row["base_sha256"] == brute.sha256(brute.written(base))
        assert {s for s in row["spans"].split(",") if not s.startswith("markov")} - {""} == set(
            brute.written(base).split(",")
        ) - {""}


def test_languages_of_held_out_documents(spark, db):
    known = dict(db.sql("SELECT doc_id, lang FROM documents").fetchall())
    found = QUERIES["op9_language_id"](spark, str(SF)).collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(known) and held
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_pipeline_equals_its_stages_by_hand(spark, db):
    docs = db.sql("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
    items = db.sql("SELECT text FROM benchmark").fetchall()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    spoken = {r["doc_id"] for r in named["language ID"](spark, frame, str(SF)).collect()}
    assert len(spoken) >= 0.99 * len(docs)
    docs = [d for d in docs if d[0] in spoken]
    roots = brute.components([brute.fingerprint(text) for _, text, _ in docs])
    docs = [d for i, d in enumerate(docs) if roots[i] == i]
    docs = [d for d in docs if not any(brute.contained(d[1], item) for (item,) in items)]
    found = corpus_pipeline.run(spark, str(SF)).collect()
    assert sorted(r["doc_id"] for r in found) == [d[0] for d in docs]
    for row in found:
        assert 0 <= row["taken"] <= 2 * row["size"]
    total = sum(r["size"] for r in found)
    assert abs(sum(r["taken"] for r in found) - 1.5 * total) <= 20


def test_stages_keep_columns_and_odd_rows(spark):
    from tests.llm.tables import clashing, documents, texts

    docs = clashing(documents(spark, texts() + texts(), [*range(len(texts())), None, *range(1, len(texts()))]))
    columns = documents(spark, []).columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(SF))
        assert kept.columns == columns
        assert stage(spark, documents(spark, []), str(SF)).count() == 0
    kept = corpus_pipeline.near_dedup(spark, docs, str(SF))
    prints = [brute.fingerprint(r["text"]) for r in kept.collect()]
    assert len(prints) == len(set(brute.components(prints)))
