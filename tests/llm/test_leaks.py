from pyspark.sql import functions as F

from pagelode.llm import leaks
from pagelode.llm.leaks import with_items
from tests.llm import brute
from tests.llm.tables import clashing, documents, prose, rows, texts

ITEMS = [
    (1, prose(100, 40)),
    (2, prose(101, 7)),
    (3, "Two, words!"),
    (4, "one"),
    (5, None),
    (6, " ?! "),
    (7, prose(102, 400)),
    (7, prose(102, 400)),
    (None, prose(103, 12)),
]


def planted():
    words = prose(100, 40).split()
    edited = [*words[:20], "other", *words[20:]]
    return [
        *texts(),
        f"{prose(5, 9000)} {ITEMS[0][1]} {prose(6, 9000)}",
        f"{prose(5, 50)} {' '.join(edited)} {prose(6, 50)}",
        f"{prose(5, 50)} {' '.join(words[:20])} {prose(7, 9)} {' '.join(words[20:])}",
        ", ".join(words).upper(),
        " ".join(words[:30]),
        f"x {ITEMS[6][1]} y",
        f"x {ITEMS[8][1]} y",
        "here are two  words.",
    ]


def items_of(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def found_in(docs, items, **options):
    out = with_items(docs, F.col("text"), items, **options)
    return rows(out.select("doc_id", F.inline("items")))


def wanted(docs):
    return sorted(
        (
            (doc, item, *match)
            for doc, text in enumerate(docs)
            for item, own in dict.fromkeys(ITEMS)
            if (match := brute.contained(text, own))
        ),
        key=repr,
    )


def test_items_equal_brute_force(spark):
    docs = planted()
    found = found_in(documents(spark, docs), items_of(spark))
    assert found == wanted(docs) and len(found) >= 8


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 900)
    docs = planted()
    assert found_in(documents(spark, docs), items_of(spark)) == wanted(docs)
    table = clashing(documents(spark, docs + docs, [*range(len(docs)), *[None] * len(docs)]))
    out = with_items(table, F.col("text"), items_of(spark))
    assert rows(out.drop("items")) == rows(table.drop("items"))
    assert out.where("size(items) > 0").count() == 2 * len({doc for doc, *_ in wanted(docs)})


def test_documents_come_back_whole(spark):
    docs = clashing(documents(spark))
    out = with_items(docs, F.col("text"), items_of(spark), name="_found")
    assert rows(out.drop("_found")) == rows(docs)
    assert with_items(docs, F.col("text"), items_of(spark)).count() == docs.count()


def test_empty_tables(spark):
    assert found_in(documents(spark, []), items_of(spark)) == []
    out = with_items(documents(spark), F.col("text"), items_of(spark, []))
    assert {r["n"] for r in out.select(F.size("items").alias("n")).collect()} == {0}
