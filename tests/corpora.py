"""Small corpora with known results."""

from pyspark.sql import types as T

from pagelode.schemas import PAGE

PAGE_LOG = T.StructType([*PAGE.fields, T.StructField("seq", T.LongType())])

FIVE = [
    ("a", "", "Spark", "spark streaming, spark sql.", 1),
    ("b", "", "Streaming", "streaming engine", 2),
    ("c", "", "SQL", "spark", 3),
    ("d", "", "", "", 4),
    ("e", "", "Notes", "a long note about sql tuning and spark tuning and more spark", 5),
]
C_AGAIN = ("c", "", "Graph", "pregel", 6)


def page_log(spark, rows=FIVE):
    return spark.createDataFrame(rows, PAGE_LOG)


def requests(spark, *texts, k=10):
    rows = [(text, text, k) for text in texts]
    return spark.createDataFrame(rows, "qid string, query string, k int")


def ranked(found):
    """{qid: [(id, score), ...]} in rank order."""
    result = {}
    for row in found.orderBy("qid", "rank").collect():
        result.setdefault(row.qid, []).append((row.id, row.score))
        assert row.rank == len(result[row.qid])
    return result


def ids(found):
    return {qid: [id for id, _ in hits] for qid, hits in ranked(found).items()}
