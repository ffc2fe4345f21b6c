"""Row shapes shared by the package."""

from pyspark.sql import types as T

PAGE_FIELDS = ("id", "url", "title", "body")

PAGE = T.StructType([T.StructField(name, T.StringType(), False) for name in PAGE_FIELDS])

MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
    ]
)

QUERY = T.StructType(
    [
        T.StructField("qid", T.StringType(), False),
        T.StructField("query", T.StringType(), False),
        T.StructField("k", T.IntegerType(), False),
    ]
)

ORDER = T.StructType(
    [
        T.StructField("qid", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("pos", T.IntegerType(), False),
    ]
)

# Tables of a stored index.
DOC_FREQ_DDL = "term STRING, df BIGINT, top_tf BIGINT, low_dl BIGINT"
POSTINGS_DDL = (
    "id STRING, term STRING, tf BIGINT, dl BIGINT, adds BIGINT, added_tf BIGINT"
)

REPLACED_DDL = "id STRING"
