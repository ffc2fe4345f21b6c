"""Small tables with nulls, empty and long texts, repeated rows and clashing names."""

import random

from pyspark.sql import functions as F

WORDS = "the of and river stone house walk green paper light over under seven table".split()
CLASHES = [
    "id", "fp", "n", "key", "size", "target", "taken", "language", "items", "secrets", "row",
    "words", "hits", "label", "content", "metadata", "draw", "bin", "component_id", "place",
    "window", "block", "shard", "vector", "spans", "score", "record_id",
]


def prose(seed, count):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(count))


def texts():
    long = prose(1, 20_000)
    near = prose(2, 400)
    return [
        None,
        "",
        "   \t\n",
        "!!! ... ---",
        "one",
        "ONE",
        "two words",
        near,
        near + " end",
        near.upper(),
        near,
        long,
        long + " tail",
        "ÄÖÜ ß é 漢字 \U0001f600 word",
        "line\nline\rline\x0bline\x0cline\tline",
        *(prose(seed, 30) for seed in range(10, 30)),
    ]


def documents(spark, rows=None, ids=None):
    rows = texts() if rows is None else rows
    ids = list(range(len(rows))) if ids is None else ids
    data = [
        (i, text, [None, "en", "fr"][n % 3], [None, "a", "b", "ü"][n % 4], len(text or ""))
        for n, (i, text) in enumerate(zip(ids, rows, strict=True))
    ]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long"
    )


def clashing(df):
    """The table with extra columns named like what the operators use inside."""
    return df.withColumns({name: F.lit("x") for name in CLASHES if name not in df.columns})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
