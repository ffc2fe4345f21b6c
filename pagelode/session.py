"""Session helpers: builder defaults, scoped settings, shared folder, size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "pagelode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def session_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Set runtime SQL settings for the length of a block, then put them back."""
    keys = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for tables that later stages read back.

    Lies under `spark.checkpoint.dir`, the folder that every executor can reach. Only a
    session that runs in one process may go without that setting and use a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="pagelode-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits(df: DataFrame, texts: list[str], rows: int, size: int) -> bool:
    """Whether `df` has at most `rows` rows and its text columns `size` bytes with their rows'
    own; a broadcast may then hold it."""
    octets = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in texts), F.lit(32))
    count, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(octets), F.lit(0))).first()
    return count <= rows and total <= size
