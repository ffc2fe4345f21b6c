"""Storing, opening and extending an index.

    <path>/manifest/N.json                   one file per complete version
    <path>/version=M-.../documents           partitioned by shard, a hash of the id
    <path>/version=M-.../postings            bucketed by id, sorted by term
    <path>/version=M-.../replaced            ids that earlier segments have too
    <path>/version=M-.../doc_freq            what the segment adds to document frequencies
    <path>/version=M-.../by_term             postings again, by hash of the term, if asked for

A version lies in a folder of its own and counts once its manifest file is there, last of
all: readers see a whole version or none of it, and a build that fails leaves the one
before in place. Each table is derived from stored ones, so a lost executor costs its
tasks and no earlier step. A manifest file is only ever created, never overwritten: of two
writers of one version the second finds it taken, and adds its pages to the other's version.

A version consists of segments: the folder of a full build, and one more for each
extension since. Documents that a later segment replaced are left out when reading.
Where segments become many, the last ones are merged with each other.

Documents carry their terms with what each adds to the statistics, in a column that
searches don't read. What a replaced document leaves behind is known from its row. So a
segment has signed differences of document frequencies, which are added up for the terms
that are asked for; number and length of the documents are in the manifest.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.functions.text import bow_vector, indexed_text
from pagelode.operators.index import (
    Part,
    SearchIndex,
    analysed,
    by_shards,
    check_mode,
    counted,
    gathered_terms,
    latest_pages,
    shard_of,
    slot_of,
    term_postings,
    with_average,
    with_length,
    with_version,
)
from pagelode.operators.retrieval import part_count
from pagelode.schemas import DOC_FREQ_DDL, POSTINGS_DDL, REPLACED_DDL
from pagelode.session import shuffle_partitions

# Most ids to broadcast, and their most bytes.
BROADCAST_IDS = 200_000
BROADCAST_ID_BYTES = 32 << 20
# Most ids to look for as literals, which prune shards and row groups.
LITERAL_IDS = 1000
# Bytes of documents whose postings one task sorts, and in a row group of documents.
POSTING_TASK_BYTES = 32 << 20
# Segments that an extension may leave.
MAX_SEGMENTS = 16
# How often an extension starts again because another writer was first.
COMMIT_ATTEMPTS = 20


@dataclass(frozen=True)
class Segment:
    """A folder of stored tables; `n` and `total_len` are what it adds to those of the index."""

    folder: str
    replaced: int
    rows: int
    n: int
    total_len: int
    id_bytes: int
    schema: str

    @property
    def version_type(self) -> T.DataType:
        return T.StructType.fromJson(json.loads(self.schema))["version"].dataType


@dataclass(frozen=True)
class Entry:
    """One version, as its manifest file has it."""

    version: int
    mode: str
    num_shards: int
    applied: dict[str, int]
    segments: list[Segment]
    by_term: bool = False
    vectors: bool = False


def write_index(
    pages: DataFrame,
    path: str,
    mode: str = "latest",
    num_shards: int | None = None,
    unique_ids: bool = False,
    applied: dict[str, int] | None = None,
    by_term: bool = False,
    vectors: bool = False,
) -> SearchIndex:
    """Build an index, see `build_index`, and store it as the next version under `path`.

    It replaces what other writers have added meanwhile. `num_shards` defaults to the number
    of shuffle partitions, which makes the shuffle that resolves versions also the one that
    lays out the documents. With `by_term` postings are stored a second time, by term, here and
    by every extension: a single query then opens the files of its terms and not all shards.
    With `vectors` documents keep their bag of words, which the default reranker then reads
    instead of splitting texts.
    """
    check_mode(mode)
    spark = pages.sparkSession
    segment, num_shards = _built(pages, path, mode, num_shards, unique_ids, by_term, vectors)
    while True:
        version = _newest(spark, path) + 1
        entry = Entry(version, mode, num_shards, applied or {}, [segment], by_term, vectors)
        if _commit(spark, path, entry):
            return _opened(spark, path, entry)


def _built(
    pages: DataFrame,
    path: str,
    mode: str,
    num_shards: int | None,
    unique_ids: bool = False,
    by_term: bool = False,
    vectors: bool = False,
) -> tuple[Segment, int]:
    """A full build in a folder of its own, which nothing names yet."""
    spark = pages.sparkSession
    partitions = shuffle_partitions(spark)
    num_shards = num_shards or partitions
    folder, root = _next_folder(spark, path)

    # Pages are placed before their terms are counted, which are more than the texts.
    versions = with_version(pages)
    if mode == "latest" or unique_ids:
        latest = versions if unique_ids else latest_pages(versions)
    else:
        latest = analysed(versions, mode)
    if unique_ids or num_shards != partitions:
        latest = latest.repartition(num_shards, "id")
    documents = _write_documents(latest, root, num_shards, vectors)
    # A scan of the documents reads whole shards or parts of them, so the postings
    # are in place already.
    postings = _write_postings(term_postings(documents), root, num_shards)
    if by_term:
        _write_by_term(postings, root, num_shards)
    _write_doc_freq(with_bounds(postings), root)
    rows, total_len, id_bytes = _size(documents, mode)
    return Segment(folder, 0, rows, rows, total_len, id_bytes, documents.schema.json()), num_shards


def extend_index(
    pages: DataFrame,
    path: str,
    mode: str | None = None,
    num_shards: int | None = None,
    applied: dict[str, int] | None = None,
    max_segments: int | None = MAX_SEGMENTS,
) -> SearchIndex:
    """Add pages to the newest version as the next one, or start an index with them.

    Only the given pages are analysed and written, as a further segment. Of the index so
    far, ids and versions are read to find the same ids, and then the rows of those:
    their terms, and in mode `cumulative` the rest. A page that has no `seq`,
    or whose indexed version has none or one of another type, replaces the indexed one:
    calls count in their order. Otherwise the newer `seq` stays, so adding the same pages
    again changes nothing in mode `latest`. In mode `cumulative` every version counts
    again for the statistics; `applied` names what has been added (a stream's last batch),
    so that a stream does not repeat it: if the newest version has all that, it stays.

    If another writer makes the next version first, the pages are added to that one, so
    both are in the end visible. With more than `max_segments` segments, the last ones are merged:
    those of like size, and as many as it takes. Merging reads stored segments only, so no
    page is lost whatever way it came in, and the number of shards stays.
    """
    spark = pages.sparkSession
    scratch = f"{path}/scratch-{uuid.uuid4().hex[:12]}"
    incoming, made_for, started = None, None, None
    try:
        for _ in range(COMMIT_ATTEMPTS):
            entry = _manifest_entry(spark, path)
            if entry is None:
                mode = mode or "latest"
                check_mode(mode)
                started = started or _built(pages, path, mode, num_shards)
                new = Entry(1, mode, started[1], applied or {}, [started[0]])
                if _commit(spark, path, new):
                    return _opened(spark, path, new)
                continue
            if mode not in (None, entry.mode):
                raise ValueError(f"the index is in mode {entry.mode!r}, not {mode!r}")
            if applied and all(entry.applied.get(key, -1) >= last for key, last in applied.items()):
                return _opened(spark, path, entry)
            if made_for != (entry.mode, entry.num_shards):
                made_for = entry.mode, entry.num_shards
                # In mode `latest` terms are counted when the pages are placed.
                told = with_version(pages)
                told = latest_pages(told) if entry.mode == "latest" else analysed(told, entry.mode)
                incoming = _stored(
                    told.withColumn("shard", shard_of("id", entry.num_shards)),
                    f"{scratch}/incoming-{uuid.uuid4().hex[:6]}",
                )
            folder, root = _next_folder(spark, path)
            segment = _extension(spark, path, entry, incoming, folder, scratch)
            segments = [*entry.segments, segment]
            if max_segments and len(segments) > max_segments:
                segments = _merged(
                    spark, path, segments, entry, f"{folder}/merged", max_segments
                )
            new = Entry(
                entry.version + 1,
                entry.mode,
                entry.num_shards,
                {**entry.applied, **(applied or {})},
                segments,
                entry.by_term,
                entry.vectors,
            )
            if _commit(spark, path, new):
                return _opened(spark, path, new)
            _delete(spark, root)
        raise RuntimeError(f"other writers were first {COMMIT_ATTEMPTS} times under {path}")
    finally:
        _delete(spark, scratch)


def _extension(
    spark: SparkSession, path: str, entry: Entry, incoming: DataFrame, folder: str, scratch: str
) -> Segment:
    """The segment that adds analysed pages to a version."""
    root = f"{path}/{folder}"
    met, known = _same_ids(spark, path, entry, incoming, f"{scratch}/{folder}")
    if entry.mode == "latest":
        outdated = met.filter(~F.col("newer")).select("id")
        fresh = incoming.join(_small(outdated, *_count(outdated)), "id", "left_anti")
    else:
        fresh = _added(incoming, known)
    placed = fresh.repartition(entry.num_shards, "id")
    documents = _write_documents(placed, root, entry.num_shards, entry.vectors)
    postings = _write_postings(term_postings(documents), root, entry.num_shards)
    if entry.by_term:
        _write_by_term(postings, root, entry.num_shards)
    _stored(known.select("id"), f"{root}/replaced")
    taken = known.select(F.inline("terms")).select("term", (-F.col("adds")).alias("df"))
    _write_doc_freq(with_bounds(postings, taken), root)
    rows, total_len, id_bytes = _size(documents, entry.mode)
    gone, gone_len, _ = _size(known, entry.mode)
    return Segment(
        folder, gone, rows, rows - gone, total_len - gone_len, id_bytes, documents.schema.json()
    )


def _same_ids(
    spark: SparkSession, path: str, entry: Entry, incoming: DataFrame, scratch: str
) -> tuple[DataFrame, DataFrame]:
    """`met` (id, newer): which incoming ids the index has, and whether the incoming page is
    newer; and `known`, the indexed rows whose place the extension takes.

    The first pass reads shard, id and version. What the extension takes the place of, newer ids in mode
    `latest` and all in mode `cumulative`, is then read from the parts that have it: few
    ids as literals, which select row groups by their bounds and Bloom filters, many by a join
    that selects shards. Bodies are read in mode `cumulative` only.
    """
    keys = incoming.select("shard", "id", F.col("version").alias("incoming"))
    literals = _few(keys.select("shard", "id"))
    rows, size = _count(keys) if literals is None else (len(literals), 0)
    kind = incoming.schema["version"].dataType
    parts = _parts(spark, path, entry)
    narrow = []
    for number, part in enumerate(parts):
        documents = _with_ids(part.documents.select("shard", "id", "version"), literals)
        newer = F.lit(True)
        if documents.schema["version"].dataType == kind:
            newer = (
                F.col("version.seq").isNull()
                | F.col("incoming.seq").isNull()
                | (F.col("incoming") > F.col("version"))
            )
        same = _joined(part.live(documents), keys, rows, size, entry.num_shards)
        narrow.append(same.select(F.lit(number).alias("part"), "shard", "id", newer.alias("newer")))
    met = _stored(functools.reduce(DataFrame.unionByName, narrow), f"{scratch}/met")
    wanted = met if entry.mode == "cumulative" else met.filter("newer")
    more = ["url", "title", "body", "dl"] if entry.mode == "cumulative" else ["dl"]
    every = _few(wanted.select("part", "shard", "id"))
    wide = []
    for number, part in enumerate(parts):
        own = wanted.filter(F.col("part") == number).select("shard", "id", "newer")
        few = _few(own) if every is None else [row for row in every if row["part"] == number]
        if few == []:
            continue
        documents = _with_ids(part.documents.select("shard", "id", "version", "terms", *more), few)
        same = documents.schema["version"].dataType == kind
        version = _as_version(F.col("version"), same, kind).alias("version")
        size = _count(own) if few is None else (len(few), 0)
        found = _joined(documents, own, *size, entry.num_shards)
        wide.append(found.select("id", version, "terms", "newer", *more))
    if wide:
        return met, _stored(functools.reduce(DataFrame.unionByName, wide), f"{scratch}/known")
    stored = T.StructType.fromJson(json.loads(entry.segments[-1].schema))
    fields = [(incoming.schema if n == "version" else stored)[n] for n in ("id", "version", "terms", *more)]
    return met, spark.createDataFrame([], T.StructType(fields)).withColumn("newer", F.lit(True))


def _few(rows: DataFrame) -> list[Row] | None:
    """Rows that can be literals; None if they are more."""
    found = rows.limit(LITERAL_IDS + 1).collect()
    return found if len(found) <= LITERAL_IDS else None


def _with_ids(documents: DataFrame, literals: Sequence | None) -> DataFrame:
    """Those of some ids. Lists of up to ten reach the row groups' bounds and Bloom filters one
    by one, longer ones by their ends only; so there is one list for rows and many for those."""
    if literals is None:
        return documents
    shards, ids = (sorted({row[name] for row in literals}) for name in ("shard", "id"))
    tens = [F.col("id").isin(ids[at : at + 10]) for at in range(0, len(ids), 10)]
    while len(tens) > 1:
        tens = [functools.reduce(Column.__or__, tens[at : at + 2]) for at in range(0, len(tens), 2)]
    wanted = F.col("shard").isin(shards) & F.col("id").isin(ids)
    return documents.filter(functools.reduce(Column.__and__, tens, wanted))


def _as_version(version: Column, same: bool, kind: T.DataType) -> Column:
    """A stored version in the type of another order, in which it is older than any."""
    if same:
        return version
    seq = F.lit(None).cast(kind["seq"].dataType)
    return F.struct(seq.alias("seq"), version["digest"].alias("digest"))


def _added(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming pages in mode `cumulative`, with what their indexed versions have added.

    The newer of both is the document; the terms of all versions add up.
    """
    newer = known.select("id", "newer")
    told = incoming.select("id", F.inline("terms")).join(newer, "id", "left")
    current = F.coalesce("newer", F.lit(True))
    indexed = known.select("id", "newer", F.inline("terms")).withColumn(
        "tf", F.when(~F.col("newer"), F.col("tf")).otherwise(F.lit(0))
    )
    rows = (
        told.withColumn("tf", F.when(current, F.col("tf")).otherwise(F.lit(0)))
        .unionByName(indexed)
        .groupBy("id", "term")
        .agg(
            F.sum("tf").alias("tf"), F.sum("adds").alias("adds"), F.sum("added_tf").alias("added_tf")
        )
    )
    columns = ["id", "url", "title", "body", "version"]
    older = known.filter(~F.col("newer")).select(*columns)
    shown = (
        incoming.select(*columns)
        .join(older.select("id"), "id", "left_anti")
        .unionByName(older)
    )
    return with_length(columns, shown.join(gathered_terms(rows), "id", "left"))


def _merged(
    spark: SparkSession,
    path: str,
    segments: list[Segment],
    entry: Entry,
    folder: str,
    most: int,
) -> list[Segment]:
    """The segments with the last of them merged into one.

    Going back, a segment joins while it has at most twice the rows of those behind it,
    or while there are still too many; so a row is merged again only when its segment
    has grown, a logarithmic number of times.
    """
    first, rows = len(segments) - 1, segments[-1].rows
    while first and (segments[first - 1].rows <= 2 * rows or first + 1 > most):
        first -= 1
        rows += segments[first].rows
    kept, joined = segments[:first], segments[first:]
    if len(joined) == 1:
        return segments
    kind = joined[-1].version_type
    live = []
    for part in _parts_of(spark, path, joined, entry.num_shards):
        same = part.documents.schema["version"].dataType == kind
        version = _as_version(F.col("version"), same, kind)
        live.append(part.live_documents().withColumn("version", version).drop("shard"))
    documents = functools.reduce(DataFrame.unionByName, live).repartition(entry.num_shards, "id")
    root = f"{path}/{folder}"
    documents = _write_documents(documents, root, entry.num_shards, entry.vectors)
    postings = _write_postings(term_postings(documents), root, entry.num_shards)
    if entry.by_term:
        _write_by_term(postings, root, entry.num_shards)
    known = _terms_of(spark, path, joined).select("term", "df")
    _write_doc_freq(with_bounds(postings.withColumn("adds", F.lit(0).cast("bigint")), known), root)
    lists = [f"{path}/{other.folder}/replaced" for other in joined if other.replaced]
    replaced = 0
    if lists and kept:
        ids = spark.read.schema(REPLACED_DDL).parquet(*lists).distinct()
        replaced = _stored(ids, f"{root}/replaced").count()
    merged = Segment(
        folder,
        replaced,
        documents.count(),
        sum(other.n for other in joined),
        sum(other.total_len for other in joined),
        max(other.id_bytes for other in joined),
        documents.schema.json(),
    )
    return [*kept, merged]


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete what only versions before the newest `keep` need; returns how many expire.

    Readers of an expired version fail from then on. Manifest files stay.
    """
    versions = _versions(spark, path)
    entries = [entry for v in versions if (entry := _manifest_entry(spark, path, v))]
    told = [{segment.folder.split("/")[0] for segment in entry.segments} for entry in entries]
    segments = {segment.folder for entry in entries[-keep:] for segment in entry.segments}
    used = {folder.split("/")[0] for folder in segments}
    expired = {folder for folders in told for folder in folders} - used
    for folder in expired:
        _delete(spark, f"{path}/{folder}")
    for folder in used - segments:  # only a merged segment in it is needed
        for name in ("documents", "postings", "replaced", "doc_freq", "by_term"):
            _delete(spark, f"{path}/{folder}/{name}")
    return len(expired)


def applied_batches(spark: SparkSession, path: str) -> dict[str, int]:
    """The last batch of each stream that the newest version has."""
    entry = _manifest_entry(spark, path)
    return dict(entry.applied) if entry else {}


def open_index(spark: SparkSession, path: str, version: int | None = None) -> SearchIndex:
    """A stored index; the newest complete version unless one is named."""
    entry = _manifest_entry(spark, path, version)
    if entry is None:
        raise ValueError(f"no index version {version or ''} under {path}")
    return _opened(spark, path, entry)


def segment_count(spark: SparkSession, path: str) -> int:
    """Number of segments of the newest version; 0 without one."""
    entry = _manifest_entry(spark, path)
    return 0 if entry is None else len(entry.segments)


def _opened(spark: SparkSession, path: str, entry: Entry) -> SearchIndex:
    parts = _parts(spark, path, entry)
    # Spark keeps the buckets through the union, so scores need no shuffle here either.
    postings = functools.reduce(
        DataFrame.unionByName,
        [
            part.live(_bucketed_table(spark, f"{path}/{segment.folder}/postings", entry.num_shards))
            for part, segment in zip(parts, entry.segments, strict=True)
        ],
    )
    n, total_len = (sum(getattr(s, name) for s in entry.segments) for name in ("n", "total_len"))
    stats = spark.sql(f"SELECT {n}L AS n, {total_len}L AS total_len")
    deltas = _terms_of(spark, path, entry.segments)
    doc_freq = _added_up(deltas) if len(parts) > 1 else deltas.select("term", "df")
    return SearchIndex(
        parts=tuple(replace(part, documents=part.documents.drop("version", "terms")) for part in parts),
        postings=postings,
        doc_freq=doc_freq.filter(F.col("df") > 0),
        deltas=deltas,
        by_term=_by_term(spark, path, entry, parts) if entry.by_term else None,
        corpus_stats=with_average(stats),
        num_shards=entry.num_shards,
        version=entry.version,
        id_bytes=max(segment.id_bytes for segment in entry.segments),
    )


def _by_term(spark: SparkSession, path: str, entry: Entry, parts: list[Part]) -> DataFrame:
    schema = f"{POSTINGS_DDL}, slot INT"
    found = [
        part.live(spark.read.schema(schema).parquet(f"{path}/{segment.folder}/by_term"))
        for part, segment in zip(parts, entry.segments, strict=True)
    ]
    return functools.reduce(DataFrame.unionByName, found)


def with_bounds(postings: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Document frequencies by some postings, and by `more` (term, df), with the highest tf and
    the lowest dl of a term in the postings, which bound what it adds to any score; null where
    the postings don't have it."""
    shown = F.col("tf") > 0
    rows = postings.select(
        "term", F.col("adds").alias("df"), F.when(shown, F.col("tf")).alias("tf"), F.when(shown, F.col("dl")).alias("dl")
    )
    if more is not None:
        none = F.lit(None).cast("bigint")
        rows = rows.unionByName(more.select("term", "df", none.alias("tf"), none.alias("dl")))
    told = rows.groupBy("term").agg(
        F.sum("df").alias("df"), F.max("tf").alias("top_tf"), F.min("dl").alias("low_dl")
    )
    return told.filter((F.col("df") != 0) | F.col("top_tf").isNotNull())


def _terms_of(spark: SparkSession, path: str, segments: list[Segment]) -> DataFrame:
    """What each segment has of each term; a filter or a small join by term reaches the scan."""
    folders = [f"{path}/{segment.folder}/doc_freq" for segment in segments]
    return spark.read.schema(DOC_FREQ_DDL).parquet(*folders)


def _added_up(told: DataFrame) -> DataFrame:
    return told.groupBy("term").agg(F.sum("df").alias("df"))


def _parts(spark: SparkSession, path: str, entry: Entry) -> list[Part]:
    return _parts_of(spark, path, entry.segments, entry.num_shards)


def _parts_of(
    spark: SparkSession, path: str, segments: list[Segment], num_shards: int
) -> list[Part]:
    parts = []
    for number, segment in enumerate(segments):
        later = [other for other in segments[number + 1 :] if other.replaced]
        replaced, placed, groups = None, None, 1
        if later:
            folders = [f"{path}/{other.folder}/replaced" for other in later]
            ids = spark.read.schema(REPLACED_DDL).parquet(*folders)
            rows, size = _count(ids)
            replaced = _small(ids, rows, size)
            groups = _groups(rows, size, num_shards)
            if groups > 1:
                placed = ids.withColumn("shard", shard_of("id", num_shards))
        schema = T.StructType.fromJson(json.loads(segment.schema))
        documents = spark.read.schema(schema).parquet(f"{path}/{segment.folder}/documents")
        parts.append(Part(documents, replaced, placed, groups))
    return parts


def _count(ids: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their ids."""
    size = F.coalesce(F.sum(F.octet_length("id") + 32), F.lit(0))
    return tuple(ids.agg(F.count(F.lit(1)), size).first())


def _small(ids: DataFrame, rows: int, size: int) -> DataFrame:
    """Ids to join with: broadcast if few and short, else hashed, which sorts no large side."""
    few = rows <= BROADCAST_IDS and size <= BROADCAST_ID_BYTES
    return F.broadcast(ids) if few else ids.hint("shuffle_hash")


def _groups(rows: int, size: int, num_shards: int) -> int:
    """Groups of shards whose ids fit a broadcast each; 1 where one has them all, or where they
    are more than MAX_PARTS or the shards allow."""
    groups = part_count((rows, BROADCAST_IDS), (size, BROADCAST_ID_BYTES))
    return groups if 1 < groups <= num_shards else 1


def _joined(documents: DataFrame, ids: DataFrame, rows: int, size: int, num_shards: int) -> DataFrame:
    """Stored documents joined with rows that have a shard and an id."""
    groups = _groups(rows, size, num_shards)
    if groups > 1:
        return by_shards(documents, ids, groups)
    return documents.join(_small(ids, rows, size), ["shard", "id"])


def _size(documents: DataFrame, mode: str) -> tuple[int, int, int]:
    """Number of documents, what they add to the total length, and the bytes of the longest id."""
    added = F.col("dl")
    if mode == "cumulative":
        added = F.aggregate("terms", F.lit(0).cast("bigint"), lambda total, t: total + t["added_tf"])
    zero = F.lit(0).cast("bigint")
    row = documents.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(added), zero),
        F.coalesce(F.max(F.octet_length("id")), zero),
    ).first()
    return tuple(int(value) for value in row)


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _write_documents(
    documents: DataFrame, root: str, num_shards: int, vectors: bool = False
) -> DataFrame:
    """Write placed documents, sorted by id; pages without terms get them after the sort, which
    then moves the texts alone."""
    placed = documents.withColumn("shard", shard_of("id", num_shards))
    placed = placed.sortWithinPartitions("shard", "id")
    if "terms" not in placed.columns:
        placed = counted(placed)
    if vectors and "vector" not in placed.columns:
        text = indexed_text(F.col("title"), F.col("body"))
        placed = placed.withColumn("vector", bow_vector(text))
    # Ids are looked up when pages come again.
    writer = placed.write.partitionBy("shard").option("parquet.bloom.filter.enabled#id", "true")
    writer = writer.option("parquet.block.size", str(POSTING_TASK_BYTES))
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{root}/documents")
    return placed.sparkSession.read.schema(placed.schema).parquet(f"{root}/documents")


def _write_postings(postings: DataFrame, root: str, num_shards: int) -> DataFrame:
    """Write the postings, those of the documents stored under `root`, sorted by term within files.

    Sorted are the postings of POSTING_TASK_BYTES of documents at a time, by the term alone: a
    file of each shard is then open while a task writes, as many as these few documents have.
    The settings for this are those of a session of its own, so other writers keep theirs.
    """
    location = f"{root}/postings"
    session = postings.sparkSession.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(POSTING_TASK_BYTES))
    session.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(num_shards))
    kinds = postings.schema
    terms = T.StructType([kinds[name] for name in ("term", "tf", "adds", "added_tf")])
    schema = T.StructType([kinds["id"], kinds["dl"]]).add("terms", T.ArrayType(terms))
    (
        term_postings(session.read.schema(schema).parquet(f"{root}/documents"))
        .sortWithinPartitions("term")
        .write.format("parquet")
        .bucketBy(num_shards, "id")
        .option("path", location)
        .saveAsTable(_table_name(location))
    )
    session.sql(f"DROP TABLE IF EXISTS {_table_name(location)}")
    return _bucketed_table(postings.sparkSession, location, num_shards)


def _write_by_term(postings: DataFrame, root: str, num_slots: int) -> None:
    """Postings by slot, a hash of the term. Slots of frequent terms are cut into several files:
    rebalancing splits what is larger than Spark's advisory size."""
    placed = postings.withColumn("slot", slot_of("term", num_slots)).hint("rebalance", "slot")
    placed = placed.sortWithinPartitions("slot", "term")
    placed.write.partitionBy("slot").parquet(f"{root}/by_term")


def _write_doc_freq(doc_freq: DataFrame, root: str) -> None:
    doc_freq.sortWithinPartitions("term").write.parquet(f"{root}/doc_freq")


# The manifest, through Spark's own file system layer


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = file_names(spark, f"{path}/manifest")
    return sorted(int(match[1]) for name in names if (match := re.fullmatch(r"(\d+)\.json", name)))


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, hadoop = _file_system(spark, folder)
    if not files.exists(hadoop):
        return []
    return [status.getPath().getName() for status in files.listStatus(hadoop)]


def _newest(spark: SparkSession, path: str) -> int:
    return max(_versions(spark, path), default=0)


def _manifest_entry(spark: SparkSession, path: str, version: int | None = None) -> Entry | None:
    """A version, or the newest one that is whole: a file may be seen before it is written."""
    versions = _versions(spark, path)
    wanted = versions[::-1] if version is None else [version] if version in versions else []
    for number in wanted:
        files, hadoop = _file_system(spark, f"{path}/manifest/{number}.json")
        stream = files.open(hadoop)
        try:
            told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            continue
        finally:
            stream.close()
        segments = [Segment(**segment) for segment in told.pop("segments")]
        return Entry(**told, segments=segments)
    return None


def _commit(spark: SparkSession, path: str, entry: Entry) -> bool:
    """Create the manifest file of a version; False if there is one already."""
    text = json.dumps(asdict(entry))
    files, hadoop = _file_system(spark, f"{path}/manifest/{entry.version}.json")
    files.mkdirs(hadoop.getParent())
    if files.getUri().getScheme() == "file":  # whose create() looks and writes in two steps
        place = hadoop.toUri().getPath()
        draft = f"{os.path.dirname(place)}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        stream = files.create(hadoop, False)
    except Py4JJavaError as error:
        if files.exists(hadoop):
            return False
        raise error
    stream.write(text.encode())
    stream.close()
    return True


def _next_folder(spark: SparkSession, path: str) -> tuple[str, str]:
    folder = f"version={_newest(spark, path) + 1}-{uuid.uuid4().hex[:12]}"
    return folder, f"{path}/{folder}"


def _table_name(location: str) -> str:
    return f"pagelode_postings_{hashlib.sha256(location.encode()).hexdigest()[:16]}"


def _bucketed_table(spark: SparkSession, location: str, num_shards: int) -> DataFrame:
    """The stored postings with their buckets, also in a session that did not write them.

    Buckets are a property of catalog tables. The table is there while the plan is
    made, which keeps its files and buckets, and is then dropped; its files stay.
    """
    table = _table_name(location)
    quoted = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({POSTINGS_DDL}) USING parquet "
        f"CLUSTERED BY (id) SORTED BY (term) INTO {num_shards} BUCKETS LOCATION '{quoted}'"
    )
    postings = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return postings


def _delete(spark: SparkSession, folder: str) -> None:
    files, hadoop = _file_system(spark, folder)
    files.delete(hadoop, True)
