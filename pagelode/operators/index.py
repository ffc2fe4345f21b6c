"""The inverted index: its tables, how they follow from pages, and term statistics.

An index is four tables.

documents     id, url, title, body, dl
postings      id, term, tf, dl, adds, added_tf
doc_freq      term, df
corpus_stats  n, total_len, avgdl (one row)

Stored documents and postings are both laid out by the hash of the document id.
A term that occurs in a third of all documents is thereby spread evenly over all
shards, and the scores of a document are summed up without moving its postings.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import scoring
from pagelode.functions.text import indexed_text, tokens, value_counts
from pagelode.schemas import PAGE_FIELDS
from pagelode.session import fits, shared_dir

MODES = ("latest", "cumulative")
TERMS_TYPE = "array<struct<term:string,tf:bigint,adds:bigint,added_tf:bigint>>"

# Most terms to put into a filter as literals.
LITERAL_TERMS = 1000
# Most terms to broadcast to the document frequencies, and their most bytes.
BROADCAST_TERMS = 1_000_000
BROADCAST_TERM_BYTES = 32 << 20


@dataclass(frozen=True)
class Part:
    """Documents of one stored segment, and the ids that later segments replaced; where these are
    too many for one broadcast and few enough for several, `by_shard` has them with their shards,
    and `groups` tells into how many groups of shards they are cut."""

    documents: DataFrame
    replaced: DataFrame | None = None
    by_shard: DataFrame | None = None
    groups: int = 1

    def live(self, rows: DataFrame) -> DataFrame:
        """Those of some rows of this segment, which have an id, that are not replaced."""
        return rows if self.replaced is None else rows.join(self.replaced, "id", "left_anti")

    def live_documents(self) -> DataFrame:
        """All documents of this segment that are not replaced; none of them is shuffled for that."""
        if self.by_shard is None:
            return self.live(self.documents)
        return by_shards(self.documents, self.by_shard, self.groups, "left_anti")


@dataclass(frozen=True)
class SearchIndex:
    """The tables of one immutable index version, or plans that derive them.

    `num_shards` is set for a stored index, whose documents carry a `shard` column, and so are
    `id_bytes`, the bytes of the longest id, and `deltas`, (term, df, top_tf, low_dl) of each
    segment: what it adds to a frequency, and the highest tf and the lowest dl of its postings.
    `by_term` are the same postings with a `slot`, a hash of the term, by which they are stored.
    `pages` are the analysed pages that a derived index follows from.
    """

    parts: tuple[Part, ...]
    postings: DataFrame
    doc_freq: DataFrame
    corpus_stats: DataFrame
    num_shards: int | None = None
    version: int | None = None
    id_bytes: int | None = None
    deltas: DataFrame | None = None
    by_term: DataFrame | None = None
    pages: DataFrame | None = None

    @property
    def documents(self) -> DataFrame:
        return functools.reduce(
            DataFrame.unionByName, [part.live_documents() for part in self.parts]
        )

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def for_terms(self, terms: Sequence[str]) -> SearchIndex:
        """The same index with the named terms only, as a filter the scans push down.

        A query of very many terms would touch most of the index anyway; it is left
        to the join.
        """
        if len(terms) > LITERAL_TERMS:
            return self
        wanted = F.col("term").isin(list(terms))
        postings = self.postings.filter(wanted)
        if self.by_term is not None:
            slots = [slot_of(F.lit(term), self.num_shards) for term in terms] or [F.lit(-1)]
            postings = self.by_term.filter(F.col("slot").isin(slots) & wanted).drop("slot")
        return replace(
            self,
            postings=postings,
            doc_freq=self.doc_freq.filter(wanted),
            deltas=None if self.deltas is None else self.deltas.filter(wanted),
        )

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df, top_tf, low_dl), the last two null where they are not known; with `terms`,
        few enough for a broadcast, of those alone, which are picked before segments are added up."""
        if self.deltas is None:
            unknown = F.lit(None).cast("bigint")
            known = self.doc_freq.select("term", "df", unknown.alias("top_tf"), unknown.alias("low_dl"))
            return known if terms is None else known.join(F.broadcast(terms), "term", "left_semi")
        known = self.deltas
        if terms is not None:
            known = known.join(F.broadcast(terms), "term", "left_semi")
        if len(self.parts) > 1:
            known = known.groupBy("term").agg(
                F.sum("df").alias("df"), F.max("top_tf").alias("top_tf"), F.min("low_dl").alias("low_dl")
            )
        return known.filter(F.col("df") > 0)


def shard_of(id: str | Column, num_shards: int) -> Column:
    """Shard of a document; the same placement as Spark's hash partitioning and buckets."""
    return F.pmod(F.hash(id), F.lit(num_shards))


def by_shards(documents: DataFrame, ids: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """Stored documents joined with rows that have a shard and an id, where the documents lie: each
    group of shards is read once, with a broadcast of the rows whose ids lie in it."""
    own = F.col("shard") % groups
    return functools.reduce(
        DataFrame.unionByName,
        [
            documents.filter(own == number).join(F.broadcast(ids.filter(own == number)), ["shard", "id"], how)
            for number in range(groups)
        ],
    )


def slot_of(term: str | Column, num_slots: int) -> Column:
    """Where the postings of a term lie in the layout by term."""
    return F.pmod(F.xxhash64(term), F.lit(num_slots)).cast("int")


# Building


def analysed(versions: DataFrame, mode: str = "latest", unique_ids: bool = False) -> DataFrame:
    """The current pages with `dl` and `terms`, from which all other tables follow.

    `terms` is an array of (term, tf, adds, added_tf): how often the current version has
    the term, how many versions have it, and how often they have it together. So a text
    is split into terms once, and what a page adds to the statistics can be taken back
    by reading its row.
    """
    latest = versions if unique_ids else latest_pages(versions)
    if mode == "latest" or unique_ids:
        return counted(latest)
    history = (
        term_rows(versions, "id", "version")
        .groupBy("id", "term")
        .agg(
            F.max(F.struct("version", "tf")).alias("last"),
            F.count(F.lit(1)).alias("adds"),
            F.sum("tf").alias("added_tf"),
        )
    )
    current = latest.select("id", F.col("version").alias("current"))
    tf = F.when(F.col("last.version") == F.col("current"), F.col("last.tf")).otherwise(F.lit(0))
    rows = history.join(current, "id").select(
        "id", "term", tf.cast("bigint").alias("tf"), "adds", "added_tf"
    )
    return with_length(latest.columns, latest.join(gathered_terms(rows), "id", "left"))


def counted(pages: DataFrame) -> DataFrame:
    """`analysed` for pages that have one version each: only the row itself is looked at."""
    words = pages.withColumn("_words", page_tokens())
    once = {
        "adds": lambda tf: F.lit(1).cast("bigint"),
        "added_tf": lambda tf: tf,
    }
    return words.select(
        *pages.columns,
        F.coalesce(F.size("_words"), F.lit(0)).cast("bigint").alias("dl"),
        F.coalesce(value_counts(F.col("_words"), more=once), F.array().cast(TERMS_TYPE)).alias("terms"),
    )


def gathered_terms(rows: DataFrame) -> DataFrame:
    """(id, terms) from one row for each term of a page."""
    return rows.groupBy("id").agg(
        F.collect_list(F.struct("term", "tf", "adds", "added_tf")).alias("terms")
    )


def with_length(columns: Sequence[str], pages: DataFrame) -> DataFrame:
    """The named columns, `dl` from the terms, and the terms, none of them being null."""
    terms = F.coalesce("terms", F.array().cast(TERMS_TYPE))
    length = F.aggregate(terms, F.lit(0).cast("bigint"), lambda total, t: total + t["tf"])
    return pages.select(*columns, length.alias("dl"), terms.alias("terms"))


def term_postings(documents: DataFrame) -> DataFrame:
    """Postings from the terms of documents."""
    return documents.select("id", "dl", F.inline("terms")).select(
        "id", "term", "tf", "dl", "adds", "added_tf"
    )


def measured(pages: DataFrame) -> DataFrame:
    """Add the length of each page in terms, repeats included."""
    return pages.withColumn("dl", F.size(page_tokens()).cast("bigint"))


def term_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """One row (term, tf) per distinct term of each page."""
    # The outer form: the inner one makes the optimizer test the array for emptiness
    # beforehand, which would analyse every text twice.
    return pages.select(*keep, F.inline_outer(value_counts(page_tokens()))).filter(
        F.col("term").isNotNull()
    )


def distinct_terms(pages: DataFrame) -> DataFrame:
    """Like the postings of pages for counting documents: no order, no counts."""
    terms = F.explode_outer(F.array_distinct(page_tokens())).alias("term")
    rows = pages.select(terms).filter(F.col("term").isNotNull())
    return rows.withColumn("adds", F.lit(1).cast("bigint"))


def page_tokens() -> Column:
    return tokens(indexed_text(F.col("title"), F.col("body")))


def with_version(pages: DataFrame) -> DataFrame:
    """Replace `seq` by a total order of the versions of a page.

    Versions of equal or no `seq` that come together are ordered by a digest of their
    content, so the result never depends on the order in which rows arrive.
    """
    seq = F.col("seq") if "seq" in pages.columns else F.lit(None).cast("bigint")
    digest = F.xxhash64("url", "title", "body")
    return pages.select(*PAGE_FIELDS, F.struct(seq.alias("seq"), digest.alias("digest")).alias("version"))


def latest_pages(versions: DataFrame) -> DataFrame:
    """The latest version of each page.

    A maximum, not a window: Spark combines the versions of a page before the
    shuffle, so a page that was sent a billion times reaches its task once per
    map task.
    """
    row = F.struct("version", "url", "title", "body")
    return (
        versions.groupBy("id")
        .agg(F.max(row).alias("page"))
        .select("id", "page.url", "page.title", "page.body", "page.version")
    )


def build_index(pages: DataFrame, mode: str = "latest", unique_ids: bool = False) -> SearchIndex:
    """Plans for the tables of an index over `pages`; nothing runs yet.

    `pages` has id, url, title, body and, where ids repeat, `seq`. The mode says
    what a repeated id does:

    latest      only its latest version counts, everywhere
    cumulative  the latest version is the document, but document frequencies and the
                total length count every version, and terms only older versions
                contain still lead to the document, with a score of 0

    `unique_ids` vouches that no id repeats, which saves resolving versions.
    """
    check_mode(mode)
    versions = with_version(pages)
    latest = versions if unique_ids else latest_pages(versions)
    documents = measured(latest)
    if mode == "cumulative" and not unique_ids:
        postings = cumulative_postings(documents, versions)
        doc_freq = document_frequency(postings)
        stats = corpus_statistics(documents, postings)
    else:
        postings = latest_postings(documents)
        doc_freq = document_frequency(distinct_terms(latest))
        stats = corpus_statistics(documents)
    return SearchIndex(
        parts=(Part(documents.drop("version")),),
        postings=postings,
        doc_freq=doc_freq,
        corpus_stats=stats,
        pages=analysed(versions, mode, unique_ids),
    )


def analysed_once(index: SearchIndex) -> SearchIndex:
    """A derived index whose analysed pages are written to the shared folder, so that no text is
    analysed again for each of its tables; others as they are."""
    if index.pages is None:
        return index
    path = shared_dir(index.spark, "pages")
    index.pages.write.parquet(path)
    pages = index.spark.read.schema(index.pages.schema).parquet(path)
    postings = term_postings(pages)
    added = F.aggregate("terms", F.lit(0).cast("bigint"), lambda total, t: total + t["added_tf"])
    stats = pages.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(added), F.lit(0)).alias("total_len")
    )
    return SearchIndex(
        parts=(Part(pages.drop("version", "terms")),),
        postings=postings,
        doc_freq=document_frequency(postings),
        corpus_stats=with_average(stats),
    )


def latest_postings(documents: DataFrame) -> DataFrame:
    return term_rows(documents, "id", "dl").select(
        "id",
        "term",
        "tf",
        "dl",
        F.lit(1).cast("bigint").alias("adds"),
        F.col("tf").alias("added_tf"),
    )


def cumulative_postings(documents: DataFrame, versions: DataFrame) -> DataFrame:
    last = F.max(F.struct("version", "tf"))
    history = (
        term_rows(versions, "id", "version")
        .groupBy("id", "term")
        .agg(
            last.alias("last"),
            F.count(F.lit(1)).alias("adds"),
            F.sum("tf").alias("added_tf"),
        )
    )
    current = documents.select("id", "dl", F.col("version").alias("current"))
    in_current = F.col("last.version") == F.col("current")
    return history.join(current, "id").select(
        "id",
        "term",
        F.when(in_current, F.col("last.tf")).otherwise(F.lit(0)).cast("bigint").alias("tf"),
        "dl",
        "adds",
        "added_tf",
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.sum("adds").alias("df"))


def corpus_statistics(documents: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """One row: number of pages, empty ones included, total and average length.

    The total length is that of the documents, or with `postings` of all their versions.
    """
    stats = documents.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len")
    )
    if postings is not None:
        added = postings.agg(F.coalesce(F.sum("added_tf"), F.lit(0)).alias("total_len"))
        stats = stats.withColumn("total_len", added.scalar())
    return with_average(stats)


def with_average(stats: DataFrame) -> DataFrame:
    return stats.withColumn(
        "avgdl",
        F.when(F.col("n") == 0, F.lit(1.0)).otherwise(
            F.try_divide(F.col("total_len").cast("double"), F.col("n").cast("double"))
        ),
    )


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


# Term statistics


def term_stats(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """Document frequency and idf of the given terms; unseen terms count as seen once."""
    terms = terms.select("term").distinct()
    few = fits(terms, ["term"], BROADCAST_TERMS, BROADCAST_TERM_BYTES)
    known = index.frequencies(terms if few else None).select("term", "df")
    stats = index.corpus_stats.select("n").scalar()
    return terms.join(known, "term", "left").select(
        "term",
        scoring.known_df(F.col("df")).cast("bigint").alias("df"),
        scoring.idf(stats, F.col("df")).alias("idf"),
    )
