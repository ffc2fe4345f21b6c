"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 4096
#: Characters of a text that are hashed at a time.
BLOCK = 1_000_000
UNKNOWN = "und"
#: More languages would make the model larger than a broadcast should be (64 MB).
MAX_LANGUAGES = 1000
NO_LETTERS = re.compile(r"[\W\d_]+")
SIZE_BINS = 32
#: A floor is a quantile of so many texts at least, where the language has them.
LEAST_TEXTS = 100
#: Steps in which cosines are counted for the floors.
COSINE_STEPS = 1000


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 2- and 3-grams of the letters; None if there are no letters."""
    words = NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, words)):
        return None
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    words = f" {words} "
    for start in range(0, len(words), BLOCK):
        part = words[start : start + BLOCK + 2].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, dtype="<u4").astype(np.uint64)
        for size in (2, 3):
            ends = min(BLOCK, len(codes) - size + 1)
            if ends < 1:
                continue
            mixed = np.full(ends, size, dtype=np.uint64)
            for i in range(size):
                mixed = (mixed + codes[i : i + ends]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            ids = (mixed >> np.uint64(40)) % np.uint64(DIMENSIONS)
            counts += np.bincount(ids.astype(np.int64), minlength=DIMENSIONS)
    return counts


def gram_vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF vector of length 1, as places and values."""
    places = np.flatnonzero(counts)
    values = (1 + np.log(counts[places])) * idf[places]
    return places, (values / np.sqrt(values @ values)).astype(np.float32)


@dataclass
class LanguageModel:
    """Centroids (a row each) with their languages, idf, and the lowest cosines accepted.

    `floors[lang][i]` holds for texts that are nearest to a centroid of the language and have
    2**i or more n-grams and fewer than twice as many.
    """

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floors: dict[str, np.ndarray]

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine in 0 to 1, and whether the text is too far from all centroids."""
        counts = gram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        places, values = gram_vector(counts, self.idf)
        cosines = self.centroids[:, places] @ values
        best = int(np.argmax(cosines))
        cosine = float(min(1.0, max(0.0, cosines[best])))
        lang = self.languages[best]
        floor = self.floors[lang][size_bin(counts)] if lang in self.floors else 0.0
        return lang, cosine, bool(cosine < floor)


def size_bin(counts: np.ndarray) -> int:
    return min(SIZE_BINS - 1, int(counts.sum()).bit_length() - 1)


def cluster(vectors: np.ndarray, centroids: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts with the mean, then the vectors farthest from all centres."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(centroids, len(vectors)):
        centres.append(vectors[np.argmin((vectors @ np.stack(centres).T).max(axis=1))])
    centres = _unit(np.stack(centres))
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[own == i].sum(axis=0) for i in range(len(centres))])
        new = _unit(sums[(sums != 0).any(axis=1)])
        if new.shape == centres.shape and np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with letters, and in how many each n-gram bucket occurs; over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    found[:-1] += counts > 0
                    found[-1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(DIMENSIONS + 1)), pa.array(found)], ["bucket", "n"]
        )

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    totals = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for bucket, n in rows:
        totals[bucket] = n
    return int(totals[-1]), totals[:-1]


def train(
    labelled: DataFrame,
    centroids: int = 4,
    sample_per_language: int = 500,
    strictness: float = 0.5,
) -> LanguageModel:
    """A model from `labelled (text, lang)`; rows with a null in either are not learned from.

    Document frequencies cover all rows. Centroids come from a bounded sample: about
    `sample_per_language` distinct texts of each language, those of the smallest hashes,
    clustered in one task per language. A text is rejected below `strictness` times the cosine
    that 99 of 100 labelled texts of its language and size reach, over all rows. The model has at most
    MAX_LANGUAGES * centroids * DIMENSIONS numbers; more languages are an error. Without any
    labelled text the model knows no language and answers `und`.
    """
    labelled = labelled.where("lang is not null and text is not null").select("text", "lang")
    total, frequent = document_frequencies(labelled.select("text"))
    idf = np.log((1 + total) / (1 + frequent)) + 1
    draw = F.xxhash64("text")
    counts = labelled.groupBy("lang").agg(F.count_distinct(draw).alias("n"))
    sizes = {row["lang"]: row["n"] for row in counts.limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    counts = labelled.sparkSession.createDataFrame(list(sizes.items()), "lang string, n long")
    share = F.lit(float(sample_per_language)) / F.col("n") * 1.2 * float(2**64) - float(2**63)
    sample = (
        labelled.withColumn("draw", draw)
        .join(F.broadcast(counts), "lang")
        .where((F.col("n") <= sample_per_language) | (F.col("draw") < share))
        .groupBy("lang", "draw")
        .agg(F.min("text").alias("text"))  # copies of a text are one place of the sample
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
        .where(F.col("place") <= sample_per_language)
        .select("lang", "text")
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        counted = [c for c in map(gram_counts, rows["text"].sort_values()) if c is not None]
        if not counted:
            return pd.DataFrame({"lang": [], "centre": []})
        vectors = np.zeros((len(counted), DIMENSIONS), dtype=np.float32)
        for vector, found in zip(vectors, counted, strict=True):
            places, values = gram_vector(found, idf)
            vector[places] = values
        centres = cluster(vectors, centroids)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centre": list(centres.astype(np.float32))})

    schema = "lang string, centre array<float>"
    rows = sorted(sample.groupBy("lang").applyInPandas(fit, schema).collect(), key=lambda r: r[0])
    centres = np.array([row["centre"] for row in rows], dtype=np.float32).reshape(-1, DIMENSIONS)
    model = LanguageModel([row["lang"] for row in rows], centres, idf, {})
    model.floors = size_floors(labelled, model, strictness)
    return model


def size_floors(
    labelled: DataFrame, model: LanguageModel, strictness: float
) -> dict[str, np.ndarray]:
    """The lowest cosines accepted by language and size of text, from all `labelled (text, lang)`.

    Each language has a floor for each of its sizes, `strictness` times the first percentile
    of the cosines to its own centroids; sizes of few texts share one with their neighbours.
    Within a language a shorter text may be as far as a longer one. A size without texts has the
    floor of the next longer one, those beyond the longest text the floor of the longest.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[int]] = defaultdict(list)
        for i, lang in enumerate(shared.value.languages):
            own[lang].append(i)
        centres = {lang: shared.value.centroids[places] for lang, places in own.items()}
        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                counts = gram_counts(text.as_py())
                if counts is None or lang.as_py() not in centres:
                    continue
                places, values = gram_vector(counts, shared.value.idf)
                cosine = float((centres[lang.as_py()][:, places] @ values).max())
                step = min(COSINE_STEPS, max(0, int(cosine * COSINE_STEPS)))
                found[lang.as_py(), size_bin(counts), step] += 1
        yield pa.RecordBatch.from_pylist(
            [{"lang": lang, "bin": i, "step": step, "n": n} for (lang, i, step), n in found.items()],
            pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("step", pa.int32()), ("n", pa.int64())]),
        )

    def quantiles(rows: pd.DataFrame) -> pd.DataFrame:
        steps = np.zeros((SIZE_BINS, COSINE_STEPS + 1), dtype=np.int64)
        np.add.at(steps, (rows["bin"], rows["step"]), rows["n"])
        groups: list[list[int]] = [[]]
        for i in np.flatnonzero(steps.sum(axis=1))[::-1]:
            if steps[groups[-1]].sum() >= LEAST_TEXTS:
                groups.append([])
            groups[-1].append(int(i))
        if len(groups) > 1 and steps[groups[-1]].sum() < LEAST_TEXTS:
            groups[-2:] = [groups[-2] + groups[-1]]
        floors = []
        for group in groups:
            sums = steps[group].sum(axis=0).cumsum()
            low = int(np.searchsorted(sums, 0.01 * sums[-1], "right")) / COSINE_STEPS
            floors += [(i, strictness * low) for i in group]
        return pd.DataFrame([(rows["lang"].iloc[0], *f) for f in floors], columns=["lang", "bin", "floor"])

    counted = (
        labelled.mapInArrow(count, "lang string, bin int, step int, n long")
        .groupBy("lang", "bin", "step")
        .agg(F.sum("n").alias("n"))
    )
    found: dict[str, np.ndarray] = {}
    for lang, i, floor in counted.groupBy("lang").applyInPandas(
        quantiles, "lang string, bin int, floor double"
    ).collect():
        found.setdefault(lang, np.full(SIZE_BINS, np.inf))[i] = floor
    for lang, floors in found.items():
        longest = floors[np.isfinite(floors)][-1]
        lowest = np.minimum.accumulate(floors[::-1])[::-1]
        found[lang] = np.where(np.isinf(lowest), longest, lowest)
    return found


def identify(docs: DataFrame, text: Column, model: LanguageModel, name: str = "language") -> DataFrame:
    """`docs` with a column `struct<lang, score, rejected>` from the text alone.

    Score is the cosine to the nearest centroid, of equally near ones that of the first
    language by code point. Null texts and texts without letters are `und` with score 0 and
    rejected, others are rejected if even the nearest centroid is too far. Every row of
    `docs` comes back, repeated ones and empty tables included; a column called as `name`
    is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [shared.value.nearest(text) for text in texts],
                columns=["lang", "score", "rejected"],
            )

    return docs.withColumn(name, nearest(text))
