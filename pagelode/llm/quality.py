"""Quality classifier by co-training a view of the text and a view of the metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import SPACED_WORD, stored

TEXT_FEATURES, META_FEATURES = 1 << 14, 1 << 10
VIEWS = ("text", "meta")
#: Labelled rows in so many are kept for calibration and never fitted.
FOLDS = 4
#: Fewer rows of either label teach nothing.
LEAST_ROWS = 8
#: Margins are calibrated in so many bins for each 1, and those beyond the most count as it.
MARGIN_BINS, MOST_MARGIN = 64, 64.0


def with_views(docs: DataFrame) -> DataFrame:
    """`docs (content, metadata, chars, …)` with the feature vectors `text` and `meta`.

    The text view hashes words and has shares of distinct words, letters, capitals and
    digits, and the mean length of a word. The metadata view hashes each entry of the array
    `metadata` with its place, and the logarithm of `chars`. Nulls are values of their own;
    no feature of one view is in the other.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(SPACED_WORD), 0)
    log = F.floor(F.log2(F.greatest(F.lit(1.0), F.col("chars")))).cast("string")
    tokens = F.transform(
        F.array_append("metadata", log),
        lambda value, i: F.concat_ws("=", i, F.coalesce(value, F.lit("\x00null"))),
    )

    count = F.greatest(F.lit(1), F.length(text))

    def share(pattern: str) -> Column:
        return (count - F.length(F.regexp_replace(text, pattern, ""))) / count

    docs = docs.withColumns({
        "_words": words,
        "_tokens": tokens,
        "_letters": share(r"\p{L}"),
        "_capitals": share(r"\p{Lu}"),
        "_digits": share(r"[0-9]"),
    }).withColumns({
        "_distinct": F.size(F.array_distinct("_words")) / F.greatest(F.lit(1), F.size("_words")),
        "_length": F.least(F.lit(1.0), count / F.greatest(F.lit(1), F.size("_words")) / 20),
    })
    docs = HashingTF(numFeatures=TEXT_FEATURES, binary=True, inputCol="_words", outputCol="_hashed").transform(docs)
    docs = HashingTF(numFeatures=META_FEATURES, binary=True, inputCol="_tokens", outputCol="meta").transform(docs)
    shares = ["_distinct", "_letters", "_capitals", "_digits", "_length"]
    docs = VectorAssembler(inputCols=[*shares, "_hashed"], outputCol="text").transform(docs)
    return docs.drop("content", "metadata", "chars", "_words", "_tokens", "_hashed", *shares)


@dataclass
class View:
    """One view's classifier and its calibration: probability = sigmoid(slope * margin + shift)."""

    model: LogisticRegressionModel
    name: str
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, rows: DataFrame, name: str) -> DataFrame:
        """`rows` with the calibrated log-odds of the view."""
        scored = self.model.transform(rows)
        margin = F.get(vector_to_array("_raw"), F.lit(1))
        return scored.withColumn(name, margin * self.slope + self.shift).drop(
            "_raw", "_probability", "_prediction"
        )


@dataclass
class CoModel:
    views: dict[str, View]
    prior: float

    def score(self, rows: DataFrame) -> DataFrame:
        """`rows` with `p_text`, `p_meta` and their combination `score`.

        Log-odds of the two views add up, less those of the prior, which both contain.
        """
        if not self.views:
            return rows.withColumns(dict.fromkeys(("p_text", "p_meta", "score"), F.lit(self.prior)))
        for name, view in self.views.items():
            rows = view.logit(rows, f"_{name}")
        both = F.col("_text") + F.col("_meta") - F.log(F.lit(self.prior / (1 - self.prior)))
        return rows.withColumns({
            "p_text": _sigmoid(F.col("_text")),
            "p_meta": _sigmoid(F.col("_meta")),
            "score": _sigmoid(both),
        }).drop("_text", "_meta")


def _sigmoid(logit: Column) -> Column:
    return F.round(1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), logit)))), 6)


def _fit(rows: DataFrame, view: str, label: str) -> View:
    learner = LogisticRegression(
        featuresCol=view,
        labelCol=label,
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        predictionCol="_prediction",
        regParam=0.003,
        maxIter=40,
        aggregationDepth=2,
    )
    model = learner.fit(rows.where(F.col(label).isNotNull() & (F.col("fold") != 0)))
    return View(model, view)


def _calibrate(view: View, rows: DataFrame) -> View:
    """Platt scaling on labelled rows that no view is fitted on.

    Margins are counted by label in bins of 1 / MARGIN_BINS, up to MOST_MARGIN either way, so the
    driver gets a bounded table in one job, and each bin's mean margin stands for its rows.
    """
    held = view.logit(rows.where("label is not null and fold = 0"), "_margin")
    margin = F.greatest(F.lit(-MOST_MARGIN), F.least(F.lit(MOST_MARGIN), F.col("_margin")))
    bins = (
        held.select("label", margin.alias("margin"))
        .groupBy("label", F.floor(F.col("margin") * MARGIN_BINS).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("margin").alias("margin"))
        .collect()
    )
    table = np.array([(row["label"], row["margin"], row["n"]) for row in sorted(bins)])
    slope, shift = platt(*table.T)
    return View(view.model, view.name, max(0.0, slope), shift)


def platt(
    labels: np.ndarray, margins: np.ndarray, counts: np.ndarray, penalty: float = 0.001
) -> tuple[float, float]:
    """Slope and shift of the sigmoid that explains the labels best, by Newton's method.

    The mean log-loss of `counts` rows each, and half the penalty times the squared slope on
    standardised margins. Equal margins have slope 0.
    """
    weights, total = counts / counts.sum(), counts.sum()
    mean = weights @ margins
    spread = np.sqrt(weights @ (margins - mean) ** 2 * total / max(1.0, total - 1))
    inputs = np.stack([(margins - mean) / (spread or 1.0), np.ones(len(margins))], axis=1)
    ridge = np.array([penalty, 0.0])

    def loss(own: np.ndarray) -> float:
        logits = inputs @ own
        return weights @ (np.logaddexp(0, logits) - labels * logits) + ridge @ own**2 / 2

    found = np.zeros(2)
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(inputs @ found, -500, 500)))
        slopes = inputs.T @ (weights * (chance - labels)) + ridge * found
        curves = (inputs.T * (weights * chance * (1 - chance))) @ inputs + np.diag(ridge + 1e-12)
        step = np.linalg.solve(curves, slopes)
        while loss(found - step) > loss(found) and np.abs(step).max() > 1e-9:
            step /= 2
        found = found - step
        if np.abs(step).max() <= 1e-9:
            break
    slope = float(found[0] / spread) if spread else 0.0
    return slope, float(found[1] - slope * mean)


def co_train(rows: DataFrame, rounds: int = 3, confident: float = 0.95) -> CoModel:
    """A model from `rows (key, label, text, meta)` whose rows without label are unlabelled.

    In each round both views are fitted on their labels and calibrated on a held-out quarter of
    the true ones. Then each scores all unlabelled rows, and those of which it is sure, with
    `confident` or more for either class, are labelled for the other view in the next round.
    `rows` should be stored: pseudo-labels are not written, but worked out from the models of
    the round before where a view is fitted. With fewer than LEAST_ROWS rows of a class,
    fitted or held out, the model is the share of good labels (half, if there are none).
    """
    fold = F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = rows.withColumn("fold", F.when(F.col("label").isNotNull(), fold).otherwise(F.lit(1)))
    counts = rows.where("label is not null").groupBy("label", F.expr("fold = 0")).count().collect()
    known = {label: sum(n for other, _, n in counts if other == label) for label in (0.0, 1.0)}
    prior = (known[1.0] + 1) / (known[0.0] + known[1.0] + 2)
    if len([n for *_, n in counts if n >= LEAST_ROWS]) < 4:
        return CoModel({}, prior)
    told = rows.withColumns({f"y_{name}": F.col("label") for name in VIEWS})
    for number in range(rounds):
        views = {name: _calibrate(_fit(told, name, f"y_{name}"), rows) for name in VIEWS}
        if number + 1 < rounds:
            told = _exchanged(rows, views, confident)
    return CoModel(views, prior)


def _exchanged(rows: DataFrame, views: dict[str, View], confident: float) -> DataFrame:
    """`rows` with what the other view is sure of as the labels `y_text` and `y_meta`."""
    sure = F.log(F.lit(confident / (1 - confident)))
    for name, view in views.items():
        rows = view.logit(rows, f"_{name}")
    given = {
        f"y_{other}": F.coalesce(
            "label",
            F.when(F.col(f"_{name}") >= sure, 1.0).when(F.col(f"_{name}") <= -sure, 0.0),
        )
        for name, other in (VIEWS, VIEWS[::-1])
    }
    return rows.withColumns(given).drop("_text", "_meta")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: list[str] | None = None,
    size_col: str | None = "n_chars",
    label_col: str = "quality",
    labelled_rows: int = 20_000,
    rounds: int = 3,
) -> DataFrame:
    """One row `(id, p_text, p_meta, score, good)` for each document.

    About `labelled_rows` labels at most, chosen by hashes of their ids, count; they are a
    broadcast of that bound. All other documents are unlabelled rows: each view scores all of
    them in every round, and learns from all that the other view is sure of. The features of
    all documents are written once and read for fits and scores; no text is shuffled.

    Labels other than 0 and 1, and null ids of labels, teach nothing; if the labels of an id
    disagree, the most frequent counts, 1 on a tie. A document without id is scored and not
    learned from; null texts are empty, null metadata a value of its own; repeated rows are
    scored each. An empty table gives no rows. Extra columns are ignored.
    """
    meta_cols = ["source", "lang"] if meta_cols is None else meta_cols
    own = docs.select(
        F.col(id_col).alias("key"),
        F.col(text_col).alias("content"),
        F.array(*(F.col(name).cast("string") for name in meta_cols)).cast("array<string>").alias("metadata"),
        (F.col(size_col) if size_col else F.lit(None)).cast("double").alias("chars"),
    )
    draw = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 40))
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("key"))
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    )
    there = known.count()
    known = known.where(draw < (1 << 40) * labelled_rows // max(1, there, labelled_rows))
    rows = with_views(own.join(F.broadcast(known), "key", "left"))
    rows = stored(rows.select("key", "label", "text", "meta"), "features")
    return co_train(rows, rounds).score(rows).select(
        F.col("key").alias("id"), "p_text", "p_meta", "score", (F.col("score") >= 0.5).alias("good")
    )
