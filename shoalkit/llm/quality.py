"""Quality scores learned from preference pairs (Bradley-Terry)."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.llm.common import in_fold, labelled_sample, learnable, stored

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 3000
PAIRS = 40_000
THRESHOLD = 0.3
PENALTY = 1e-3
# Digits of a raw score, so that equal documents agree; histogram bins and rows fetched in the search for a quantile.
DIGITS, BINS, FETCHED = 9, 1024, 10_000
# Classes of characters whose shares are features.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"|", b"#*$%&<>", b"!?",
    b".", b",", b"@+()-_/\\=:;\"'[]{}~^`",
)


def features(text: bytes):
    """Measures of one whole text, 0 where undefined."""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = [counts[np.frombuffer(c, np.uint8)].sum() / n for c in CLASSES] + [counts[128:].sum() / n]
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    pairs = set(zip(words, words[1:]))
    return shares + [np.sqrt(s) for s in shares] + [
        np.log1p(len(words)), np.log1p(len(words)) ** 2 / 10, n / n_words / 10,
        len(set(words)) / n_words, len(pairs) / n_words,
        1 - len(set(lines)) / n_lines, np.log1p(len(words) / n_lines), float(len(words) < 50),
    ]


class Ranker:
    """Scores whose differences are the log odds that one document is preferred to another."""

    def __init__(self, rows, labels, share_low, pairs=PAIRS):
        """``rows``: features, ``labels``: 1 preferred to 0, ``share_low``: share of label 0 in the corpus."""
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
        scaled = (rows - self.mean) / self.scale
        high, low = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        draw = np.random.default_rng(7)
        better = scaled[draw.choice(high, pairs)] - scaled[draw.choice(low, pairs)]
        self.weights = np.zeros(rows.shape[1])
        # Newton steps on the logistic loss of the differences.
        for _ in range(25):
            doubt = 1 / (1 + np.exp(np.clip(better @ self.weights, -30, 30)))
            slope = better.T @ doubt / pairs - PENALTY * self.weights
            curve = (better.T * (doubt * (1 - doubt))) @ better / pairs + PENALTY * np.eye(len(slope))
            step = np.linalg.solve(curve, slope)
            self.weights += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        # The quantile of these rows at the share of low ones, until that of the corpus is known.
        raw = scaled @ self.weights
        weight = np.where(labels == 1, (1 - share_low) / len(high), share_low / len(low))
        order = np.argsort(raw)
        at = np.searchsorted(np.cumsum(weight[order]), share_low)
        self.cut = raw[order[min(at, len(order) - 1)]]

    def raw(self, rows):
        """Scores before the threshold is placed."""
        return np.round((rows - self.mean) / self.scale @ self.weights, DIGITS)

    def score(self, rows):
        """0 to 1; ``THRESHOLD`` at the quantile."""
        raw = self.raw(rows) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def quantile(values: DataFrame, name: str, share: float):
    """The exact value of column ``name`` with the share ``share`` of all rows before it; None without rows.

    Histograms of one bin after the other narrow the range down; only their counts and a
    last range of ``FETCHED`` rows, or of one value however frequent, reach the driver.
    """
    value = F.col(name)
    low, high, n = values.agg(F.min(value), F.max(value), F.count(value)).first()
    rank = min(int(share * n), n - 1)
    while n > FETCHED and low < high:
        bin_ = F.floor((value - low) / (high - low) * (BINS - 1))
        bins = (
            values.filter(value.between(low, high)).groupBy(bin_.alias("bin"))
            .agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).orderBy("bin").collect()
        )
        for low, high, n in (r[1:] for r in bins):
            if rank < n:
                break
            rank -= n
    if not n or low == high:
        return low
    return sorted(r[0] for r in values.filter(value.between(low, high)).select(value).collect())[rank]


def fit(docs: DataFrame, labels: DataFrame, per_class=PER_CLASS):
    """Learn from pairs of at most ``per_class`` documents of each label; None if a label is missing.

    Also returns the share of label 0, at which the threshold belongs.
    """
    chosen = labelled_sample(labels, "quality", FOLDS, HELD_OUT, per_class)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(v) for v in features(t or b"")])

    # Both sides of the bound are known: the labels taken, and the rows after the join.
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "label", measure(F.col("text").cast("binary")).alias("values"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(2 * per_class).collect()
    )
    share = labels.filter(learnable(FOLDS, HELD_OUT)).agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
    found = np.array([r.label for r in rows], np.int64)
    if not (found == 1).any() or not (found == 0).any():
        return None, None
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Ranker(np.array([r["values"] for r in rows]), found, share), share


def quality_scores(docs: DataFrame, labels: DataFrame, per_class=PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Pairs of a document labelled 1 and one labelled 0 are drawn; weights of text
    measures minimise the logistic loss of the feature differences. A document's score
    passes 0.3 where it leaves the share of documents labelled 0 below it, among all
    documents of the table.

    A null text counts as empty; empty texts get a score from their (zero) measures. If
    a label is missing among the learnable rows all scores are 0.5. A document labelled
    both ways is not learned from; null labels and null ids are not either. Repeated rows
    are scored each. Extra columns are not read.
    """
    model, share = fit(docs, labels, per_class)
    held_out = in_fold(FOLDS, HELD_OUT).alias("held_out")
    if model is None:
        return docs.select("doc_id", held_out, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def raw(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.raw(np.array([features(t or b"") for t in texts])) if len(texts) else [], dtype="float64")

    scored = stored(docs.select("doc_id", raw(F.col("text").cast("binary")).alias("raw")), "scores")
    cut = quantile(scored, "raw", share)
    if cut is not None:
        # Half a digit lower, so that the document at the quantile itself passes.
        model.cut = cut - 0.5 * 10 ** -DIGITS
    above = F.col("raw") - F.lit(float(model.cut)) + F.lit(float(np.log(THRESHOLD / (1 - THRESHOLD))))
    score = 1 / (1 + F.exp(-F.greatest(F.least(above, F.lit(30.0)), F.lit(-30.0))))
    return scored.select("doc_id", held_out, score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
