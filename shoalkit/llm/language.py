"""Language identification with n-gram presence kernels, Nyström landmarks and ridge regression."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalkit.llm.common import in_fold, learnable

FOLDS, HELD_OUT = 3, 1
# Documents learned from, over all languages together.
SAMPLE_ROWS = 1200
LANDMARKS = 128
# Every language is learned: from so many documents at least, with as many landmarks.
LEAST = 2
# A document is rejected if its best language scores less than this many times the chance of a guess.
ABOVE_CHANCE = 1.05
ORDERS = (1, 2, 3)
# N-grams are told apart by this many bits.
GRAM_BITS = 16
RIDGE = 1e-2
SHARPNESS = 3.0
BATCH = 64
UNDETERMINED = "und"

_PLACES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_SPACE = np.uint32(32)


def _letters():
    """Letters of the first 65,536 characters as themselves, all else as a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)


_LETTERS = _letters()


def presence(text):
    """Which n-grams a whole text holds, as a bitmap; None for a text without letters.

    Letters are lower-cased, runs of other characters count as spaces.
    """
    if text is None:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    rare = points >= (1 << 16)
    points = _LETTERS[np.minimum(points, 65535)] if not rare.any() else np.where(rare, points, _LETTERS[np.minimum(points, 65535)])
    for point in np.unique(points[rare]).tolist():
        if not chr(point).isalpha():
            points[points == point] = _SPACE
    if not (points != _SPACE).any():
        return None
    points = np.r_[_SPACE, points, _SPACE]
    # Of several spaces in a row one stays.
    points = points[np.r_[True, (points[1:] != _SPACE) | (points[:-1] != _SPACE)]]
    found = np.zeros(1 << GRAM_BITS, bool)
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            break
        code = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            code = (code ^ points[k:k + n]) * _PLACES[k]
            code ^= code >> np.uint32(15)
        found[(code * _PLACES[0]) >> np.uint32(32 - GRAM_BITS)] = True
    return found


class Classifier:
    """Kernel ridge regression, one output per language, on Nyström features of landmarks."""

    def __init__(self, grams, names, labels, landmarks=LANDMARKS):
        """``grams``: bitmaps by row, ``labels``: number of the language in ``names``."""
        self.names = names
        if len(names) < 2:
            return
        # Landmarks alternate between languages.
        rank = np.zeros(len(labels), np.int64)
        for label in range(len(names)):
            rank[labels == label] = np.arange((labels == label).sum())
        chosen = np.lexsort((labels, rank))[:max(landmarks, LEAST * len(names))]
        self.active = np.flatnonzero(grams[chosen].any(axis=0))
        self.landmarks = np.ascontiguousarray(grams[chosen][:, self.active].T.astype(np.float32))
        self.sizes = np.sqrt(grams[chosen].sum(axis=1).astype(np.float32))
        own = self._kernel(grams[chosen][:, self.active].astype(np.float32), grams[chosen].sum(axis=1))
        values, vectors = np.linalg.eigh(own.astype(np.float64))
        use = values > 1e-6 * values.max()
        self.whiten = (vectors[:, use] / np.sqrt(values[use])).astype(np.float32)
        features = np.vstack([
            self._features(grams[i:i + BATCH][:, self.active].astype(np.float32), grams[i:i + BATCH].sum(axis=1))
            for i in range(0, len(grams), BATCH)]).astype(np.float64)
        # Every language weighs the same, however many documents it has.
        weight = 1.0 / np.bincount(labels, minlength=len(names))[labels]
        weight *= len(labels) / weight.sum()
        targets = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
        gram = features.T @ (features * weight[:, None])
        ridge = RIDGE * len(labels) * np.eye(gram.shape[0])
        ridge[-1, -1] = 0
        self.weights = np.linalg.solve(gram + ridge, features.T @ (targets * weight[:, None])).astype(np.float32)

    def _kernel(self, grams, sizes):
        """Shared n-grams over the geometric mean of both numbers of n-grams."""
        return (grams @ self.landmarks) / (np.sqrt(sizes.astype(np.float32))[:, None] * self.sizes)

    def _features(self, grams, sizes):
        found = self._kernel(grams, sizes) @ self.whiten
        return np.hstack([found, np.ones((len(found), 1), np.float32)])

    def classify(self, texts):
        """Language and score of every text."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for start in range(0, len(texts), BATCH):
            bitmaps = [(i, b) for i in range(start, min(start + BATCH, len(texts))) if (b := presence(texts[i])) is not None]
            if not bitmaps or not self.names:
                continue
            if len(self.names) == 1:
                for i, _ in bitmaps:
                    names[i], scores[i] = self.names[0], 1.0
                continue
            grams = np.array([b[self.active] for _, b in bitmaps], np.float32)
            margins = self._features(grams, np.array([b.sum() for _, b in bitmaps])) @ self.weights
            share = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)).astype(np.float64))
            share /= share.sum(axis=1, keepdims=True)
            for (i, _), best, row in zip(bitmaps, margins.argmax(axis=1), share):
                names[i], scores[i] = self.names[best], float(row[best])
        return names, scores


def fit(docs: DataFrame, sample_rows=SAMPLE_ROWS, landmarks=LANDMARKS) -> Classifier:
    """Learn from about ``sample_rows`` documents, the same number of each language.

    With so many languages that fewer than ``LEAST`` documents of each would be taken the
    sample grows by ``LEAST`` a language, and with it the landmarks. Taken are those with the smallest id hashes among the learnable documents with a
    language; their n-gram bitmaps (8 KB each), not their texts, come to the driver.
    """
    known = docs.filter(learnable(FOLDS, HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return Classifier(np.zeros((0, 1 << GRAM_BITS), bool), [], np.zeros(0, np.int64), landmarks)
    per_language = max(LEAST, sample_rows // len(counts))
    sample_rows = max(sample_rows, LEAST * len(counts))
    # Ids with small hashes, a few times as many as are taken, whatever a language's share;
    # the exact choice then ranks these few.
    reach = docs.sparkSession.createDataFrame(
        [(r.lang, min(1.0, (4 * per_language + 40) / r["count"])) for r in counts], "lang string, reach double")
    spread = F.xxhash64("doc_id").cast("double") / 2.0 ** 64 + 0.5
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        known.select("doc_id", "lang").join(F.broadcast(reach), "lang").filter(spread <= F.col("reach"))
        .withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= per_language)
        .groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("lang").alias("other"))
        .filter("lang = other").select("doc_id", "lang")
    )

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (b := presence(t)) is None else np.packbits(b).tobytes())

    # Bounded by sample_rows; repeated rows of one id are cut after the join.
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "lang", packed("text").alias("grams"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grams").limit(sample_rows).collect()
    )
    rows = [r for r in rows if r.grams is not None]
    names = sorted({r.lang for r in rows})
    number = {name: i for i, name in enumerate(names)}
    grams = np.zeros((len(rows), 1 << GRAM_BITS), bool)
    for i, r in enumerate(rows):
        grams[i] = np.unpackbits(np.frombuffer(r.grams, np.uint8))
    return Classifier(grams, names, np.array([number[r.lang] for r in rows], np.int64), landmarks)


def identify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """All columns of ``docs`` and ``found``, a struct ``lang_pred, score``."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("lang_pred string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.value.classify(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("found", classify("text"))


def language_id(docs: DataFrame, sample_rows=SAMPLE_ROWS, landmarks=LANDMARKS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    The kernel of two texts is the number of character n-grams (one to three letters)
    that both hold, over the geometric mean of their numbers. Only texts and languages
    of the learnable folds are learned from. ``score`` is the softmax of the margins.

    A null text or one without a letter is ``und`` with score 0; so is every text if
    nothing can be learned. With one known language that is the answer, with score 1.
    A null id is neither held out nor learned from. Repeated rows get the same answer.
    Extra columns are not read.
    """
    found = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang"), sample_rows, landmarks))
    return found.select("doc_id", in_fold(FOLDS, HELD_OUT).alias("held_out"), "found.lang_pred", "found.score")


def with_known_language(docs: DataFrame, above_chance=ABOVE_CHANCE) -> DataFrame:
    """Rows of ``docs`` whose language is determined.

    Rejected are texts without a letter, null and empty ones among them, and those whose best
    language scores less than ``above_chance`` times one over the number of languages. If
    nothing can be learned, all texts with letters stay. Repeated rows, null ids and all
    columns are kept as they are; an empty table gives no rows.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    classifier = fit(docs.select("doc_id", "text", "lang"))
    if not classifier.names:
        return kept.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select("row.*")
    least = above_chance / len(classifier.names) if len(classifier.names) > 1 else 0.0
    found = identify(kept, classifier)
    return found.filter((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least)).select("row.*")
