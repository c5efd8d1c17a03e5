"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on a block-max inverted index."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.llm.common import dropped, in_fold, known_labels, learnable, normal_words, smallest_hashes, stored

FOLDS, HELD_OUT = 4, 2
PER_CLASS = 3000
# A term is a word's first characters, so inflected words meet; a shorter word is its own term.
STEM_CHARS = 4
# Chosen, with the stems, by the votes of learned examples each left out of its own vote.
IDF_POWER = 2
KNOWN_WORDS = 300_000
NEIGHBOURS = 40
THRESHOLD = 0.3
# Examples in a block of a posting list, blocks scored before the others are judged, and queries side by side.
BLOCK, STEP, QUERIES = 64, 16, 32
# The longest posting lists are held in full, zeros included, up to so many bytes.
FULL_BYTES = 32 << 20


def stem(word: bytes) -> bytes:
    return word if len(word) <= STEM_CHARS else word.decode()[:STEM_CHARS].encode()


class _Wanted(dict):
    """Number of the term of each word seen, -1 for an unknown one; emptied when it has grown too large."""

    def __init__(self, terms):
        self.number = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = self.number.get(stem(word), -1)
        return found

    def __reduce__(self):
        return _Wanted, (list(self.number),)

    def held(self, text: bytes):
        """The set of wanted terms in a whole text."""
        return set(map(self.__getitem__, set(normal_words(text)))) - {-1}

    def count(self, text: bytes):
        """Numbers of the wanted terms in a whole text, ascending, and how often it holds each."""
        found = Counter(map(self.__getitem__, normal_words(text)))
        found.pop(-1, None)
        terms = np.fromiter(sorted(found), np.int64, len(found))
        return terms, np.fromiter(map(found.__getitem__, terms.tolist()), np.int64, len(found))


class Index:
    """Posting lists of weighted terms over the examples, with the largest weight in each block.

    Lists of common terms are rows in a table of each block; the others name their examples.
    """

    def __init__(self, vectors, n_terms):
        """``vectors``: unit vectors of the examples as ``(term numbers, weights)``."""
        self.n = len(vectors)
        self.n_blocks = -(-self.n // BLOCK)
        width = self.n_blocks * BLOCK
        example = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors] or [[]]).astype(np.int32)
        weight = np.concatenate([w for _, w in vectors] or [[]]).astype(float)
        length = np.bincount(term, minlength=n_terms)
        # A list that names more than an eighth of the examples is shorter in full.
        common = np.argsort(-length, kind="stable")[:FULL_BYTES // (8 * max(width, 1))]
        common = common[8 * length[common] > self.n]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        in_full = self.row[term] >= 0
        table = np.zeros((len(common), width))
        table[self.row[term[in_full]], example[in_full]] = weight[in_full]
        # Block by block, so that scoring one reads one piece of memory.
        self.table = np.ascontiguousarray(table.reshape(len(common), self.n_blocks, BLOCK).transpose(1, 0, 2))
        self.largest = self.table.max(axis=2, initial=0)
        term, example, weight = term[~in_full], example[~in_full], weight[~in_full]
        order = np.argsort(term, kind="stable")
        self.examples, self.weights = example[order], weight[order]
        length[common] = 0
        self.starts = np.r_[0, np.cumsum(length)]

    def _named(self, terms, weights):
        """What the lists that name their examples add to the cosines, as blocks."""
        first, length = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        total = int(length.sum())
        at = np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(total) if total else np.empty(0, np.int64)
        products = np.repeat(weights, length) * self.weights[at]
        return np.bincount(self.examples[at], products, self.n_blocks * BLOCK).reshape(self.n_blocks, BLOCK)

    def nearest(self, vectors, k, leave_out=None):
        """For each query the ``k`` most similar examples and their cosines; of equal ones those first in the index.

        ``leave_out`` names an example that a query may not find, or -1. The upper bound of
        a block is the query's weights times the largest weights of the block for the lists
        in full, and the largest sum of the others. Each query scores the ``STEP`` blocks
        with the highest bounds, and then those whose bound reaches its k-th cosine so far;
        no other block can hold a nearer example. Queries that want the same block are
        scored together.
        """
        if not len(vectors) or not self.n:
            return [(np.empty(0, np.int64), np.empty(0))] * len(vectors)
        queries = np.zeros((len(vectors), self.table.shape[1]))
        named = np.empty((len(vectors), self.n_blocks, BLOCK))
        for i, (terms, weights) in enumerate(vectors):
            rows = self.row[terms]
            queries[i, rows[rows >= 0]] = weights[rows >= 0]
            named[i] = self._named(terms[rows < 0], weights[rows < 0])
        bounds = named.max(axis=2) + queries @ self.largest.T
        scores = np.zeros(named.shape)

        def visit(wanted):
            for block in np.flatnonzero(wanted.any(axis=0)):
                some = np.flatnonzero(wanted[:, block])
                scores[some, block] = np.round(named[some, block] + queries[some] @ self.table[block], 9)
            for i in np.flatnonzero(wanted.any(axis=1)):
                if leave_out is not None and leave_out[i] >= 0:
                    scores[i].ravel()[leave_out[i]] = 0.0

        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, np.argpartition(-bounds, min(STEP, self.n_blocks) - 1, axis=1)[:, :STEP], True, axis=1)
        visit(first & (bounds > 0))
        flat = scores.reshape(len(vectors), -1)
        least = np.partition(flat, -k, axis=1)[:, -k] if flat.shape[1] > k else np.zeros(len(vectors))
        # A bound may fall short of the exact cosine by rounding only.
        visit(~first & (bounds > 0) & (bounds >= least[:, None] - 1e-9))
        out = []
        for row, low in zip(flat, least):
            best = np.flatnonzero((row > 0) & (row >= low))
            best = best[np.lexsort((best, -row[best]))[:k]]
            out.append((best, row[best]))
        return out


class Model:
    """Terms, their weights, the index, and the map from votes to probabilities."""

    def __init__(self, terms, idf, ids, labels, counts, share):
        """``counts``: for each example the numbers of its terms, ascending, and how often it holds them."""
        self.wanted, self.idf = _Wanted(terms), np.array(idf)
        # Like vectors stand together, so that the largest weights of a block say much.
        vectors = [self._vector(*c) for c in counts]
        # Big-endian bytes sort as the numbers do.
        order = sorted(range(len(ids)), key=lambda i: (
            vectors[i][0].astype(">i4").tobytes(), vectors[i][1].astype(">f8").tobytes(), ids[i]))
        vectors, ids, labels = [vectors[i] for i in order], ids[order], labels[order]
        self.ids, self.labels = ids, labels
        self.index = Index(vectors, len(terms))
        # Each label weighs as much as it does among all labelled documents.
        n = np.bincount(labels, minlength=2)
        self.class_weight = np.array([(1 - share) / max(n[0], 1), share / max(n[1], 1)])
        votes = np.array([v for v, _, _ in self._votes(vectors, np.arange(len(vectors)))])
        self._calibrate(votes, labels)

    def _vector(self, terms, counts):
        weights = counts * self.idf[terms]
        return terms, weights / (np.sqrt(weights @ weights) or 1.0)

    def _votes(self, vectors, leave_out=None):
        """Of each query the share of label 1 among the nearest, weighted by nearness, and these; NaN without any."""
        for start in range(0, len(vectors), QUERIES):
            left = None if leave_out is None else leave_out[start:start + QUERIES]
            for near, cosines in self.index.nearest(vectors[start:start + QUERIES], NEIGHBOURS, left):
                if not len(near):
                    yield np.nan, near, cosines
                    continue
                weight = cosines / (1.001 - cosines) * self.class_weight[self.labels[near]]
                yield round(float(weight @ self.labels[near] / weight.sum()), 6), near, cosines

    def _calibrate(self, votes, labels):
        """Pool adjacent violators over the left-out votes, so that more votes never mean less."""
        weight = self.class_weight[labels]
        lone = np.isnan(votes)
        total = weight[lone].sum()
        self.alone = float((weight[lone] @ labels[lone] + 1e-6) / (total + 1e-4)) if total else 0.0
        order = np.argsort(votes[~lone], kind="stable")
        pools = []
        for x, y, w in zip(votes[~lone][order], labels[~lone][order], weight[~lone][order]):
            pools.append([x, y * w, w])
            while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2] or pools[-2][0] == pools[-1][0]):
                _, a, b = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + a, pools[-1][2] + b]
        self.vote_points = np.array([p[0] for p in pools] or [0.0])
        self.chances = np.array([p[1] / p[2] for p in pools] or [self.alone])

    def score(self, texts):
        """Probability of label 1 and the nearest examples of each whole text."""
        for vote, near, cosines in self._votes([self._vector(*self.wanted.count(t)) for t in texts]):
            yield self.alone if np.isnan(vote) else float(np.interp(vote, self.vote_points, self.chances)), near, cosines


def _examples(docs, labels, per_class):
    """``doc_id, label, text`` of at most ``per_class`` different texts of each label.

    Equal texts are one example before the draw, under their smallest id, so copies
    neither add to a word nor take places.
    """
    key = F.xxhash64("text").alias("key")
    texts = (
        docs.select("doc_id", key).join(known_labels(labels, "toxic", FOLDS, HELD_OUT), "doc_id")
        .groupBy("key", "label").agg(F.min("doc_id").alias("doc_id"))
    )
    texts = stored(texts, "texts")
    chosen = stored(smallest_hashes(texts, per_class), "chosen")
    examples = stored(
        docs.select("doc_id", "text", key).join(F.broadcast(chosen), ["doc_id", "key"])
        .dropDuplicates(["key", "label"]).select("doc_id", "label", "text"), "examples")
    dropped(texts, chosen)
    return examples


def _document_frequencies(docs, wanted, n_terms):
    """Number of documents, over the whole corpus, that hold each term, and of all documents."""

    def count(batches):
        total = Counter()
        for batch in batches:
            total[-1] += batch.num_rows
            for text in batch.column(0):
                total.update(wanted.value.held(text.as_py() or b""))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = (
        docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "term int, n long")
        .groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    )
    # Number -1 is the last place.
    found = np.zeros(n_terms + 1, np.int64)
    found[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return int(found[-1]), found[:-1]


def fit(docs: DataFrame, labels: DataFrame, per_class=PER_CLASS):
    """Learn from at most ``per_class`` different texts of each label; None if one label is missing.

    The dimensions are the stems of all words of these texts. Document frequencies are
    counted over the whole corpus.
    """
    sample = _examples(docs, labels, per_class)
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        dropped(sample)
        return None

    @F.pandas_udf("array<binary>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(set(map(stem, set(normal_words(t or b""))))))

    text = F.col("text").cast("binary")
    terms = sorted(sample.select(F.explode(find(text)).alias("term")).distinct().toArrow()["term"].to_pylist())
    wanted = docs.sparkSession.sparkContext.broadcast(_Wanted(terms))
    n, frequencies = _document_frequencies(docs, wanted, len(terms))

    @F.pandas_udf("binary")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.array(wanted.value.count(t or b"")).astype(np.int32).tobytes())

    # Numbers of the terms, not texts, come to the driver.
    rows = sample.select("doc_id", "label", count(text).alias("terms")).orderBy("doc_id", "label").collect()
    wanted.unpersist()
    dropped(sample)
    share = labels.filter(learnable(FOLDS, HELD_OUT)).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    # Common terms get the smallest numbers, so texts of one language stand together in the index.
    order = np.argsort(-frequencies, kind="stable")
    renamed = np.empty(len(terms), np.int64)
    renamed[order] = np.arange(len(terms))
    counts = []
    for held, times in (np.frombuffer(r.terms, np.int32).reshape(2, -1) for r in rows):
        place = np.argsort(renamed[held])
        counts.append((renamed[held][place], times[place]))
    idf = np.log((1 + n) / (1 + frequencies[order])) ** IDF_POWER
    ids = np.array([r.doc_id for r in rows], np.int64)
    return Model([terms[i] for i in order], idf, ids, np.array([r.label for r in rows], np.int64), counts, share)


def score_toxicity(docs: DataFrame, model, n_evidence=3) -> DataFrame:
    """All columns of ``docs`` and ``found``: ``score`` and the nearest examples as ``evidence``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<struct<doc_id:long,label:int,similarity:double>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        if model is None:
            return pd.DataFrame({"score": [0.0] * len(texts), "evidence": [[]] * len(texts)})
        out = []
        for value, near, cosines in model.score([t or b"" for t in texts]):
            out.append((value, [
                {"doc_id": int(model.ids[i]), "label": int(model.labels[i]), "similarity": float(c)}
                for i, c in zip(near[:n_evidence], cosines)]))
        return pd.DataFrame(out, columns=["score", "evidence"])

    return docs.withColumn("found", score(F.col("text").cast("binary")))


def toxicity(docs: DataFrame, labels: DataFrame, per_class=PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every document.

    The nearest labelled examples by TF-IDF cosine vote, weighted by nearness and by
    their label's weight in the corpus. Votes become probabilities by an isotonic map
    learned on the examples, each left out of its own vote. Ties go to the example that
    stands first in the index, which is sorted by vector and id.

    A term is a word's first ``STEM_CHARS`` characters, weighed by its count times the
    square of the logarithm of ``(1 + documents) / (1 + documents that hold it)``.

    A text without any term of the examples, so also a null or empty one, gets the probability
    of such texts among the examples. If a label is missing among the learnable rows all
    scores are 0. Documents labelled both ways, null labels and null ids are not learned
    from. Repeated rows are scored each. Extra columns are not read.
    """
    found = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels, per_class))
    return found.select(
        "doc_id", in_fold(FOLDS, HELD_OUT).alias("held_out"), "found.score",
        (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), "found.evidence")
