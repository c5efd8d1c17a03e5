"""Repeated passages by difference-cover anchors."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.llm.common import key_columns, stored

WINDOW_WORDS = 35
PERIOD = 21
# A perfect difference set modulo 21. Every difference of two positions
# modulo 21 is a difference of two members.
COVER = (3, 6, 7, 12, 14)
# Odd multipliers of the two rolling hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KNOWN_WORDS = 200_000
# Positions hashed at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 18


class _Digests(dict):
    """128-bit hash of each word seen, emptied when it has grown too large."""

    def __missing__(self, word):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        digest = self[word] = xxhash.xxh3_128_digest(word)
        return digest


class _Rolling:
    """Window hashes of word sequences, by prefix sums modulo 2**64."""

    def __init__(self, window):
        self.window, n = window, PIECE + window
        self.powers = [np.cumprod(np.r_[np.uint64(1), np.full(n, m, np.uint64)]) for m in MULTIPLIERS]
        self.inverse = [
            np.cumprod(np.r_[np.uint64(1), np.full(n, pow(m, -1, 1 << 64), np.uint64)]) for m in MULTIPLIERS]
        self.digests = _Digests()

    def pieces(self, words):
        """``(first start, hash, hash)`` for consecutive runs of window starts."""
        for first in range(0, len(words) - self.window + 1, PIECE):
            part = words[first:first + PIECE + self.window - 1]
            both = np.frombuffer(b"".join(map(self.digests.__getitem__, part)), "<u8").reshape(-1, 2)
            n, out = len(part), []
            for half in (0, 1):
                sums = np.r_[np.uint64(0), np.cumsum(both[:, half] * self.powers[half][:n])]
                count = n - self.window + 1
                out.append((sums[self.window:] - sums[:count]) * self.inverse[half][:count])
            yield first, out[0], out[1]


def _candidates(n_words, unique_anchors, window):
    """Starts of the windows that hold an anchor found elsewhere too, in order."""
    size = window - PERIOD + 1
    if n_words < window:
        return np.empty(0, np.int64)
    repeated = np.zeros(n_words - size + 1, bool)
    for member in COVER:
        repeated[member::PERIOD] = True
    repeated[unique_anchors] = False
    # Anchors of the window at s start in s .. s + PERIOD - 1.
    before = np.r_[0, np.cumsum(repeated)]
    return np.flatnonzero(before[PERIOD:] > before[:-PERIOD])


def _anchors(docs, window):
    size = window - PERIOD + 1
    offsets = np.array(COVER)

    def emit(batches):
        rolling = _Rolling(size)
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) < window:
                    continue
                for first, hashes, _ in rolling.pieces(words):
                    at = np.arange(first - first % PERIOD, first + len(hashes), PERIOD)[:, None] + offsets
                    at = at[(at >= first) & (at < first + len(hashes))]
                    yield _located(batch, i, at, hashes[at - first])

    return docs.mapInArrow(_full_batches(emit), "h1 long, key_id long, key_hash long, position int")


def _located(batch, i, at, *hashes):
    n = len(at)
    columns = [pa.array(h.view(np.int64)) for h in hashes]
    columns += [pa.array(np.full(n, batch.column(k)[i].as_py(), np.int64)) for k in (0, 1)]
    columns.append(pa.array(at.astype(np.int32)))
    names = ["h1", "h2"][:len(hashes)] + ["key_id", "key_hash", "position"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _full_batches(emit):
    """Join the small batches of single documents, so that fewer are sent."""

    def run(batches):
        held, n = [], 0
        for batch in emit(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= 100_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _found_once(found, hashes, name):
    """Per document: the positions whose hash occurs at no other place.

    A hash that many places share leaves each map task as one row.
    """
    once = (
        found.groupBy(*hashes)
        .agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("key_id", "key_hash", "position")])
        .filter("n = 1")
    )
    return stored(once.groupBy("key_id", "key_hash").agg(F.collect_list("position").alias(name)), name)


def _windows(docs, window):
    def emit(batches):
        rolling = _Rolling(window)
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").split()
                at = _candidates(len(words), _positions(batch.column(3)[i]), window)
                if not len(at):
                    continue
                for first, h1, h2 in rolling.pieces(words):
                    here = at[(at >= first) & (at < first + len(h1))]
                    if len(here):
                        yield _located(batch, i, here, h1[here - first], h2[here - first])

    return docs.mapInArrow(_full_batches(emit), "h1 long, h2 long, key_id long, key_hash long, position int")


def _positions(scalar):
    """The numbers of a list value; none for null."""
    values = scalar.values
    return np.empty(0, np.int64) if values is None else values.to_numpy().astype(np.int64)


def _removed(words, unique_anchors, unique_windows, window):
    """For each word, whether a window that starts elsewhere too covers it."""
    starts = np.zeros(max(0, len(words) - window + 1), bool)
    starts[_candidates(len(words), unique_anchors, window)] = True
    starts[unique_windows] = False
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step)[:-1] > 0


def remove_repeated_passages(docs: DataFrame, window=WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every document.

    A window is ``window`` consecutive words of one document; a word goes if a window
    over it starts at any other place too, in the same or another document.

    Anchors of ``window - 20`` words are hashed at the positions of a difference cover
    modulo 21. Whatever the two places of a repeated window, one offset of it is a
    cover position at both, so its two anchors agree. Positions whose anchor occurs
    once in the corpus are returned to their documents; all windows over the other
    anchors are candidates. Each match is extended by a 128-bit hash of the whole
    window, and again only the places found once are returned. Places are counted by
    aggregation, so neither pairs nor lists of places of one passage are built.

    Words are split at ASCII white space and compared as they are. A null or empty
    text has no words; a text shorter than the window loses none. Repeated rows are
    separate documents: their windows count as found elsewhere. Null ids are kept.
    Extra columns are not read.
    """
    texts = docs.select(*key_columns(), F.col("text").cast("binary").alias("text"))
    anchors = _found_once(_anchors(texts, window), ["h1"], "unique_anchors")
    keys = ["key_id", "key_hash"]
    with_anchors = texts.join(anchors, keys, "left").select(*keys, "text", "unique_anchors")
    windows = _found_once(_windows(with_anchors, window), ["h1", "h2"], "unique_windows")

    def cut(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or b"").split()
                gone = _removed(words, _positions(batch.column(2)[i]), _positions(batch.column(3)[i]), window)
                kept = [w for w, g in zip(words, gone) if not g] if gone.any() else words
                out.append((len(words), int(gone.sum()), b" ".join(kept)))
            n, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    full = docs.select("doc_id", *key_columns(), F.col("text").cast("binary").alias("text"))
    return (
        full.join(anchors, keys, "left").join(windows, keys, "left")
        .select(F.col("doc_id").cast("long"), "text", "unique_anchors", "unique_windows")
        .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
        .select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
    )


def repeated_passages(docs: DataFrame, window=WINDOW_WORDS) -> DataFrame:
    """The digest of :func:`remove_repeated_passages`: kept words as SHA-256."""
    return remove_repeated_passages(docs, window).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
