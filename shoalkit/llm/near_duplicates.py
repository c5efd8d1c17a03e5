"""Near copies by SimHash: a byte-position inverted index with count filtering."""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.llm.common import stored
from shoalkit.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BYTES = 8
# Shingles whose bits are added up at once.
TALLY_ROWS = 1 << 15
# Rows compared at once inside one posting list.
BLOCK = 1024
# Posting lists up to this length are compared all together, row against row + offset.
SHORT = 64


def fingerprint(text, shingle_words=SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a whole text, as a signed integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, TALLY_ROWS):
        stop = min(n, start + TALLY_ROWS)
        shingles = zip(*(words[start + k:stop + k] for k in range(min(shingle_words, len(words)))))
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle_words=SHINGLE_WORDS) -> DataFrame:
    """All columns of ``docs`` and ``fp``, the fingerprint of ``text``."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle_words)).astype("int64")

    return docs.withColumn("fp", of(F.col("text").cast("binary")))


def _verified(left, right, max_bits):
    """Which pairs are linked: shared positional bytes are tallied, pairs with enough of them verified on bits."""
    differ = left ^ right
    linked = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - max_bits
    linked[linked] = np.bitwise_count(differ[linked]) <= max_bits
    return linked


def _forest(a, b, n):
    """For linked rows: the smallest row each one reaches."""
    roots = np.arange(n)
    while True:
        low = np.minimum(roots[a], roots[b])
        before = roots.copy()
        np.minimum.at(roots, a, low)
        np.minimum.at(roots, b, low)
        roots = roots[roots]
        if np.array_equal(roots, before):
            return roots


def _links(group, prints, max_bits):
    """Verified links inside posting lists as ``(print, smaller print)``, a forest per list."""
    n = len(prints)
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    short = np.repeat(sizes <= SHORT, sizes)
    left, right = [], []
    for offset in range(1, min(SHORT, int(sizes.max(initial=1)))):
        at = np.flatnonzero((of[offset:] == of[:-offset]) & short[offset:])
        if len(at):
            at = at[_verified(prints[at], prints[at + offset], max_bits)]
            left.append(at)
            right.append(at + offset)
    for k in np.flatnonzero(sizes > SHORT):
        for i in range(bounds[k], bounds[k + 1], BLOCK):
            rows = prints[i:min(i + BLOCK, bounds[k + 1])]
            for j in range(i, bounds[k + 1], BLOCK):
                columns = prints[j:min(j + BLOCK, bounds[k + 1])]
                near = _verified(np.repeat(rows, len(columns)), np.tile(columns, len(rows)), max_bits)
                a, b = np.divmod(np.flatnonzero(near), len(columns))
                keep = a + i < b + j
                a, b = a[keep] + i, b[keep] + j
                # Links inside a block pair are reduced at once, so memory stays bounded.
                roots = _forest(a, b, n) if len(a) > 4 * BLOCK else None
                if roots is not None:
                    b = np.flatnonzero(roots != np.arange(n))
                    a = roots[b]
                left.append(a)
                right.append(b)
    if not left:
        return prints[:0], prints[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return prints[:0], prints[:0]
    rows, position = np.unique(np.r_[a, b], return_inverse=True)
    roots = _forest(position[:len(a)], position[len(a):], len(rows))
    moved = roots != np.arange(len(rows))
    return prints[rows[moved]], prints[rows[roots[moved]]]


def links(prints: DataFrame, max_bits=MAX_BITS, key_bytes=4) -> DataFrame:
    """Links between distinct fingerprints ``fp``: a spanning forest of those within ``max_bits``.

    Two fingerprints that differ in ``max_bits`` bits share at least ``8 - max_bits``
    of their 8 positional bytes. So among the first ``max_bits + key_bytes`` positions
    they share at least ``key_bytes``, and the index needs one posting list for each
    choice of ``key_bytes`` of these positions and each content of them. Pairs inside
    a list get their shared positional bytes tallied; those that reach the minimum are
    verified on bits. A list gives at most one link per member, never its pairs.
    """
    postings = []
    for number, chosen in enumerate(combinations(range(max_bits + key_bytes), key_bytes)):
        mask = int.from_bytes(bytes(255 * (p in chosen) for p in range(BYTES)), "big", signed=True)
        postings.append(F.struct(F.lit(number).cast("int").alias("list"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("content")))

    def compare(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            # The last list may go on in the next batch.
            last = (held[0] != held[0][-1]) | (held[1] != held[1][-1])
            done = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if done:
                yield from found([x[:done] for x in held])
                held = [x[done:] for x in held]
        if held is not None and len(held[0]):
            yield from found(held)

    def found(rows):
        number, content, prints = rows
        change = (number[1:] != number[:-1]) | (content[1:] != content[:-1])
        a, b = _links(np.r_[0, np.cumsum(change)], prints, max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return (
        prints.select("fp", F.explode(F.array(*postings)).alias("posting"))
        .select("posting.list", "posting.content", "fp")
        .repartition("list", "content").sortWithinPartitions("list", "content", "fp")
        .mapInArrow(compare, "a long, b long").distinct()
    )


def near_duplicates(docs: DataFrame, max_bits=MAX_BITS, shingle_words=SHINGLE_WORDS, keep=()) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document, and the columns named in ``keep``.

    Fingerprints that differ in at most ``max_bits`` bits are linked; ``component_id``
    is the smallest id in the connected component. Equal texts, hot groups included,
    meet only in the aggregation to distinct fingerprints; links join fingerprints.

    Null and word-less texts have fingerprint zero and are linked like any other. Rows
    with a null id are returned and join components; ``component_id`` is the smallest
    id that is not null, and null if there is none. Repeated rows are returned each.
    An empty table gives no rows. Extra columns are not read unless kept.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text", *keep), shingle_words).drop("text"), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), max_bits))
    classes = (
        distinct.join(roots, distinct.fp == roots.node, "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(classes.join(smallest, "root").select("fp", "component_id", "root"), "classes")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep,
        F.col("root").alias("class"))


def without_near_duplicates(docs: DataFrame, max_bits=MAX_BITS, shingle_words=SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id.

    Rows with a null id stay only if their component has no other. Of equal smallest
    ids the row with the smallest hash stays, and one of rows that are equal in full.
    """
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    marked = docs.withColumn("__row", row)
    found = near_duplicates(marked, max_bits, shingle_words, keep=("__row",))
    entry = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    winners = (
        found.groupBy("class", "doc_id", "__row").agg(F.count("*").alias("n"))
        .groupBy("class").agg(F.min_by(F.struct("doc_id", "__row", "n"), entry).alias("w"))
        .select(F.col("w.doc_id").alias("__id"), F.col("w.__row").alias("__kept"), F.col("w.n").alias("__n"))
    )
    kept = marked.join(winners, (F.col("__row") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    repeated = kept.filter("__n > 1").dropDuplicates(["__row"])
    return kept.filter("__n = 1").unionByName(repeated).select(*docs.columns)
