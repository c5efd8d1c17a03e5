"""Benchmark decontamination by Wu-Manber search over words."""

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.llm.common import normal_words, stored

WINDOW_WORDS = 13
# Words in a block of the shift table.
BLOCK_WORDS = 3
TABLE_BITS = 20
# Benchmark text searched for in one pass, so that what a pass broadcasts is bounded.
PASS_BYTES = 8 << 20
# Document text searched side by side.
PART_BYTES = 4 << 20
# Positions that move through a text side by side.
LANES = 4096
# A document is contaminated if at least one word in this many is hit.
HIT_SHARE = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _combined(ids, size):
    """Hash of ``size`` consecutive word numbers, at the position of the last of them."""
    n = len(ids) - size + 1
    value = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        value = (value ^ ids[k:k + n].astype(np.uint64)) * _MIX
        value ^= value >> np.uint64(29)
    return value


class _Patterns:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, patterns, length):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.rows = np.array([p for p, _ in patterns], np.int64).reshape(-1, length)
        self.items = [items for _, items in patterns]
        farthest = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, farthest, np.uint8)
        for end in range(self.block, length + 1):
            codes = _combined_rows(self.rows[:, end - self.block:end]) >> np.uint64(64 - TABLE_BITS)
            np.minimum.at(self.shift, codes.astype(np.int64), length - end)
        suffix = _combined_rows(self.rows[:, length - self.block:])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def occurrences(self, ids):
        """``(end positions, pattern numbers)`` of all occurrences in ``ids``."""
        if len(ids) < self.length:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = _combined(ids, self.block)
        shifts = self.shift[(codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        # Lanes start evenly; each ends where the next one starts.
        first, last = self.length - 1, len(ids)
        starts = np.unique(np.linspace(first, last, min(LANES, last - first) + 1).astype(np.int64))
        at, stop = starts[:-1].copy(), starts[1:]
        stops = []
        while len(at):
            step = shifts[at - self.block + 1]
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        ends = np.concatenate(stops) if stops else np.empty(0, np.int64)
        # Suffix buckets, then direct comparison of all words.
        key = codes[ends - self.block + 1]
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        found_ends, found = [], []
        for k in range(int((high - low).max(initial=0))):
            some = np.flatnonzero(low + k < high)
            pattern, end = self.order[low[some] + k], ends[some]
            for word in range(self.length):
                same = ids[end - self.length + 1 + word] == self.rows[pattern, word]
                pattern, end = pattern[same], end[same]
            found_ends.append(end)
            found.append(pattern)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_ends), np.concatenate(found)


def _combined_rows(rows):
    value = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        value = (value ^ rows[:, k].astype(np.uint64)) * _MIX
        value ^= value >> np.uint64(29)
    return value


class Searcher:
    """All windows of some benchmark items, compiled for search.

    Words of the items are numbered from 1; every other word is 0 and matches nothing,
    so equal numbers mean equal words.
    """

    def __init__(self, items, window=WINDOW_WORDS):
        self.numbers, patterns = {}, {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text or b"")]
            length = min(window, len(ids))
            for start in range(len(ids) - length + 1 if length else 0):
                patterns.setdefault(length, {}).setdefault(tuple(ids[start:start + length]), set()).add(item)
        self.groups = [_Patterns(sorted(found.items(), key=lambda x: x[0]), length) for length, found in sorted(patterns.items())]

    def search(self, texts):
        """For each text: its number of words, the words hit and the items found."""
        ids, sizes = [], []
        number = self.numbers.get
        for text in texts:
            words = normal_words(text or b"")
            sizes.append(len(words))
            ids.extend([number(w, 0) for w in words])
            ids.append(0)
        ids = np.array(ids, np.int64)
        begins = np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)]
        change = np.zeros(len(ids) + 1, np.int64)
        items = [set() for _ in texts]
        for group in self.groups:
            ends, patterns = group.occurrences(ids)
            np.add.at(change, ends - group.length + 1, 1)
            np.add.at(change, ends + 1, -1)
            for text, pattern in set(zip((np.searchsorted(begins, ends, "right") - 1).tolist(), patterns.tolist())):
                items[text] |= group.items[pattern]
        hit = np.cumsum(change)[:-1] > 0
        return [(sizes[i], hit[begins[i]:begins[i + 1] - 1], items[i]) for i in range(len(texts))]


def _passes(benchmark):
    """Numbered blocks of the benchmark, and their number: a row goes to a block by its hash.

    Only the total size is known to the driver. A block holds about ``PASS_BYTES``.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-size // PASS_BYTES))
    if number == 1:
        return benchmark.withColumn("block", F.lit(0)), 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(number)).cast("int")
    return stored(benchmark.withColumn("block", block).repartitionByRange("block"), "benchmark"), number


def _rows(blocks, number):
    """One block: ids as text, and texts."""
    return [(None if r.item_id is None else str(r.item_id), r.text) for r in blocks.filter(F.col("block") == number).collect()]


def _found(texts, name, block, window):
    """Results for some texts; of texts side by side a bounded part is searched at once."""
    searcher = _searcher(name, block, window)
    return [result for part in _parts(texts) for result in searcher.search(part)]


def _in_blocks(docs, blocks, number, window):
    """``docs`` and ``found`` by one pass over the texts for each block.

    Of each pass the hit spans and items of the texts that have any are written, one row for
    equal texts; the block is released before the next one is read. Spans of all passes
    are then united.
    """
    context = docs.sparkSession.sparkContext
    key = F.sha2(F.col("text").cast("binary"), 256).alias("__key")
    texts, passes = docs.select(key, F.col("text").cast("binary").alias("text")), []
    for at in range(number):
        name, block = uuid.uuid4().hex, context.broadcast(_rows(blocks, at))

        @F.pandas_udf("spans array<struct<start:long,end:long>>, items array<string>")
        def search(series: pd.Series) -> pd.DataFrame:
            out = []
            for _, hit, items in _found(series.tolist(), name, block, window):
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).reshape(-1, 2).tolist()
                out.append(([{"start": a, "end": b} for a, b in edges], [i for i in items if i is not None]))
            return pd.DataFrame(out, columns=["spans", "items"])

        hits = texts.select("__key", search("text").alias("hit")).filter(F.size("hit.spans") > 0)
        passes.append(stored(hits.select("__key", "hit.*").dropDuplicates(["__key"]), "hits"))
        block.unpersist()
    united = reduce(DataFrame.unionByName, passes).groupBy("__key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Spans by start: each adds what lies beyond the farthest end so far.
    so_far = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    n_hit = F.aggregate("spans", so_far, lambda total, s: F.struct(
        (total.n + F.greatest(s.end - F.greatest(s.start, total.to), F.lit(0).cast("long"))).alias("n"),
        F.greatest(total.to, s.end).alias("to")))["n"]

    @F.pandas_udf("long")
    def count(series: pd.Series) -> pd.Series:
        return series.map(lambda t: len(normal_words(t or b""))).astype("int64")

    n_words, hit = count(F.col("text").cast("binary")), F.coalesce("__hit", F.lit(0).cast("long"))
    joined = docs.withColumn("__key", key).withColumn("__words", n_words).join(
        united.select("__key", n_hit.alias("__hit"), F.col("items").alias("__items")), "__key", "left")
    found = F.struct(
        F.col("__words").alias("n_words"), hit.alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (HIT_SHARE * hit >= F.col("__words"))).alias("contaminated"))
    return joined.withColumn("found", found).select(*[F.col(f"`{c}`") for c in docs.columns if c != "found"], "found")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window=WINDOW_WORDS) -> DataFrame:
    """All columns of ``docs`` and ``found``, a struct ``n_words, n_hit, items, contaminated``.

    Windows are ``window`` consecutive words of an item; an item of fewer words is one
    window. A word inside any occurrence of a window is hit. ``items`` are the ids of
    the items with occurring windows, sorted as text. A document is contaminated if
    words are hit and they are at least a twentieth of all its words.

    The shift table gives, for every three words of a text, how far the search may move
    on; where it may not, the bucket of these words names the windows that end so, and
    all their words are compared. Each length of window has its own tables. Texts of a
    batch are searched side by side.

    The benchmark is the query set of the search. It is cut into blocks of about
    ``PASS_BYTES``; one block at a time comes to the driver, is broadcast and searched in
    all texts, and is released. With one block nothing is written in between.

    Null and empty texts have no words and are clean; items without words have no
    windows. Windows of an item with a null id hit words, but the item is not listed.
    An empty benchmark leaves all clean. Repeated rows are judged each; extra columns are kept.
    """
    blocks, number = _passes(benchmark.select("item_id", F.col("text").cast("binary").alias("text")))
    if number > 1:
        return _in_blocks(docs, blocks, number, window)
    # Workers outlive a query, so what they keep of a block goes by a name of its own.
    name, block = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(_rows(blocks, 0))

    @F.pandas_udf("n_words long, n_hit long, items array<string>, contaminated boolean")
    def search(series: pd.Series) -> pd.DataFrame:
        out = []
        for n, hit, items in _found(series.tolist(), name, block, window):
            hits = int(hit.sum())
            out.append((n, hits, sorted(i for i in items if i is not None), hits > 0 and HIT_SHARE * hits >= n))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "contaminated"])

    return docs.withColumn("found", search(F.col("text").cast("binary")))


def _parts(texts):
    """Runs of texts of some ``PART_BYTES`` together, so that a search needs bounded memory."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or b"")
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


_COMPILED = {}


def _searcher(name, block, window):
    """The compiled block; a worker keeps the one it used last."""
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = Searcher(block.value, window)
    return _COMPILED[name]


def contamination(docs: DataFrame, benchmark: DataFrame, window=WINDOW_WORDS) -> DataFrame:
    """Per document, in a flat form with the item ids as SHA-256."""
    return find_contamination(docs.select("doc_id", "text"), benchmark, window).select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), "found.contaminated")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window=WINDOW_WORDS) -> DataFrame:
    """The clean rows of ``docs``, with its columns.

    Null and empty texts are clean. Repeated rows are judged each, null ids stay, an empty
    benchmark leaves everything, and columns of any name are kept as they are.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return find_contamination(kept, benchmark, window).filter(~F.col("found.contaminated")).select("row.*")
