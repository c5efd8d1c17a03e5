"""Periodic runs of words: branching tandem repeats of an enhanced suffix array, rotated and merged."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 24
MIN_REPEATS = 3
# Words of several texts that are sorted together; a longer text is sorted alone.
GROUP_WORDS = 1 << 16
FOUND = "array<struct<start:long,length:long,period:long>>"
TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixArray:
    """Suffix array, its inverse and common prefixes of one sequence of integers, by prefix doubling.

    Every part of the sequence that is to be compared only with itself ends with a value
    that occurs once. ``levels[k][i]`` are the ranks by the first ``2 ** k`` values, so
    the common prefix of any two suffixes is found by one comparison per level.
    """

    def __init__(self, values):
        n = len(values)
        order = np.argsort(values, kind="stable")
        rank = self._ranks(order, values[order], np.arange(n), np.empty(n, np.int64))
        self.levels, step = [], 1
        while True:
            shared = np.bincount(rank, minlength=n)[rank] > 1
            active = np.flatnonzero(shared)
            if not len(active):
                break
            self.levels.append(rank.astype(np.int32))
            # Only suffixes that still share their rank are sorted again, inside their group.
            key = rank[active] * np.int64(n + 1) + rank[active + step]
            order = np.argsort(key, kind="stable")
            head = rank[active[order]]
            first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            place = head + np.arange(len(head)) - np.repeat(first, np.diff(np.r_[first, len(head)]))
            rank = self._ranks(active[order], key[order], place, rank.copy())
            step *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    @staticmethod
    def _ranks(positions, keys, places, into):
        """Write the place of the first of all equal ``keys`` as the rank of ``positions``."""
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        into[positions] = np.repeat(places[new], np.diff(np.r_[np.flatnonzero(new), len(keys)]))
        return into

    def common(self, a, b):
        """Length of the common prefix of the suffixes at ``a`` and at ``b``, which differ."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            length += (level[a + length] == level[b + length]).astype(np.int64) << k
        return length

    def neighbours(self):
        """For every place of the suffix array the prefix shared with the place before it."""
        shared = np.zeros(len(self.order), np.int64)
        if self.levels:
            first = self.levels[0][self.order]
            at = np.flatnonzero(first[1:] == first[:-1]) + 1
            shared[at] = self.common(self.order[at - 1], self.order[at])
        return shared


def lcp_intervals(shared):
    """The intervals of common prefixes: ``left, right, depth`` of each, and ``(place, interval)``
    of the places at which its children meet. One scan with a stack; no tree is built."""
    left, right, depth, places, owner = [], [], [], [], []
    at = np.flatnonzero(shared)
    stack, last = [], -2
    for place, now in zip(at.tolist(), shared[at].tolist()):
        if place != last + 1:
            for i in stack:
                right[i] = last
            stack = []
        start = place - 1
        while stack and depth[stack[-1]] > now:
            i = stack.pop()
            right[i], start = place - 1, left[i]
        if not stack or depth[stack[-1]] < now:
            stack.append(len(depth))
            left.append(start)
            right.append(-1)
            depth.append(now)
        places.append(place)
        owner.append(stack[-1])
        last = place
    for i in stack:
        right[i] = last
    return (np.array(x, np.int64) for x in (left, right, depth, places, owner))


def _spread(first, size):
    """``first[k] .. first[k] + size[k] - 1`` for every k, one after another."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)


def branching_tandems(index: SuffixArray):
    """``(start, period)`` of all squares that cannot be moved one place to the right.

    A square of period ``depth`` starts at ``i`` if the suffixes at ``i`` and ``i + depth``
    lie in the same interval of that depth; they branch if they lie in unlike children.
    One of the two then lies in a child that is not the largest, so it is enough to test
    ``i + depth`` and ``i - depth`` for the suffixes of all smaller children.
    """
    left, right, depth, places, owner = lcp_intervals(index.neighbours())
    if not len(depth):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Children start at the left end and at the places that the interval owns.
    interval = np.r_[np.arange(len(depth)), owner]
    start = np.r_[left, places]
    order = np.lexsort((start, interval))
    interval, start = interval[order], start[order]
    ends = np.r_[interval[1:] != interval[:-1], True]
    size = np.where(ends, right[interval] + 1, np.r_[start[1:], 0]) - start
    # The largest child of each interval, the first of equal ones, is not enumerated.
    largest = np.lexsort((start, -size, interval))
    largest = largest[np.r_[True, interval[largest][1:] != interval[largest][:-1]]]
    small = np.ones(len(size), bool)
    small[largest] = False
    interval, start, size = interval[small], start[small], size[small]
    suffix = index.order[_spread(start, size)]
    step, low, high = (np.repeat(x, size) for x in (depth[interval], left[interval], right[interval]))
    child_low, child_high = np.repeat(start, size), np.repeat(start + size, size)
    found = []
    for other in (suffix + step, suffix - step):
        inside = (other >= 0) & (other < len(index.rank))
        place = index.rank[np.where(inside, other, 0)]
        inside &= (place >= low) & (place <= high) & ((place < child_low) | (place >= child_high))
        found.append((np.minimum(suffix, other)[inside], step[inside]))
    return tuple(np.concatenate(x) for x in zip(*found))


def maximal_runs(values, min_words=MIN_WORDS, min_repeats=MIN_REPEATS):
    """``start, end, period`` of the maximal runs of ``values`` that are long enough.

    A branching square ends where its run ends. Rotating it to the left as far as the
    words agree gives the start: the suffixes at ``k`` and ``k + period`` agree up to the
    end exactly for the places ``k`` inside the run, so the number of rotations is found
    by bisection on common prefixes. Squares whose root is itself periodic meet the run
    of the smaller period at both ends; of such the smallest period is kept.
    """
    index = SuffixArray(values)
    start, period = branching_tandems(index)
    end = start + 2 * period
    low, high = np.zeros(len(start), np.int64), start.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        inside = index.common(middle, middle + period[open_]) >= end[open_] - period[open_] - middle
        high[open_[inside]] = middle[inside]
        low[open_[~inside]] = middle[~inside] + 1
    order = np.lexsort((period, end, low))
    low, end, period = low[order], end[order], period[order]
    first = np.r_[True, (low[1:] != low[:-1]) | (end[1:] != end[:-1])] if len(low) else np.empty(0, bool)
    low, end, period = low[first], end[first], period[first]
    keep = end - low >= np.maximum(min_words, min_repeats * period)
    return low[keep], end[keep], period[keep]


def runs_of(texts, min_words=MIN_WORDS, min_repeats=MIN_REPEATS):
    """For each list of words its runs ``(start, length, period)``, by start, then period.

    The words of all texts are numbered apart, so no prefix is shared between texts.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.any():
        return [[] for _ in texts]
    numbers = {}
    words = [w for text in texts for w in text]
    for word in words:
        numbers.setdefault(word, len(numbers))
    number = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    values = np.empty(len(words) + len(texts), np.int64)
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    values[:] = text * (len(numbers) + 1) + len(numbers)
    values[_spread(begins, sizes)] -= len(numbers) - number
    out = [[] for _ in texts]
    start, end, period = maximal_runs(values, min_words, min_repeats)
    for s, e, p, t in zip(start.tolist(), end.tolist(), period.tolist(), text[start].tolist()):
        out[t].append((s - int(begins[t]), e - s, p))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words, runs):
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _grouped(texts, words):
    """Lists of texts with about ``words`` words together; one longer text is a list of its own."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > words:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def periodic_runs(docs: DataFrame, min_words=MIN_WORDS, min_repeats=MIN_REPEATS) -> DataFrame:
    """All columns of ``docs``, ``runs`` and ``collapsed``.

    Words are what white space of ASCII separates. ``runs`` lists ``start, length,
    period`` (in words, from 0) of every stretch with smallest period ``period`` that no
    neighbouring word extends, of at least ``min_words`` words and ``min_repeats``
    periods. ``collapsed`` is the text with one blank between words and only the first
    period of every run left, except where another run drops it.

    A text is worked on by itself and whole, in time ``n log**2 n`` of its words and memory for
    some dozen numbers a word and one more for each doubling of its longest repeat.
    Nothing is shuffled, so no key can be hot.

    Null and empty texts have no runs and an empty ``collapsed``. Repeated rows, null
    ids and extra columns are returned as they are, but columns called ``runs`` and
    ``collapsed`` are replaced. An empty table gives no rows.
    """

    @F.arrow_udf(f"struct<runs:{FOUND},collapsed:string>")
    def find(texts: pa.Array) -> pa.Array:
        split = ((t.as_py() or b"").split() for t in texts)
        runs, left = [], []
        for group in _grouped(split, GROUP_WORDS):
            here = runs_of(group, min_words, min_repeats)
            left += [b" ".join(x).decode() for x in map(collapsed, group, here)]
            runs += [[dict(zip(("start", "length", "period"), r)) for r in x] for x in here]
        return pa.StructArray.from_arrays(
            [pa.array(runs, TYPE), pa.array(left, pa.string())], names=["runs", "collapsed"])

    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    return docs.select(*[F.col(f"`{c}`") for c in others], find(F.col("text").cast("binary")).alias("__found")).select(
        *[F.col(f"`{c}`") for c in others], "__found.runs", "__found.collapsed")


def with_planted_cycle(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the texts that the query looks at, in which one document in ten ends periodically.

    With ``h`` the CRC32 of the id and ``g = h div 10``, a text whose ``h`` ends in 0 goes
    on from word ``g mod n`` with a cycle of its next words. A null id leaves its text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h")).select(
        "doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    placed = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    cycled = placed.withColumn("p", period).withColumn("cycle", F.array_join(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1),
        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))), " "))
    return cycled.select("doc_id", F.coalesce(F.when(F.col("a").isNotNull(), F.col("cycle")), "text").alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The digest of ``periodic_runs``: number of runs, the one with most periods, hashes of all of them."""
    # Fractions are compared exactly, by cross products.
    best = F.get(F.array_sort("runs", lambda x, y: (
        F.when(x.length * y.period != y.length * x.period, F.when(x.length * y.period > y.length * x.period, -1).otherwise(1))
        .when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1))
        .when(x.period != y.period, F.when(x.period < y.period, -1).otherwise(1)).otherwise(0))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
