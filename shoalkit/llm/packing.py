"""Packing: length buckets that minimise padding, token-budget batches inside them."""

import base64
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalkit.llm.common import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's authors split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the characters that the pattern takes as white space.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = 1000
LONG_BLANK_RUN = re.compile(f"[{BLANKS}]{{{LONG_BLANK + 1},}}")
MAX_TOKENS = 2048
BUCKETS = 8
BATCH_TOKENS = 16_384
# Pieces numbered by one task.
SHARD_ROWS = 20_000

_ENCODERS = {}


def read_ranks(path):
    """The vocabulary file as bytes; some 50,000 entries, which bounds what is broadcast."""
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    """Byte-level merges over pieces of the split pattern; any text is encoded, long runs of white space too.

    The pattern looks ahead after white space, for which its engine keeps a state for
    every character. So a run of more than ``LONG_BLANK`` is cut where the pattern cuts
    it anyway: before its last character if a word follows, else at its end.
    """

    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        self.split = tiktoken.Encoding("split", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.size = len(ranks)

    def _parts(self, text: str):
        start = 0
        for run in LONG_BLANK_RUN.finditer(text) if len(text) > LONG_BLANK else ():
            end = run.end() - (run.end() < len(text))
            yield self.split, text[start:run.start()]
            yield self.whole, text[run.start():end]
            start = end
        yield self.split, text[start:]

    def encode(self, text: str):
        return [token for pattern, part in self._parts(text) for token in pattern.encode_ordinary(part)]

    def count(self, text: str) -> int:
        return sum(len(pattern.encode_ordinary(part)) for pattern, part in self._parts(text))

    def decode(self, tokens) -> bytes:
        return self.split.decode_bytes(tokens)


def encoder(data: bytes) -> Encoder:
    if data not in _ENCODERS:
        _ENCODERS[data] = Encoder(data)
    return _ENCODERS[data]


def token_counts(docs: DataFrame, tokenizer=TOKENIZER) -> DataFrame:
    """All columns of ``docs`` and ``n_tokens`` of the whole text (null: 0)."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = encoder(ranks.value)
        return texts.map(lambda t: own.count(t) if t else 0).astype("int64")

    return docs.withColumn("n_tokens", count("text"))


def bucket_bounds(lengths, counts, buckets=BUCKETS):
    """At most ``buckets`` widths that pad the pieces least, by dynamic programming.

    ``best[j]`` is the least padding of the ``j`` shortest lengths with the buckets used
    so far; the next bucket ends at ``j`` and starts after some ``i < j``.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    pieces, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    # padding[i, j]: pieces i .. j-1 padded to the longest of them.
    width = np.r_[0, lengths]
    padding = width[None, :] * (pieces[None, :] - pieces[:, None]) - (tokens[None, :] - tokens[:, None])
    padding = np.where(np.arange(n + 1)[:, None] < np.arange(n + 1), padding, np.iinfo(np.int64).max // 4)
    best, cuts = padding[0].copy(), []
    best[0] = 0
    for _ in range(min(buckets, n) - 1):
        total = best[:, None] + padding
        cut = total.argmin(axis=0)
        cuts.append(cut)
        better = total[cut, np.arange(n + 1)]
        better[0] = 0
        best = better
    bounds, end = [], n
    for cut in reversed(cuts):
        if end == 0:
            break
        bounds.append(int(lengths[end - 1]))
        end = int(cut[end])
    if end > 0:
        bounds.append(int(lengths[end - 1]))
    return bounds[::-1]


def pack(docs: DataFrame, max_tokens=MAX_TOKENS, buckets=BUCKETS, batch_tokens=BATCH_TOKENS, tokenizer=TOKENIZER) -> DataFrame:
    """Where every piece of every document goes.

    ``doc_id, piece, start_token, n_tokens, bucket, width, batch, slot``: a text of more
    than ``max_tokens`` tokens is cut into pieces of that many and a rest, so no token is
    lost. A piece is padded to the ``width`` of its bucket; a batch holds as many pieces
    as fit ``batch_tokens`` at that width (one at least), ``slot`` counts them.

    The global histogram of piece lengths has at most ``max_tokens`` entries whatever the
    corpus; only it comes to the driver. Pieces are dealt by hash into shards of about
    ``SHARD_ROWS`` of one bucket, so a bucket with most pieces is numbered by many tasks;
    each shard ends with one batch that may not be full.

    Null and empty texts give one piece of 0 tokens without bucket and batch. Repeated
    rows are packed each; null ids are packed too. An empty table gives no rows. Extra
    columns are not read.
    """
    counted = stored(
        token_counts(docs.select("doc_id", "text"), tokenizer)
        .select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "n_tokens"), "tokens")
    n_pieces = F.greatest(F.ceil(F.col("n_tokens") / max_tokens), F.lit(1))
    pieces = counted.select(
        "doc_id", "key", F.col("n_tokens").alias("total"),
        F.explode(F.sequence(F.lit(0).cast("long"), n_pieces.cast("long") - 1)).alias("piece"),
    ).select(
        "doc_id", "key", "piece", (F.col("piece") * max_tokens).alias("start_token"),
        F.least(F.lit(max_tokens), F.col("total") - F.col("piece") * max_tokens).cast("long").alias("n_tokens"))
    histogram = {r.n_tokens: r["count"] for r in pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()}
    bounds = bucket_bounds(list(histogram), list(histogram.values()), buckets)
    if not bounds:
        return pieces.select(
            "doc_id", "piece", "start_token", "n_tokens", F.lit(None).cast("int").alias("bucket"),
            F.lit(None).cast("long").alias("width"), F.lit(None).cast("string").alias("batch"),
            F.lit(None).cast("long").alias("slot"))
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds), F.lit(0))
    sizes = [sum(n for length, n in histogram.items() if low < length <= high) for low, high in zip([0] + bounds, bounds)]
    shards = F.array(*[F.lit(math.ceil(n / SHARD_ROWS)) for n in sizes])
    widths = F.array(*[F.lit(b).cast("long") for b in bounds])
    fits = F.greatest(F.floor(F.lit(batch_tokens) / F.col("width")), F.lit(1))
    placed = (
        pieces.filter("n_tokens > 0").withColumn("bucket", bucket)
        .withColumn("width", F.get(widths, F.col("bucket")))
        .withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.get(shards, F.col("bucket"))))
    )
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("piece", "key"), "key", "piece")) - 1
    batched = placed.withColumn("number", number).select(
        "doc_id", "piece", "start_token", "n_tokens", "bucket", "width",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("number") / fits)).alias("batch"),
        F.pmod(F.col("number"), fits).cast("long").alias("slot"))
    empty = pieces.filter("n_tokens = 0").select(
        "doc_id", "piece", "start_token", "n_tokens", F.lit(None).cast("int").alias("bucket"),
        F.lit(None).cast("long").alias("width"), F.lit(None).cast("string").alias("batch"),
        F.lit(None).cast("long").alias("slot"))
    return batched.unionByName(empty)
