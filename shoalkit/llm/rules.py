"""Quality rules: one table of thresholds compiled into one projection, built-in functions only."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stop words of some languages. A text in another one is known by words of its own that recur.
STOP_WORDS = (
    "the", "of", "and", "to", "is", "in", "der", "die", "und", "das", "de", "la", "le", "et", "que", "el", "los", "les",
)

# Measure, smallest and largest value a document may have (None: no bound).
THRESHOLDS = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.08),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.50),
    ("pipe_line_ratio", None, 0.50),
    ("upper_ratio", None, 0.60),
    ("repeat_word_ratio", None, 0.50),
)


def _is_word(text):
    return text.rlike(r"[^ \t-\r]")


def _covered(starts):
    """Positions that three-word windows at these sorted starts cover."""
    gaps = F.zip_with(
        F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))),
        F.slice(starts, F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0))),
        lambda later, earlier: F.least(later - earlier, F.lit(3)))
    total = F.aggregate(gaps, F.lit(0), lambda so_far, gap: so_far + gap)
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(total + 3)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of every whole text.

    ``n_stop_words`` is the number of listed stop words, or of words that stood in the
    text before, whichever is larger: function words recur in any language.

    A null text is empty. Ratios of an empty text are 0. Windows of three words are
    told apart by a 64-bit hash within one text. Each array is built in a projection of
    its own, so that later expressions read it instead of building it again; sorting
    uses the natural order of its elements, which needs no lambda.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text",
        F.array_remove(F.split("text", r"[ \t-\r]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), _is_word).alias("lines"))
    windows = F.transform(
        F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
        lambda word, i: F.struct(
            F.xxhash64(word, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))
    by_hash = split.withColumn("windows", F.sort_array(windows))
    # A window is repeated if a neighbour in hash order has its hash.
    repeated = F.transform("windows", lambda w, i: F.when(
        (w["h"] == F.get("windows", i - 1)["h"]) | (w["h"] == F.get("windows", i + 1)["h"]), w["i"]))
    starts = by_hash.withColumn("starts", F.sort_array(F.array_compact(repeated)))
    return starts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("starts")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda line: F.contains(line, F.lit("|")))).cast("long").alias("n_pipe_lines"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.greatest(
            F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))),
            F.size("words") - F.size(F.array_distinct("words"))).cast("long").alias("n_stop_words"))


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "pipe_line_ratio": ("n_pipe_lines", "n_lines"),
    "upper_ratio": ("n_upper", "word_chars"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
}


def _measure(name):
    if name not in RATIOS:
        return F.col(name)
    above, below = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below).cast("double")), F.lit(0.0))


def verdict(thresholds=THRESHOLDS):
    """The table as one condition: every measure lies within its bounds."""
    bounds = []
    for name, smallest, largest in thresholds:
        if smallest is not None:
            bounds.append(_measure(name) >= smallest)
        if largest is not None:
            bounds.append(_measure(name) <= largest)
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def apply_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Measures of every document, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words lie in three-word
    windows that the text holds more than once. ``kept``: not failed, and within all
    bounds of ``thresholds``. A null or empty text fails. Repeated rows are judged
    each, an empty table gives no rows, null ids and extra columns do not matter. No
    text is too long.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs).select("*", failed.alias("base_failed"), (~failed & verdict(thresholds)).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
