"""From raw documents to packed training batches.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.
"""

from shoalkit.llm import decontamination, language, near_duplicates, packing, personal_data
from shoalkit.llm.common import dropped, scratch, stored, table
from shoalkit.session import use_own_folder


def identify_language(spark, docs, sf_dir):
    """Documents whose language can be determined; texts without a letter, nulls among them, go.

    Repeated rows, null ids and all columns are kept as they are; no rows give none.
    """
    return language.with_known_language(docs)


def deduplicate(spark, docs, sf_dir):
    """One document of each group whose fingerprints are linked: that with the smallest id.

    Null and empty texts share fingerprint zero and are one group; rows with a null id stay
    only if their group has no other. Equal rows are one. No rows give none.
    """
    return near_duplicates.without_near_duplicates(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents without benchmark passages, by the rule of the search operator.

    Null and empty texts are clean. Repeated rows are judged each; no rows give none.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark, docs, sf_dir):
    """Personal data replaced by its kind; null and empty texts, ids and other columns stay."""
    return personal_data.without_personal_data(docs)


def pack(spark, docs, sf_dir):
    """Where every piece of every document goes; null and empty texts are one piece of no tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal-data", redact),
    ("packing", pack),
]

# SQL cannot express the classifier, the components and the packing.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(use_own_folder(spark), sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as made:
            out = stored(stage(spark, docs, sf_dir), name)
            made.remove(out.stored_in)
        # The tables of a finished stage are not read again, nor is its input.
        if number:
            dropped(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
