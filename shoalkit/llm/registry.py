"""The queries of this subpackage by name: ``(spark, folder) -> DataFrame``, on whole tables."""

from pathlib import Path

from shoalkit.llm import (
    chat, decontamination, language, licenses, near_duplicates, packing, periodic_runs, personal_data, quality, rules,
    substrings, toxicity, whitening,
)
from shoalkit.llm.common import table
from shoalkit.llm.oracle import oracle_sql
from shoalkit.session import use_own_folder

__all__ = ["oracle_sql", "queries"]



def _whitening(spark, folder):
    return whitening.by_component(whitening.whiten(table(spark, folder, "embeddings")))


def _periodic_runs(spark, folder):
    docs = periodic_runs.with_planted_cycle(table(spark, folder, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs))


def _chat(spark, folder):
    conversations = chat.with_hostile_conversation(table(spark, folder, "conversations"))
    return chat.read_back(*chat.chat_tree(conversations))


QUERIES = {
    "op1_simhash": lambda s, d: near_duplicates.near_duplicates(table(s, d, "documents")).drop("class"),
    "op2_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")).drop("evidence"),
    "op3_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op4_language": lambda s, d: language.language_id(table(s, d, "documents")),
    "op5_substrings": lambda s, d: substrings.repeated_passages(table(s, d, "documents")),
    "op6_decontamination": lambda s, d: decontamination.contamination(
        table(s, d, "documents"), table(s, d, "benchmark")),
    "op7_quality": lambda s, d: quality.quality_scores(table(s, d, "documents"), table(s, d, "labels")),
    "op8_personal_data": lambda s, d: personal_data.personal_data(table(s, d, "documents")),
    "op9_rules": lambda s, d: rules.quality_rules(table(s, d, "documents")),
    "op10_licenses": lambda s, d: licenses.license_scan(table(s, d, "documents")),
    "op11_whitening": _whitening,
    "op12_periodic_runs": _periodic_runs,
    "op13_chat": _chat,
}


def _runner(build):
    def run(spark, folder):
        # Python workers find this package where the driver does.
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
        return build(use_own_folder(spark), folder)

    return run


def queries():
    return {name: _runner(build) for name, build in QUERIES.items()}
