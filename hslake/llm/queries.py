"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from functools import wraps
from importlib import import_module
from pathlib import Path

MODULES = ["decontam", "jaccard", "toxicity", "url_filter", "suffix_dedup", "langid", "packing", "lm_score", "quality", "chat", "alignment", "token_counts", "filter_audit"]


def _reachable(query):
    """Python workers find this package wherever the driver was started from; a cluster that has it installed needs nothing."""
    root = str(Path(__file__).resolve().parents[2])

    @wraps(query)
    def run(spark, sf_dir):
        env = spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"hslake.llm.{name}").QUERIES
    from . import pipeline

    found["pipeline"] = pipeline.run
    return {name: _reachable(query) for name, query in found.items()}


def oracles() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"hslake.llm.{name}").ORACLES
    return found
