"""Cleaning and packing of a document corpus: the stages of ``hslake.llm.pipeline``, each written as Parquet and read again as the next one's documents."""

from hslake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
