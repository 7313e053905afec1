"""The corpus pipeline as a script of its own; its stages are those of the corpus operators' package."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
