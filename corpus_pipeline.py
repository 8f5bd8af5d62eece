"""The corpus pipeline's entry: its stages, and the run over a folder of tables. They live in ``gradeloom.llm.pipeline``."""

from gradeloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
