"""The corpus pipeline; its stages are those of minuteflow.llm.pipeline."""

from minuteflow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
