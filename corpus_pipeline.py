"""The corpus pipeline of ladle.llm under the name that the driver and the check tool import."""

from ladle.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
