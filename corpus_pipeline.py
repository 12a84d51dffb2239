"""The corpus pipeline, for those who run it by this name; see tidewatch/llm/pipeline.py."""

from tidewatch.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
