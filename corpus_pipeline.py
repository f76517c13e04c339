"""The corpus pipeline: STAGES, run(spark, sf_dir) and ORACLE_SQL of pkgloom.llm.pipeline."""

from pkgloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
