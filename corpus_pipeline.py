"""The corpus pipeline: its stages (name, function), the SQL of its rows, and run(spark, sf_dir)."""

from veldspar.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
