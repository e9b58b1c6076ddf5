"""The corpus pipeline: ``STAGES`` in order, ``run(spark, sf_dir)`` to apply them to documents. See millrace/llm/pipeline.py."""

from millrace.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
