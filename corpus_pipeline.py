"""The pipeline of quadrille.llm.pipeline, where the driver looks for it."""

from quadrille.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
