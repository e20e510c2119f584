"""Every query by name, with its SQL."""

from __future__ import annotations

from glyphflow.plans import detection, recognition

QUERIES = recognition.QUERIES | detection.QUERIES
ORACLE_SQL = recognition.ORACLE_SQL | detection.ORACLE_SQL
flagship = recognition.ctc_collapse
