"""Operators for training-data pipelines: duplicates, scans, quality, boilerplate, leakage, mixing, reading level.

Nothing outside this folder imports it. ``queries()`` and ``oracle_sql()`` are picked up by ``__spark_entry__``.
"""

from foliant.llm.entry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
