"""Every registered query of the reference's operators, and the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("event_queries", "histogram_queries", "scalar_queries", "quality_queries", "waveform_queries", "run_queries", "source_queries", "refined_queries")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"hitweave.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
