"""Every query of this subpackage and the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("language_id", "fingerprints", "exact_dedup", "simhash", "mixing", "suffix_dedup", "quality", "bpe", "toxicity", "chat", "repair", "packing", "spelling")


def queries() -> dict:
    return {name: query for m in MODULES for name, query in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").ORACLE_SQL.items()}
