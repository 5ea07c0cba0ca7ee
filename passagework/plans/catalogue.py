"""The query catalogue: name -> (function, SQL or None)."""

from __future__ import annotations

from . import comparison, evaluation, passages, preparation, retrieval, studies

ENTRIES: dict[str, tuple] = {**retrieval.ENTRIES, **passages.ENTRIES, **evaluation.ENTRIES, **preparation.ENTRIES, **comparison.ENTRIES, **studies.ENTRIES}


def queries() -> dict:
    return {name: f for name, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
