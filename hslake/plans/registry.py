"""Every registered journal query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame

from hslake.sources.journal import Journal, load_journal, oracle

MODULES = ["investigation", "analytics", "certificates", "correlation", "ownership", "incremental", "evidence", "policy", "http", "classes", "records", "details", "flowing", "taking"]

FOUND: dict[str, tuple[Callable[[Journal], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the journal; ``sql`` may name any journal table."""

    def keep(f):
        assert name not in FOUND, name
        FOUND[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        import_module(f"hslake.operators.{m}")


def queries() -> dict:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(load_journal(spark, sf_dir))) for name, (f, _) in FOUND.items()}


def oracles() -> dict:
    _load()
    return {name: oracle(sql) for name, (_, sql) in FOUND.items() if sql}
