"""The catalog's queries and the DuckDB SQL that each must agree with."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.catalog import Catalog
from .sources.oracle_views import with_views

MODULES = (
    "functions.scalars", "functions.values", "operators.gallery", "operators.predicates", "operators.capture", "operators.findings", "operators.choices", "operators.facets", "operators.duplicates", "operators.similarity", "operators.stats", "operators.oplog", "operators.review", "operators.lineage", "operators.metadata", "operators.checks", "operators.records", "operators.pictures", "operators.jpegs", "operators.versions",
    "plans.transfer", "plans.ingest", "plans.ledger", "streaming.incremental", "streaming.batches",
)

_found: dict[str, tuple[Callable[..., DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers an operator under a name. Its parameters name the views that it reads; sql reads the same views."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _found[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"catalith.{module}")


def bind(f: Callable[..., DataFrame], catalog: Catalog) -> DataFrame:
    needed = [p.name for p in inspect.signature(f).parameters.values() if p.default is inspect.Parameter.empty]
    return f(**{n: getattr(catalog, n) if hasattr(Catalog, n) else catalog.table(n) for n in needed})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: bind(f, Catalog(spark, sf_dir))) for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, (_, sql) in _found.items() if sql}
