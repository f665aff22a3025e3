"""Query plans over the test tables, each with the same query in SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from .base import QUERIES, SQL

for _name in ("profiling", "aligning", "sequences", "scalars", "road_graph", "evaluation", "rule_tables", "replies", "recordings", "sidecars", "road_rules", "offsets", "surveys", "graph_build", "manifests", "checkpoints", "small_items", "stateful"):
    import_module(f"{__name__}.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
