"""Every query the package offers on the given tables, each with its check SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("base", "text", "graph", "retrieval", "assessment", "evaluation", "sources", "streams")


def load_all():
    from clausegrid.registry import core

    for group in GROUPS:
        import_module(f"clausegrid.registry.{group}_queries")
    return core.QUERIES, core.ORACLE
