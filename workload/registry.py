"""All queries by name, and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("corpus", "documents", "overview", "learning", "drafts", "kept")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"workload.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
