"""Queries that bind the operators to the given tables."""

from __future__ import annotations

import importlib

MODULES = (
    "sources", "contracts", "encoding", "relational", "splits", "profile", "metrics", "inference", "drift", "models", "streaming", "attribution",
)


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for name in MODULES:
        importlib.import_module(f"plumbline.plans.{name}")
