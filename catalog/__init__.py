"""Registered queries: each one pairs a Spark job with the SQL that checks it."""

from __future__ import annotations

import importlib

_MODULES = ["text", "retrieval", "tables", "operations", "understanding", "segmentation", "ingestion", "row_answers"]


def load_all() -> None:
    for name in _MODULES:
        importlib.import_module(f"catalog.{name}")
