"""Query modules; each has a registry R of queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("corpus", "streams", "masks", "neardup", "chat", "metrics", "generate", "incremental")


def registries() -> list:
    return [importlib.import_module(f"corpusmill.plans.{m}").R for m in MODULES]
