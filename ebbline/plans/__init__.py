"""Modules that register queries with the catalog."""

import importlib

MODULES = ("expressions", "joins", "logs", "snapshots", "state", "streams")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
