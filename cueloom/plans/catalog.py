"""Imports every module that registers queries."""

import importlib

MODULES = ["jobs", "qc", "prepare", "anomaly", "compare", "entities", "segment", "ingest", "align", "events"]


def load() -> None:
    for name in MODULES:
        try:
            importlib.import_module(f"cueloom.plans.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"cueloom.plans.{name}":
                raise
