"""Collects the query modules."""

from __future__ import annotations

import importlib

from evidmill.plans.binding import Spine

MODULES = ("rollups", "timelines", "graphs", "verification", "extraction", "redaction", "verdicts", "packets", "files")


def _each():
    for name in MODULES:
        yield importlib.import_module(f"evidmill.plans.{name}")


def queries() -> dict:
    """``name -> (spark, sf_dir) -> DataFrame`` for every registered query."""
    out = {}
    for module in _each():
        for name, build in module.QUERIES.items():
            assert name not in out, name
            out[name] = lambda spark, sf_dir, build=build: build(Spine(spark, sf_dir))
    return out


def oracles() -> dict:
    out = {}
    for module in _each():
        out.update(module.ORACLES)
    return out
