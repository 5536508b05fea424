"""Queries over the given tables, one or more for each operator."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ["scalars", "records", "identify", "runs", "reads", "consensus", "streams", "files"]:
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
