"""Operators of a training-data pipeline and their registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "quality", "chat", "setjoin", "decontaminate", "html", "secrets", "lm", "packing", "topk", "dedup", "codes", "divergence")


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"foldspark.llm.{m}"), name).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
