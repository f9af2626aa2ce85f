"""Registered queries, one module a subject, each with its SQL beside it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["market", "vendor", "collection", "features", "training"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"quoteloom.plans.{m}").QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"quoteloom.plans.{m}").SQL.items()}
