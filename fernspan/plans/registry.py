"""Every registered query of the engine proper and its oracle."""

from __future__ import annotations

from collections.abc import Callable

MODULES: list[str] = [f"fernspan.plans.{m}" for m in ("q_text", "q_tables", "q_eval", "q_ap", "q_fx", "q_similarity", "q_io", "q_ml", "q_composite")]


def _all(name: str) -> dict:
    import importlib

    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(m), name)
    return out


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
