"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from . import registry

MODULES = ("q_sources", "q_taint", "q_joins", "q_findings", "q_packs", "q_scopes")


def load():
    for m in MODULES:
        import_module(f"workload.{m}")
    return registry.QUERIES, registry.ORACLES
