"""Rule packs by language."""

from __future__ import annotations

from importlib import import_module

from .model import Rule

PACKS = ("python", "javascript", "java", "php", "csharp", "ruby", "go", "webconfig", "markup")


def rules_for(lang: str) -> tuple[Rule, ...]:
    return import_module(f"{__name__}.{lang}").RULES


def all_rules() -> tuple[Rule, ...]:
    return tuple(r for lang in PACKS for r in rules_for(lang))
