"""Rule plug-ins: Python files with rule objects, loaded on the driver and shipped with the closure."""

from __future__ import annotations

import importlib.metadata
import importlib.util
from collections.abc import Callable
from pathlib import Path

from weirflow.operators import rewrite, security

#: Entry-point group of security rule packs.
PACKS = "weirflow.security_rules"


def _rule(value) -> bool:
    """An instance, not a class, with an id, a version of one or more, a known tier, a description and analyze()."""
    return (
        not isinstance(value, type)
        and isinstance(getattr(value, "id", None), str)
        and isinstance(getattr(value, "version", None), int)
        and value.version >= 1
        and getattr(value, "tier", None) in rewrite.TIERS
        and isinstance(getattr(value, "description", None), str)
        and callable(getattr(value, "analyze", None))
    )


def load(folder: str, warn: Callable[[str], None] = lambda message: None) -> dict[str, tuple[str, rewrite.Rule]]:
    """The built-in rules and those of every *.py of a folder, files in order of name, rules in order of id.

    `analyze(text, tokens, schemas)` yields (start, end, after, reason). Files that fail to load, invalid objects and ids that are
    taken are warned about and left out.
    """
    found: dict[str, object] = {}
    for path in sorted(Path(folder).glob("*.py")):
        try:
            spec = importlib.util.spec_from_file_location(f"weirflow_plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
        except Exception as error:  # a plug-in may fail in any way
            warn(f"{path.name}: {error}")
            continue
        for name in sorted(vars(module)):
            value = vars(module)[name]
            if not _rule(value):
                continue
            if value.id in rewrite.RULES or value.id in found:
                warn(f"{path.name}: rule {value.id} is defined twice")
                continue
            found[value.id] = value

    def adapt(rule) -> rewrite.Rule:
        def run(text, toks, schemas):
            for start, end, after, reason in rule.analyze(text, toks, schemas):
                yield rewrite.Edit(rule.id, rule.tier, start, end, text[start:end], after, reason)

        return run

    return rewrite.RULES | {k: (found[k].tier, adapt(found[k])) for k in sorted(found)}


def packs(warn: Callable[[str], None] = lambda message: None, points=None) -> dict[str, tuple]:
    """Security rules of installed packs, for `security.scan(..., catalog=...)`.

    A pack is an entry point of the group `PACKS` that loads to {rule id: (content column -> array of matches, SQL files only)}.
    Packs that fail to load and ids that are taken are warned about and left out.
    """
    found: dict[str, tuple] = {}
    for point in sorted(importlib.metadata.entry_points(group=PACKS) if points is None else points, key=lambda p: p.name):
        try:
            rules = dict(point.load())
        except Exception as error:  # a pack may fail in any way
            warn(f"{point.name}: {error}")
            continue
        for name in sorted(rules):
            if name in security.RULES or name in found:
                warn(f"{point.name}: rule {name} is defined twice")
            else:
                found[name] = rules[name]
    return found
