"""The type registry as text and as something to edit: small driver-side values, no data."""

from __future__ import annotations

import random
import string
from datetime import datetime


def render(registry: list[tuple[str, str, str]], instructions: list[str]) -> str:
    """Prompt text of ``(kind, name, description)`` rows and instruction lines."""
    parts = []
    for kind, title in (("label", "Node labels"), ("type", "Relationship types")):
        rows = [f"- {name}: {what}" if what else f"- {name}" for k, name, what in registry if k == kind]
        parts.append("\n".join([f"## {title}", *rows]))
    return "\n\n".join([*parts, "\n".join(["## Instructions", *(f"{i}. {x}" for i, x in enumerate(instructions, 1))])])


def inject(template: str, text: str, placeholder: str = "{{SCHEMA}}") -> str:
    """The template with its placeholder filled; there must be exactly one."""
    if template.count(placeholder) != 1:
        raise ValueError(f"{placeholder} occurs {template.count(placeholder)} times, not once")
    return template.replace(placeholder, text)


def update(registry: dict, operations: list[dict]) -> tuple[dict, list[str]]:
    """Registry after add, remove and set operations; its version rises by one only if something changed.

    Removing a label that a dictionary still names gives a warning.
    """
    new = {k: list(v) if isinstance(v, list) else v for k, v in registry.items()}
    warnings = []
    for op in operations:
        kind, value = op["path"], op.get("value")
        if op["op"] == "set":
            new[kind] = value
        elif op["op"] == "add" and value not in new.setdefault(kind, []):
            new[kind].append(value)
        elif op["op"] == "remove":
            key = "label" if kind == "node_labels" else "type"
            new[kind] = [x for x in new.get(kind, []) if (x.get(key) if isinstance(x, dict) else x) != value]
            used = [e for e in new.get("canonical_entities", []) if value in (e["canonical"]["label"], *(v["label"] for v in e["variants"]))]
            used += [o for o in new.get("property_overrides", []) if o["node"]["label"] == value]
            if kind == "node_labels" and used:
                warnings.append(f"{len(used)} dictionary entries still name {value}")
    if new != registry:
        new["schema_version"] = registry.get("schema_version", 0) + 1
    return new, warnings


def new_search_id(now: datetime, draw: random.Random | None = None) -> str:
    """Time stamp and four random characters."""
    pick = draw or random.SystemRandom()
    return f"{now:%Y%m%dT%H%M%S}-" + "".join(pick.choices(string.ascii_lowercase + string.digits, k=4))


def reconnect_delay(attempt: int, opened: bool = True, most_tries: int = 8) -> int | None:
    """Milliseconds before the n-th reconnection; None once a channel that never opened has had its tries."""
    return None if not opened and attempt > most_tries else min(1000 * 2 ** (attempt - 1), 30_000)
