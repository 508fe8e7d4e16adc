"""Layered settings: defaults, a global file, a workspace's file, then the environment."""

from __future__ import annotations

from collections.abc import Mapping


def merged(*layers: Mapping) -> dict:
    """Nested mappings, later ones winning leaf by leaf."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = merged(out[key], value) if both else (merged(value) if isinstance(value, Mapping) else value)
    return out


def from_environment(environment: Mapping[str, str], prefix: str = "LEAFMILL_") -> dict:
    """LEAFMILL_SECTION__KEY=value as {section: {key: value}}; numbers and truth values are read as such."""
    out: dict = {}
    for name, text in environment.items():
        if name.startswith(prefix):
            *path, leaf = name[len(prefix) :].lower().split("__")
            at = out
            for part in path:
                at = at.setdefault(part, {})
            at[leaf] = _value(text)
    return out


def _value(text: str):
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
