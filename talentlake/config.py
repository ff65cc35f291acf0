"""Settings: defaults, overlaid by environment variables, overlaid by a stored document."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

#: Settings of the library with their defaults; a deployment adds its own sections.
DEFAULTS: dict = {
    "ranking": {"top": 50, "max_experience_years": 2.0},
    "filters": {"max_hours": 24.0, "allowed_locations": []},
    "dedup": {"threshold": 0.9, "crowd": 50_000},
    "embedding": {"model": "hashing", "dimensions": 384},
}


def overlaid(base: Mapping, more: Mapping) -> dict:
    """``base`` with the values of ``more``; sections are overlaid key by key."""
    return {**base, **{k: overlaid(base.get(k) or {}, v) if isinstance(v, Mapping) else v for k, v in more.items()}}


def from_environment(prefix: str, environ: Mapping[str, str] | None = None) -> dict:
    """PREFIX_SECTION__KEY=value as {"section": {"key": value}}; values that are JSON are read as such."""
    out: dict = {}
    for name, text in (os.environ if environ is None else environ).items():
        if not name.upper().startswith(f"{prefix.upper()}_"):
            continue
        *path, key = name[len(prefix) + 1 :].lower().split("__")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        at = out
        for step in path:
            at = at.setdefault(step, {})
        at[key] = value
    return out


def load(prefix: str = "TALENTLAKE", stored: Mapping | None = None, environ: Mapping[str, str] | None = None, defaults: Mapping = DEFAULTS) -> dict:
    """The settings in force."""
    return overlaid(overlaid(defaults, from_environment(prefix, environ)), stored or {})
