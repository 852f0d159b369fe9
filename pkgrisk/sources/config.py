"""Small configuration files: thresholds and template catalogs. They stay on the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pkgrisk.operators.environments import read_config
from pkgrisk.operators.features import ALLOW_BELOW, BLOCK_FROM


def load_thresholds(path: str | None = None) -> dict[str, float]:
    """``allow_below`` and ``block_at_or_above``; defaults where the file is silent."""
    given = read_config(path) or {}
    return {
        "allow_below": float(given.get("allow_below", ALLOW_BELOW)),
        "block_from": float(given.get("block_at_or_above", BLOCK_FROM)),
    }


def load_catalog(path: str) -> dict[str, dict]:
    """``patterns: [{id, severity, files}]`` → by id; entries without id are skipped, none left is an error."""
    raw = read_config(path)
    if not isinstance(raw, Mapping):
        raise ValueError("catalog root must be a mapping")
    entries = raw.get("patterns") or raw.get("attacks") or []
    if not isinstance(entries, list):
        raise ValueError("catalog 'patterns' must be a list")
    out = {
        str(e["id"]): {
            "severity": e.get("severity", "medium"), "files": dict(e.get("files") or {}),
            **{k: list(e[k]) for k in ("edits", "variables") if e.get(k)},
        }
        for e in entries if isinstance(e, Mapping) and e.get("id")
    }
    if not out:
        raise ValueError("catalog holds no usable pattern")
    return out
