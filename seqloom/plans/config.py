"""Nested settings: files, and overrides merged into them."""

from __future__ import annotations

import json


def merged(base: dict, over: dict) -> dict:
    """base with over's values; dictionaries are merged level by level."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, **over) -> dict:
    """A JSON file, or a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML reader is installed; write the settings as JSON") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    return merged(found or {}, over)
