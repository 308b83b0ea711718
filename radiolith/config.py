"""Layered configurations of a run: overlays, overrides by dotted path, fingerprints.

Files are JSON, or YAML where a parser for it is installed.
"""

from __future__ import annotations

import copy
import hashlib
import json

try:
    import yaml
except ImportError:  # YAML is optional; JSON is always there
    yaml = None


def merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: mappings merge, all else is replaced.  Where ``over`` names a component and gives its params, those
    replace the old ones whole, since they belong to that component."""
    out = copy.deepcopy(base)
    own_params = "name" in over and "params" in over
    for key, value in over.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict) and not (own_params and key == "params"):
            out[key] = merge(out[key], value)
        else:
            out[key] = copy.deepcopy(value)
    return out


def scalar(text: str):
    """The value that a command-line override means."""
    if yaml is not None:
        return yaml.safe_load(text)
    try:
        return json.loads(text)
    except ValueError:
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def set_path(config: dict, path: str, value) -> None:
    """Set a value by dotted path, making mappings on the way; a path through what is no mapping is a ValueError."""
    *parents, last = path.split(".")
    for key in parents:
        if not isinstance(config.setdefault(key, {}), dict):
            raise ValueError(f"{path}: {key} holds no mapping")
        config = config[key]
    config[last] = value


def load_config(paths: list[str], overrides: list[str] = ()) -> dict:
    """Files laid on one another from left to right, then overrides 'a.b=value'."""
    out: dict = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        value = json.loads(text) if yaml is None or path.endswith(".json") else yaml.safe_load(text)
        if value is None:
            value = {}
        if not isinstance(value, dict):
            raise TypeError(f"{path} holds no mapping")
        out = merge(out, value)
    for item in overrides:
        key, eq, value = item.partition("=")
        if not eq or not key:
            raise ValueError(f"override {item!r} isn't of the form key=value")
        set_path(out, key, scalar(value))
    return out


def save_config(config: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        if yaml is not None and not path.endswith(".json"):
            yaml.safe_dump(config, f, sort_keys=False, allow_unicode=True)
        else:
            json.dump(config, f, indent=1, ensure_ascii=False)


def fingerprint(config: dict) -> str:
    """Twelve hex digits that name a configuration whatever the order of its keys."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:12]
