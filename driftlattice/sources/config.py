"""Layered configuration: defaults, a user's file, the project's file, environment variables."""

from __future__ import annotations

import copy
import datetime
import json
import os
import re
import tomllib
from pathlib import Path

import yaml

from driftlattice.errors import ConfigError, MissingExpires
from driftlattice.functions.scalars import without_comments

#: Every section with its defaults.
DEFAULTS: dict = {
    "core": {"languages": "auto", "exclude": ["target/**", "node_modules/**", "dist/**", ".git/**", "__pycache__/**", "vendor/**"], "random_seed": 42},
    "snapshots": {"dir": ".driftlattice/snapshots", "retention": 100},
    "boundaries": {"spec_file": ".driftlattice/boundaries.yaml", "leiden_gamma": 1.0, "stability_threshold": 3, "weighted_edges": False, "leiden_min_compression_ratio": 0.1, "leiden_max_recursion_depth": 32},
    "patterns": {"categories": "auto", "min_pattern_nodes": 5, "scope_exclude": []},
    "thresholds": {"pattern_entropy_rate": 2.0, "convention_drift_rate": 3.0, "coupling_delta_rate": 0.15, "boundary_violation_rate": 2.0, "overrides": {}},
    "change_coupling": {"min_frequency": 0.6, "history_depth": 500},
    "output": {"format": "text", "color": "auto"},
    "determinism": {"enforce_btree_order": True},
    "bindings": {},
}
RATES = ("pattern_entropy_rate", "convention_drift_rate", "coupling_delta_rate", "boundary_violation_rate")
ENVIRONMENT = {"DRIFTLATTICE_LOG_LEVEL": None, "DRIFTLATTICE_SNAPSHOT_DIR": ("snapshots", "dir"), "NO_COLOR": ("output", "color")}


def date_fault(text: str) -> str | None:
    """Why a text is not a date of the form 2026-04-29; February may have 29 days in any year."""
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", text)
    if not m:
        return "expected YYYY-MM-DD"
    year, month, day = map(int, m.groups())
    if year < 1970 or not 1 <= month <= 12:
        return "year or month out of range"
    most = 29 if month == 2 else 30 if month in (4, 6, 9, 11) else 31
    return None if 1 <= day <= most else "day out of range"


def merged(base: dict, layer: dict) -> dict:
    """base with the keys of layer, section by section; overrides of thresholds category by category."""
    out = copy.deepcopy(base)
    for section, values in layer.items():
        if not isinstance(values, dict):
            raise ConfigError(f"{section} is not a section", section)
        own = out.setdefault(section, {})
        for key, value in values.items():
            if section == "thresholds" and key == "overrides":
                own["overrides"] = own.get("overrides", {}) | copy.deepcopy(value)
            else:
                own[key] = value
    return out


def checked(config: dict, today: datetime.date | None = None) -> dict:
    """config without expired overrides; ConfigError where it can't be used."""
    b = config["boundaries"]
    if not 0.0 <= b["leiden_min_compression_ratio"] < 1.0:
        raise ConfigError("leiden_min_compression_ratio must be in [0, 1)", "boundaries.leiden_min_compression_ratio")
    if b["leiden_max_recursion_depth"] < 1:
        raise ConfigError("leiden_max_recursion_depth must be at least 1", "boundaries.leiden_max_recursion_depth")
    if not 0.0 <= config["change_coupling"]["min_frequency"] <= 1.0:
        raise ConfigError("min_frequency must be in [0, 1]", "change_coupling.min_frequency")
    today_text = str(today or datetime.date.today())
    kept = {}
    for category, override in config["thresholds"]["overrides"].items():
        if not override.get("expires"):
            raise MissingExpires(f"the override of {category} has no expires", f"thresholds.overrides.{category}.expires")
        if fault := date_fault(str(override["expires"])):
            raise ConfigError(f"the override of {category} expires on {override['expires']!r}: {fault}", f"thresholds.overrides.{category}.expires")
        if str(override["expires"]) >= today_text:
            kept[category] = override
    config["thresholds"]["overrides"] = kept
    return config


def read_toml(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except FileNotFoundError:
        return {}
    except (tomllib.TOMLDecodeError, UnicodeDecodeError, OSError) as e:
        raise ConfigError(f"{path}: {e}") from e


def load_config(root: str | Path, user_file: str | Path | None = None, project_file: str | Path | None = None, env: dict | None = None, today: datetime.date | None = None) -> dict:
    root = Path(root)
    env = dict(os.environ) if env is None else env
    user_file = Path(user_file) if user_file else Path(env.get("XDG_CONFIG_HOME") or Path(env.get("HOME", "/")) / ".config") / "driftlattice/config.toml"
    project_file = Path(project_file) if project_file else root / ".driftlattice/config.toml"
    config = merged(merged(copy.deepcopy(DEFAULTS), read_toml(user_file)), read_toml(project_file))
    for name, place in ENVIRONMENT.items():
        if place and env.get(name):
            config[place[0]][place[1]] = "never" if name == "NO_COLOR" else env[name]
    return checked(config, today)


def init_config(root: str | Path) -> tuple[Path, bool]:
    """Writes the project's configuration with its defaults, if there is none; else checks the one there."""
    path = Path(root) / ".driftlattice/config.toml"
    if path.exists():
        checked(merged(DEFAULTS, read_toml(path)))
        return path, False
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = []
    for section, values in DEFAULTS.items():
        plain = {k: v for k, v in values.items() if not isinstance(v, dict)}
        lines += [f"[{section}]", *(f"{k} = {json.dumps(v)}" for k, v in plain.items()), ""]
    with path.open("x", encoding="utf-8") as f:
        f.write("\n".join(lines))
    return path, True


def read_boundaries(path: str | Path) -> list[dict] | None:
    """The boundaries of a YAML file; None if there is no such file."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return None
    try:
        found = (yaml.safe_load(text) or {}).get("boundaries") or []
        return [{"name": b["name"], "description": b.get("description"), "modules": b.get("modules") or [], "allow_imports_from": b.get("allow_imports_from") or []} for b in found]
    except (yaml.YAMLError, AttributeError, TypeError, KeyError) as e:
        raise ConfigError(f"{path}: {e}") from e


def write_boundaries(path: str | Path, spec: dict) -> bool:
    """Writes a specification in one step; whether comments of an earlier one are lost."""
    path = Path(path)
    lost = path.exists() and any(line.lstrip().startswith("#") for line in path.read_text(encoding="utf-8").splitlines())
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(yaml.safe_dump(spec, sort_keys=False), encoding="utf-8")
    os.replace(part, path)
    return lost


def go_module(root: str | Path) -> str | None:
    try:
        text = (Path(root) / "go.mod").read_text(encoding="utf-8")
    except OSError:
        return None
    m = re.search(r"(?m)^\s*module\s+(\S+)", text)
    return m[1] if m else None


def path_aliases(root: str | Path) -> tuple[str, list[tuple[str, list[str]]]] | None:
    """(base, [(pattern, targets)]) of tsconfig.json, else jsconfig.json; None where neither can be used."""
    for name in ("tsconfig.json", "jsconfig.json"):
        try:
            text = (Path(root) / name).read_text(encoding="utf-8")
        except OSError:
            continue
        return parse_aliases(text)
    return None


def parse_aliases(text: str, folder: str = "") -> tuple[str, list[tuple[str, list[str]]]] | None:
    try:
        options = json.loads(without_comments(text)).get("compilerOptions")
    except (ValueError, AttributeError):
        return None
    if not isinstance(options, dict):
        return None
    url = options.get("baseUrl") if isinstance(options.get("baseUrl"), str) else ""
    base = "/".join(p for p in f"{folder}/{url}".split("/") if p not in ("", ".", ".."))
    paths = options.get("paths") if isinstance(options.get("paths"), dict) else {}
    # keys in the order of their text
    return base, [(k, [t for t in v if isinstance(t, str)] if isinstance(v, list) else []) for k, v in sorted(paths.items()) if k.count("*") <= 1]
