"""Per-environment policy knobs and their configuration overlay."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

from pkgrisk.functions.sql import number, text

FALLBACK = "preprod"


@dataclass(frozen=True)
class Environment:
    name: str
    min_release_age_days: int
    install_scripts: str  # allow | warn | deny
    require_source_match: bool
    require_checksum: bool
    fail_open_on_audit_error: bool
    block_threshold: float
    log_only: bool = False


# The three built-in environments.
DEFAULTS: dict[str, Environment] = {
    "dev": Environment("dev", 0, "warn", False, False, True, 0.5, True),
    "preprod": Environment("preprod", 7, "deny", True, True, False, 0.3, False),
    "prod": Environment("prod", 14, "deny", True, True, False, 0.2, False),
}
# An environment known only from configuration starts from these.
NEW_ENVIRONMENT = Environment("", 7, "deny", True, True, False, 0.3, False)
_WORDS = {
    **dict.fromkeys(("true", "yes", "1", "on"), True),
    **dict.fromkeys(("false", "no", "0", "off"), False),
}


def _to_bool(value: object, default: bool) -> bool:
    if isinstance(value, (bool, int, float)):
        return bool(value)
    if isinstance(value, str):
        return _WORDS.get(value.strip().lower(), default)
    return default


def _overlay(base: Environment, given: Mapping[str, object]) -> Environment:
    changed: dict[str, object] = {}
    for f in fields(Environment):
        if f.name == "name" or f.name not in given:
            continue
        old, new = getattr(base, f.name), given[f.name]
        if isinstance(old, bool):
            changed[f.name] = _to_bool(new, old)
        elif f.name == "install_scripts":
            changed[f.name] = new if new in ("allow", "warn", "deny") else old
        else:
            changed[f.name] = type(old)(new)
    return replace(base, **changed)


def resolve(config: Mapping | None = None) -> dict[str, Environment]:
    """Built-in environments overlaid with ``config['environments']``; broken new entries are left out."""
    known = dict(DEFAULTS)
    section = (config or {}).get("environments")
    if not isinstance(section, Mapping):
        return known
    for name, given in section.items():
        if not isinstance(given, Mapping):
            continue
        if name in known:
            known[name] = _overlay(known[name], given)
            continue
        try:
            known[name] = _overlay(replace(NEW_ENVIRONMENT, name=name), given)
        except (TypeError, ValueError):
            continue
    return known


def load(path: str | None) -> dict[str, Environment]:
    """Environments from a small YAML or JSON file; the defaults only where no path is given."""
    return resolve(read_config(path))


def read_config(path: str | None) -> dict | None:
    """A small YAML or JSON document, read by Spark so that any path the cluster knows will do.

    A file that is missing or broken raises an error: policy must not change without notice.
    """
    if path is None:
        return None
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("configuration is read through the active Spark session, and there is none")
    content = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        out = json.loads(content)
    except ValueError:
        import yaml

        out = yaml.safe_load(content)
    if out is not None and not isinstance(out, Mapping):
        raise ValueError(f"{path} does not hold a mapping")
    return out


def pick(envs: Mapping[str, Environment], name: str) -> Environment:
    return envs.get(name, envs[FALLBACK])


def as_sql(env: Environment) -> str:
    """The environment as a SQL struct literal."""
    items = (
        f"'{f.name}', " + (text(v) if isinstance(v := getattr(env, f.name), str) else number(v))
        for f in fields(Environment)
    )
    return f"named_struct({', '.join(items)})"
