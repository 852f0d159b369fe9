"""Labelled variants of benign packages from inert placeholder templates.

Templates are configuration: they carry markers, never working payloads. Each variant
gets the package's files plus the template's files and edits, with variables filled from hashes.

A catalog entry: ``severity``; ``files`` (path → text); ``edits``, a list of ``path``, ``op`` and

* ``append``: ``content`` goes behind the file, which is made if there is none,
* ``replace``: every ``find`` becomes ``replace``,
* ``merge_json``: ``patch`` is merged into the object, level by level; anything else counts as an empty object;

and ``variables``, a list of ``name`` with ``choices`` or ``value``, else eight characters of a hash. Texts may hold
``{{NAME}}`` and ``{rand:N}``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.sql import text
from pkgrisk.functions.variant import object_at, parse
from pkgrisk.operators.splits import weighted_draws

# Weight per severity word.
SEVERITY_WEIGHT = {"low": 2, "medium": 5, "high": 8, "critical": 10}

PLACES = ("north", "south", "east")

# Inert sample catalog.
SAMPLE_CATALOG: dict[str, dict] = {
    "marker-install": {"severity": "critical", "files": {"postinstall.js": "// placeholder {{TOKEN}}\nvar _p_note = 1;\n"}},
    "marker-lib": {
        "severity": "medium", "files": {"lib/extra.js": "// placeholder {{TOKEN}} {{PLACE}}\n"},
        "edits": [{"path": "package.json", "op": "merge_json", "patch": {"scripts": {"note": "echo {{TOKEN}} {{MARK}}"}, "marked": True}}],
        "variables": [{"name": "MARK", "value": "fixed"}],
    },
    "marker-doc": {
        "severity": "low", "files": {"NOTES.md": "placeholder {{TOKEN}}\n"},
        "edits": [
            {"path": "README.md", "op": "append", "content": "see {{PLACE}}\n"},
            {"path": "package.json", "op": "replace", "find": "install", "replace": "marker {{TOKEN}}"},
        ],
    },
}
_MARK = re.compile(r"(\{\{[A-Za-z0-9_]+\}\}|\{rand(?::[0-9]+)?\})")


def weights(catalog: Mapping[str, Mapping]) -> dict[str, int]:
    return {k: SEVERITY_WEIGHT[str(v.get("severity", "medium"))] for k, v in catalog.items()}


def plan_variants(packages: DataFrame, catalog: Mapping[str, Mapping], multiplier: int, seed: int) -> DataFrame:
    """``package, variant, pattern_id, variant_package, token, place``: provenance of every variant."""
    drawn = weighted_draws(packages.select("package"), weights(catalog), multiplier, seed)
    h = f"sha2(concat_ws('|', '{seed}', package, cast(draw AS string), item), 256)"
    places = ", ".join(text(p) for p in PLACES)
    return drawn.selectExpr(
        "package", "draw AS variant", "item AS pattern_id", "concat(item, '/', package, '__v', draw) AS variant_package",
        f"substring({h}, 1, 8) AS token",
        f"element_at(array({places}), cast(conv(substring({h}, 9, 4), 16, 10) AS int) % {len(PLACES)} + 1) AS place",
    )


def _random(length: int, salt: str) -> str:
    """SQL: ``length`` hexadecimal characters that depend on the variant and the place in the catalog."""
    parts = [f"sha2(concat(variant_package, '|', token, {text(salt)}, '{k}'), 256)" for k in range(-(-length // 64))]
    return f"substring(concat({', '.join(parts)}), 1, {length})" if parts else "''"


def _rendered(template: str, values: Mapping[str, str], salt: str) -> str:
    """SQL for a template: its literal parts, variables and random characters; unknown names stay as they are."""
    out = []
    for k, part in enumerate(_MARK.split(template)):
        if part.startswith("{{") and part[2:-2] in values:
            out.append(values[part[2:-2]])
        elif part.startswith("{rand"):
            out.append(_random(int(part[6:-1]) if ":" in part else 6, f"{salt}/{k}"))
        elif part:
            out.append(text(part))
    return f"concat({', '.join(out)})" if out else "''"


def _values(pattern: str, entry: Mapping) -> dict[str, str]:
    """SQL for each variable of a pattern."""
    out: dict[str, str] = {"TOKEN": "token", "PLACE": "place"}
    for variable in entry.get("variables") or ():
        name, salt = str(variable.get("name") or ""), f"{pattern}:{variable.get('name')}"
        if variable.get("choices"):
            options = ", ".join(_rendered(str(c), {}, salt) for c in variable["choices"])
            draw = f"cast(conv(substring({_random(8, salt)}, 1, 7), 16, 10) AS int)"
            out[name] = f"element_at(array({options}), {draw} % {len(variable['choices'])} + 1)"
        elif "value" in variable:
            out[name] = _rendered(str(variable["value"]), {}, salt)
        elif name not in out:
            out[name] = _random(8, salt)
    return out


def _json_value(value: object, values: Mapping[str, str], salt: str) -> str:
    """SQL for a patch value as VARIANT."""
    if isinstance(value, Mapping):
        return _merged("cast(map() AS map<string,variant>)", value, values, salt)
    if isinstance(value, (list, tuple)):
        items = ", ".join(_json_value(x, values, f"{salt}/{k}") for k, x in enumerate(value))
        return f"parse_json(to_json(array({items})))" if items else "parse_json('[]')"
    if isinstance(value, str):
        return f"to_variant_object(named_struct('v', {_rendered(value, values, salt)})):v"
    return "parse_json('null')" if value is None else f"parse_json({text(str(value).lower() if isinstance(value, bool) else repr(value))})"


def _merged(base: str, patch: Mapping, values: Mapping[str, str], salt: str) -> str:
    """SQL: the object ``base`` (map<string,variant>) with the patch merged in, as VARIANT."""
    pairs = []
    for key, value in patch.items():
        if isinstance(value, Mapping):
            inner = f"coalesce(try_variant_get(try_element_at({base}, {text(key)}), '$', 'map<string,variant>'), cast(map() AS map<string,variant>))"
            pairs.append(f"{text(key)}, {_merged(inner, value, values, f'{salt}/{key}')}")
        else:
            pairs.append(f"{text(key)}, {_json_value(value, values, f'{salt}/{key}')}")
    keys = ", ".join(text(k) for k in patch)
    kept = f"map_filter({base}, (k, x) -> k NOT IN ({keys}))" if keys else base
    return f"parse_json(to_json(map_concat({kept}, map({', '.join(pairs)}))))" if pairs else f"parse_json(to_json({base}))"


def _edited(content: str, edit: Mapping, values: Mapping[str, str], salt: str) -> str:
    """SQL for a file's text after one edit; a file that is not there is NULL."""
    op = edit.get("op", "append")
    if op == "append":
        return f"concat(coalesce({content}, ''), {_rendered(str(edit.get('content', '')), values, salt)})"
    if op == "replace":
        return f"replace({content}, {text(str(edit.get('find', '')))}, {_rendered(str(edit.get('replace', '')), values, salt)})"
    if op == "merge_json":
        base = f"coalesce({object_at(parse(content), '$')}, cast(map() AS map<string,variant>))"
        return f"to_json({_merged(base, edit.get('patch') or {}, values, salt)})"
    raise ValueError(f"unknown edit {op!r}")


def augment(packages: DataFrame, files: DataFrame, catalog: Mapping[str, Mapping], multiplier: int, seed: int) -> DataFrame:
    """Files of every variant: ``variant_package, pattern_id, source_benign, label, path, content``.

    Template files replace a package file of the same path; ``_p_`` identifiers are renamed
    to a token of the variant, so variants differ. Edits follow, in the order of the catalog.
    """
    plan = plan_variants(packages, catalog, multiplier, seed)
    known = {pid: _values(pid, entry) for pid, entry in catalog.items()}
    bodies = ", ".join(
        f"IF(pattern_id = {text(pid)}, named_struct('path', {text(path)}, 'body', {_rendered(body, known[pid], f'{pid}:{path}')}), NULL)"
        for pid, entry in catalog.items() for path, body in (entry.get("files") or {}).items()
    )
    columns = ["variant_package", "pattern_id", "package AS source_benign", "token", "place", "path"]
    none = "cast(array() AS array<struct<path:string,body:string>>)"
    new = plan.selectExpr("*", f"inline(array_compact({f'array({bodies})' if bodies else none})) AS (path, body)").selectExpr(
        *columns, "regexp_replace(body, r'\\b_p_([A-Za-z0-9_]+)\\b', concat('_v_', token, '_$1')) AS content"
    )
    kept = plan.join(files.select("package", "path", "content"), "package").selectExpr(*columns, "content")
    merged = kept.join(new.select("variant_package", "path"), ["variant_package", "path"], "left_anti").unionByName(new)

    # places that an edit may fill although the package has no such file
    edits = [(pid, k, e) for pid, entry in catalog.items() for k, e in enumerate(entry.get("edits") or ()) if e.get("path")]
    made = sorted({(pid, e["path"]) for pid, _, e in edits if e.get("op", "append") != "replace"})
    if made:
        slots = ", ".join(f"IF(pattern_id = {text(pid)}, {text(path)}, NULL)" for pid, path in made)
        empty = plan.selectExpr("*", f"explode(array_compact(array({slots}))) AS path").selectExpr(*columns, "cast(NULL AS string) AS content")
        merged = merged.unionByName(empty.join(merged.select("variant_package", "path"), ["variant_package", "path"], "left_anti"))
    for pid, k, e in edits:
        after = _edited("content", e, known[pid], f"{pid}#{k}")
        merged = merged.withColumn("content", F.expr(f"CASE WHEN pattern_id = {text(pid)} AND path = {text(e['path'])} THEN {after} ELSE content END"))
    return merged.drop("token", "place").withColumn("label", F.lit(1))
