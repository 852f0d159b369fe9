"""Registry documents of three ecosystems → one release table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.integrity import base64_of_hex
from pkgrisk.functions.names import canonical
from pkgrisk.functions.sql import regex, text, texts
from pkgrisk.functions.variant import array_at, is_array, is_object, node, object_at, string_at, string_of, strings_in_map

RELEASE_COLUMNS = (
    "package", "version", "ecosystem", "published", "scripts", "integrity_hash", "integrity_algo",
    "repository", "git_head", "tarball",
)
# Project-URL keys that may name the repository, in order of preference.
REPOSITORY_KEYS = ("Repository", "Source", "Source Code", "Source-Code", "source", "Code", "GitHub", "Homepage")
# Description hints that stand for install hooks.
SETUP_HINTS = {
    "install_requires_url": r"(?i)install_requires[^\n]*http[s]?://",
    "custom_install_cmd": r"(?i)(?U)cmdclass\s*=\s*\{",
    "post_install_hook": r"(?i)post[_\- ]install",
}


def project_npm(packuments: DataFrame, doc: str = "doc") -> DataFrame:
    """npm packument (VARIANT with ``name, time, versions``) → one row per version."""
    # Each version takes its own time and the name along, so no document is carried into the rows.
    # The map is built inside the explode: as a column of its own it would be computed again
    # by the filter Spark infers for exploded columns.
    entries = (
        f"map_zip_with({object_at(doc, '$.versions')}, coalesce({object_at(doc, '$.time')}, cast(map() AS map<string,variant>)), "
        f"(k, b, t) -> struct(b, t, {string_at(doc, '$.name')} AS name))"
    )
    names = packuments.selectExpr(f"explode({entries}) AS (version, _e)").selectExpr(
        "_e.name AS package", "version", "_e.b AS b", f"{string_of('_e.t')} AS published"
    ).filter(is_object("b"))
    empty = "cast(map() AS map<string,string>)"
    algo = (
        "array_max(filter(transform(split(trim(integrity_hash), '\\\\s+'), w -> lower(substring_index(w, '-', 1))), "
        "a -> a IN ('sha256', 'sha384', 'sha512')))"
    )
    return names.selectExpr(
        "package", "version", "'npm' AS ecosystem", "published",
        f"coalesce({strings_in_map(object_at('b', '$.scripts'))}, {empty}) AS scripts",
        f"{string_at('b', '$.dist.integrity')} AS integrity_hash",
        f"coalesce({string_at('b', '$.repository.url')}, {string_at('b', '$.repository')}) AS repository",
        f"{string_at('b', '$.gitHead')} AS git_head",
        f"coalesce({string_at('b', '$.dist.tarball')}, '') AS tarball",
    ).withColumn("integrity_algo", F.expr(f"coalesce({algo}, 'sha512')")).select(*RELEASE_COLUMNS)


def project_pypi(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """PyPI release document (``info, urls``): wheel before sdist before anything else, first of its kind."""
    listed = (
        f"filter(transform({array_at(doc, '$.urls')}, (u, i) -> named_struct('rank', "
        f"CASE {string_at('u', '$.packagetype')} WHEN 'bdist_wheel' THEN 0 WHEN 'sdist' THEN 1 ELSE 2 END, 'i', i, "
        f"'is_object', {is_object('u')})), x -> x.is_object)"
    )
    staged = docs.selectExpr(
        "*", f"array_min({listed}) AS _best", f"{node(doc, '$.info')} AS _info"
    ).withColumn("_u", F.expr(f"get(try_variant_get({doc}, '$.urls', 'array<variant>'), _best.i)"))
    staged = staged.withColumn("_description", F.expr(f"coalesce({string_at('_info', '$.description')}, '')"))
    candidates = ", ".join(
        f"nullif(trim({string_of(f'try_element_at(_project_urls, {text(k)})')}), '')" for k in REPOSITORY_KEYS
    )
    staged = staged.withColumn("_project_urls", F.expr(object_at("_info", "$.project_urls")))
    is_source = (
        f"{string_at('_u', '$.packagetype')} = 'sdist' OR {string_at('_u', '$.filename')} RLIKE {regex(r'(\.tar\.gz|\.zip)$')}"
    )
    hooks = [f"IF({is_source}, struct('setup_py' AS k, 'python setup.py install' AS v), NULL)"] + [
        f"IF(_best IS NOT NULL AND _description RLIKE {regex(p)}, struct('{n}' AS k, '<sdist hint: {n}>' AS v), NULL)"
        for n, p in SETUP_HINTS.items()
    ]
    return staged.selectExpr(
        f"{canonical(string_at('_info', '$.name'), repr('pypi'))} AS package", f"{string_at('_info', '$.version')} AS version",
        "'pypi' AS ecosystem",
        f"coalesce({string_at('_u', '$.upload_time_iso_8601')}, {string_at('_u', '$.upload_time')}, {string_at('_info', '$.upload_time')}) AS published",
        f"map_from_entries(array_compact(array({', '.join(hooks)}))) AS scripts",
        f"lower({string_at('_u', '$.digests.sha256')}) AS integrity_hash", "'sha256' AS integrity_algo",
        f"coalesce({candidates}, nullif(trim({string_at('_info', '$.home_page')}), '')) AS repository",
        "cast(NULL AS string) AS git_head", f"coalesce({string_at('_u', '$.url')}, '') AS tarball",
    ).select(*RELEASE_COLUMNS)


def project_composer(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Packagist document (``packages: {name: [blocks]}``) → one row per block; ``version_normalized`` kept."""
    blocks = docs.selectExpr(f"explode({object_at(doc, '$.packages')}) AS (package, list)").filter(is_array("list")).selectExpr("package", "explode(try_variant_get(list, '$', 'array<variant>')) AS b").filter(is_object("b"))
    scripts = object_at("b", "$.scripts")
    joined = (
        f"array_join(filter(transform(try_variant_get(x, '$', 'array<variant>'), c -> {string_of('c')}), c -> c IS NOT NULL), ' && ')"
    )
    flat = f"transform_values({scripts}, (k, x) -> IF({is_array('x')}, nullif({joined}, ''), {string_of('x')}))"
    return blocks.selectExpr(
        "lower(trim(package)) AS package", f"{string_at('b', '$.version')} AS version",
        f"{string_at('b', '$.version_normalized')} AS version_normalized", "'composer' AS ecosystem",
        f"{string_at('b', '$.time')} AS published",
        f"coalesce(map_filter({flat}, (k, v) -> v IS NOT NULL), cast(map() AS map<string,string>)) AS scripts",
        f"lower({string_at('b', '$.dist.shasum')}) AS integrity_hash", "'sha1' AS integrity_algo",
        f"coalesce({string_at('b', '$.source.url')}, {string_at('b', '$.homepage')}) AS repository",
        "cast(NULL AS string) AS git_head", f"coalesce({string_at('b', '$.dist.url')}, '') AS tarball",
    )


def unify_releases(*projections: DataFrame) -> DataFrame:
    """Union with the declared digest in one form: SRI, hex turned to base64, sha1 as ``sha1-hex:``."""
    out = projections[0].select(*RELEASE_COLUMNS)
    for p in projections[1:]:
        out = out.unionByName(p.select(*RELEASE_COLUMNS))
    sri = f"({texts(('sha512', 'sha384', 'sha256'))})"
    is_hex = "integrity_hash RLIKE '^([0-9a-fA-F]{2})+$'"
    return out.withColumn("integrity", F.expr(
        f"CASE WHEN coalesce(integrity_hash, '') = '' THEN NULL "
        f"WHEN integrity_algo IN {sri} THEN IF({is_hex}, concat(integrity_algo, '-', {base64_of_hex('integrity_hash')}), integrity_hash) "
        "ELSE concat(integrity_algo, '-hex:', integrity_hash) END"
    ))
