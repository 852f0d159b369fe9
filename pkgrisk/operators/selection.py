"""Choosing files of a package and packing them into a character budget.

Per-package lists are cut to a handful of rows by a rank filter before anything is
collected; Spark applies that limit before the shuffle, so a package with very many
files does not reach one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.sql import regex, texts
from pkgrisk.functions.text import newline_count, suffix
from pkgrisk.functions.variant import object_at, parse, string_of
from pkgrisk.operators.features import INSTALL_HOOKS, SEPARATOR
from pkgrisk.operators.ordering import salted_prefix_prune
from pkgrisk.operators.predicates import in_node_modules

# Files of a package at most and file-name lists of the selection styles.
MAX_FILES = 6
HOOK_FILES = ("preinstall.js", "install.js", "postinstall.js")
PREFERRED_SUFFIXES = (".js", ".cjs", ".mjs", ".ts", ".json")
SOURCE_SUFFIXES = (".js", ".ts", ".cjs", ".mjs", ".jsx", ".tsx")
SOURCE_DIRS = ("src/", "lib/", "")
MIN_REMAINDER = 200
CHARS_PER_TOKEN = 4


def first_bytes(content: str, n: int) -> str:
    """Text of the first ``n`` bytes, a cut character replaced."""
    return (
        f"IF(octet_length({content}) <= {n}, {content}, "
        f"make_valid_utf8(cast(left(cast({content} AS binary), {n}) AS string)))"
    )


def top_files(files: DataFrame, k: int = 3, head_bytes: int | None = None) -> DataFrame:
    """The ``k`` JavaScript files with most lines per package, ``rank`` from 1; path breaks ties.

    Lines are counted in the whole file, or in its first ``head_bytes`` bytes if that is asked for.
    """
    body = "content" if head_bytes is None else first_bytes("content", head_bytes)
    js = files.filter(f"{suffix('path')} = '.js' AND NOT {in_node_modules('path')}")
    return js.selectExpr("*", f"{newline_count(body)} AS n_lines").selectExpr(
        "*", "row_number() OVER (PARTITION BY package ORDER BY n_lines DESC, path) AS rank"
    ).filter(f"rank <= {k}")


def script_references(files: DataFrame, hooks: tuple[str, ...], strip: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Paths named in the manifest's hook commands: ``package, path, ord`` in hook and token order."""
    meta = files.filter("path = 'package.json'").selectExpr(
        "package", f"{object_at(parse('content'), '$.scripts')} AS scripts"
    )
    commands = meta.selectExpr("package", f"posexplode(array({texts(hooks)})) AS (hook_no, hook)", "scripts").selectExpr(
        "package", "hook_no", f"{string_of('try_element_at(scripts, hook)')} AS command"
    )
    tokens = commands.selectExpr("package", "hook_no", r"posexplode(split(trim(command), '\\s+')) AS (token_no, token)")
    cleaned = f"regexp_replace(token, {regex(f'^[{strip}]+|[{strip}]+$')}, '')"
    return tokens.selectExpr("package", f"{cleaned} AS path", "hook_no * 100000 + token_no AS ord").filter(
        f"{suffix('path')} IN ({texts(suffixes)})"
    )


def select_signal_files(files: DataFrame) -> DataFrame:
    """Manifest, root hook files, scripts named by hooks, then the three longest; at most six."""
    refs = (
        script_references(files, HOOK_FILES_HOOKS, "\\x27\"", (".js",))
        .groupBy("package", "path").agg(F.expr("min(ord) AS ord"))
    )
    tagged = files.join(refs, ["package", "path"], "left").selectExpr(
        "*",
        "CASE WHEN path = 'package.json' THEN 0 "
        f"WHEN path IN ({texts(HOOK_FILES)}) THEN 1 WHEN ord IS NOT NULL THEN 2 "
        f"WHEN {suffix('path')} = '.js' AND NOT {in_node_modules('path')} THEN 3 END AS tier",
        f"{newline_count('content')} AS n_lines",
    ).filter("tier IS NOT NULL")
    within = (
        f"tier, CASE tier WHEN 1 THEN array_position(array({texts(HOOK_FILES)}), path) WHEN 2 THEN ord ELSE -n_lines END, path"
    )
    ranked = tagged.selectExpr(
        "*", f"row_number() OVER (PARTITION BY package ORDER BY {within}) AS rank"
    ).filter(f"rank <= {MAX_FILES}")
    named = ranked.selectExpr("*", "count_if(tier < 3) OVER (PARTITION BY package) AS n_named")
    return named.filter("tier < 3 OR rank - n_named <= 3").drop("ord", "n_lines", "n_named")


# Fixed value: hooks whose commands are searched for file names.
HOOK_FILES_HOOKS = ("preinstall", "install", "postinstall")


def select_priority_files(files: DataFrame) -> DataFrame:
    """Manifest first, then scripts by length ascending; at most five besides the manifest."""
    is_manifest = "path = 'package.json'"
    kept = files.filter(f"{is_manifest} OR {suffix('path')} IN ({texts(PREFERRED_SUFFIXES)})")
    return kept.selectExpr(
        "*",
        f"row_number() OVER (PARTITION BY package, {is_manifest} ORDER BY length(content), path) AS _r",
    ).filter(f"_r <= {MAX_FILES - 1}").selectExpr("*", f"IF({is_manifest}, 0, _r) AS rank").drop("_r")


def select_record_files(files: DataFrame) -> DataFrame:
    """Manifest, files named by lifecycle hooks (in order, repeats kept), then the three longest scripts."""
    refs = script_references(files, INSTALL_HOOKS, ";|&\\x27\"`", (".js", ".cjs", ".mjs", ".sh"))
    base = ["package", "path", "content"]
    manifest = files.filter("path = 'package.json'").selectExpr(*base, "0L AS rank")
    named = files.select(*base).join(refs, ["package", "path"]).selectExpr(*base, "cast(1 + ord AS bigint) AS rank")
    longest = top_files(files.select(*base), 3).selectExpr(*base, "1000000000L + rank AS rank")
    return manifest.unionByName(named).unionByName(longest)


def assemble_text(files: DataFrame, style: str = "record", file_bytes: int | None = None, record_chars: int | None = None) -> DataFrame:
    """One text per package from the chosen files, in rank order; whole files unless ``file_bytes`` is given.

    ``record``: bodies joined by the separator, cut at ``record_chars`` if given.
    ``signal``: headed blocks joined by a blank line.
    """
    if style == "record":
        chosen, sep = select_record_files(files), SEPARATOR
        block = "body"
    else:
        chosen, sep = select_signal_files(files), "\\n\\n"
        block = "concat('// === ', path, ' ===\\n', body)"
    body = "content" if file_bytes is None else first_bytes("content", file_bytes)
    bodies = chosen.selectExpr("package", "rank", "path", f"{body} AS body")
    if style == "record":
        bodies = bodies.filter("body <> ''")
    packed = bodies.groupBy("package").agg(
        F.expr(f"array_sort(collect_list(struct(rank, path, {block} AS block))) AS _parts")
    )
    joined = f"array_join(transform(_parts, p -> p.block), '{sep}')"
    if record_chars is not None:
        joined = f"left({joined}, {record_chars})"
    return packed.selectExpr("package", f"{joined} AS text", "size(_parts) AS n_parts")


def pack_budget(files: DataFrame, max_chars: int, order: str = "rank", stop: str = "remainder") -> DataFrame:
    """Files in order until the budget is spent, the last one cut.

    ``stop='remainder'`` ends when at most 200 characters are left, ``stop='full'`` only
    when none are; empty files are then left out. Adds ``body`` and ``sum_before``.
    """
    clipped = files.withColumn("_head", F.expr(f"left(content, {max_chars})"))
    clipped = clipped.drop("content").withColumn("_len", F.expr("cast(length(_head) AS bigint)"))
    if stop == "full":
        keep = f"sum_before < {max_chars}"
        clipped = clipped.filter("_len > 0")
    else:
        keep = f"{max_chars} - sum_before > {MIN_REMAINDER}"
    packed = salted_prefix_prune(clipped, ["package"], f"{order}, path", "_len", keep, "path")
    return packed.withColumn("body", F.expr(f"left(_head, cast({max_chars} - sum_before AS int))")).drop("_head", "_len")


def prompt_order(files: DataFrame) -> DataFrame:
    """Order for review prompts: script-named files, entry points, then source folders; first place wins.

    Adds ``tier`` and ``ord`` to the files of each package except its manifest.
    """
    meta = files.filter("path = 'package.json'").selectExpr("package", f"{parse('content')} AS m")
    in_scripts = f"coalesce(map_values({object_at('m', '$.scripts')}), cast(array() AS array<variant>))"
    in_entries = (
        "concat(array(try_variant_get(m, '$.main', 'variant')), "
        f"coalesce(map_values({object_at('m', '$.bin')}), array(try_variant_get(m, '$.bin', 'variant'))))"
    )
    scripts = meta.selectExpr("package", f"posexplode({in_scripts}) AS (i, v)").selectExpr(
        "package", "i", f"posexplode(regexp_extract_all({string_of('v')}, {regex(r'([\w./\\-]+\.(?:js|cjs|mjs))')}, 1)) AS (j, path)"
    ).selectExpr("package", "path", "0 AS tier", "cast(i * 100000 + j AS bigint) AS ord")
    entries = meta.selectExpr("package", f"posexplode({in_entries}) AS (i, v)").selectExpr(
        "package", f"{string_of('v')} AS path", "1 AS tier", "cast(i AS bigint) AS ord"
    )
    named = scripts.unionByName(entries).withColumn("path", F.expr("regexp_replace(path, '^([.]/)+', '')"))
    best = named.filter("path IS NOT NULL").groupBy("package", "path").agg(
        F.expr("min(struct(tier, ord)) AS place")
    )
    folder = "CASE WHEN startswith(path, 'src/') THEN 0L WHEN startswith(path, 'lib/') THEN 1L ELSE 2L END"
    is_source = f"{suffix('path')} IN ({texts(SOURCE_SUFFIXES)}) AND NOT {in_node_modules('path')}"
    joined = files.filter("path <> 'package.json'").join(best, ["package", "path"], "left")
    return joined.filter(f"place IS NOT NULL OR ({is_source})").selectExpr(
        *files.columns, "coalesce(place.tier, 2) AS tier", f"coalesce(place.ord, {folder}) AS ord"
    )


def code_budget(max_tokens: int, rubric_chars: int, share: float = 0.25) -> int:
    """Characters left for code: both the rubric share and the rubric itself are taken off; at least 2000."""
    total = max_tokens * CHARS_PER_TOKEN
    return max(total - int(total * share) - rubric_chars, 2000)
