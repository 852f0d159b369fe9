"""The five release rules as SQL fragments: struct<ok, reason>, NULL for "no verdict"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions import dates
from pkgrisk.functions.names import REPOSITORY
from pkgrisk.functions.sql import regex, text, texts
from pkgrisk.functions.text import quoted

# Hooks each ecosystem runs at install time, in report order.
HOOKS = {
    "npm": ("preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly"),
    "composer": (
        "pre-install-cmd", "post-install-cmd", "pre-update-cmd", "post-update-cmd",
        "post-autoload-dump", "pre-autoload-dump", "pre-package-install",
        "post-package-install", "pre-package-update", "post-package-update",
    ),
    "pypi": ("setup_py", "install_requires_url", "custom_install_cmd", "post_install_hook"),
}
# Command heads tolerated per ecosystem.
TRIVIAL_HEADS = {
    "npm": ("node-gyp", "node-gyp-build", "prebuild-install", "echo", "true", "exit"),
    "composer": ("@php", "@composer", "echo", "true", "exit"),
    "pypi": (),
}
# Rules that block, and the order rules are reported in.
BLOCKING = ("release_age", "install_scripts", "known_quarantine")
ORDER = ("known_quarantine", "release_age", "install_scripts", "checksum", "source_match")

# POSIX shell words: bare characters, quoted runs, escaped characters.
_WORD_PART = r"""(?:[^ \t\r\n'"\\]|'[^']*'|"(?:\\[\s\S]|[^"\\])*"|\\[\s\S])"""


def outcome(ok: str, reason: str) -> str:
    return f"named_struct('ok', {ok}, 'reason', {reason})"


def is_trivial_command(command: str, heads: tuple[str, ...]) -> str:
    """Blank, or no shell metacharacter, well quoted, at most three words and a tolerated head."""
    words = f"regexp_extract_all({command}, {regex(f'({_WORD_PART}+)')}, 1)"
    unquote = regex(r"""'([^']*)'|"((?:\\[\s\S]|[^"\\])*)"|\\([\s\S])""")
    tolerated = (
        f"regexp_replace(get({words}, 0), {unquote}, '$1$2$3') IN ({texts(heads)}) AND size({words}) <= 3"
        if heads else "false"
    )
    return (
        f"({command} IS NULL OR {command} RLIKE r'(?U)^\\s*$' OR (NOT {command} RLIKE '[;&|`$<>]' "
        f"AND {command} RLIKE {regex(rf'^(?:[ \t\r\n]|{_WORD_PART})*$')} AND {tolerated}))"
    )


def release_age(published: str, version: str, min_age: str, as_of: str) -> str:
    at = dates.iso_timestamp(published)
    age = dates.age_days(at, as_of)
    line = f"concat('released ', {dates.one_decimal(age)}, 'd ago'"
    return (
        f"CASE WHEN {published} IS NULL OR {published} = '' THEN "
        + outcome("false", f"concat('missing publish timestamp for ', {version})")
        + f" WHEN {at} IS NULL THEN "
        + outcome("false", f"concat('unparseable publish timestamp: ', {quoted(published)})")
        + f" WHEN {age} < {min_age} THEN "
        + outcome("false", f"{line}, ', minimum is ', {min_age}, 'd')")
        + f" ELSE {outcome('true', line + ')')} END"
    )


def install_scripts(scripts: str, ecosystem: str, is_object: str = "true") -> str:
    """Offending hooks in hook order; unknown ecosystems are read as npm."""

    def offenders(eco: str) -> str:
        bad = f"c.cmd <> '' AND NOT {is_trivial_command('c.cmd', TRIVIAL_HEADS[eco])}"
        declared = (
            f"filter(transform(array({texts(HOOKS[eco])}), "
            f"h -> named_struct('hook', h, 'cmd', try_element_at({scripts}, h))), c -> c.cmd IS NOT NULL)"
        )
        return f"transform(filter({declared}, c -> {bad}), c -> concat(c.hook, '=', {quoted('c.cmd')}))"

    # Most releases declare nothing; a binding of one element evaluates the list once.
    listed = (
        f"CASE WHEN {scripts} IS NULL OR size({scripts}) = 0 THEN cast(array() AS array<string>) "
        f"ELSE CASE {ecosystem} WHEN 'pypi' THEN {offenders('pypi')} "
        f"WHEN 'composer' THEN {offenders('composer')} ELSE {offenders('npm')} END END"
    )
    bad = outcome("false", "concat('non-trivial lifecycle scripts: ', array_join(l, '; '))")
    good = outcome("true", "'lifecycle scripts trivial or absent'")
    result = f"get(transform(array({listed}), l -> IF(size(l) > 0, {bad}, {good})), 0)"
    if is_object == "true":
        return result
    return f"IF({is_object}, {result}, {outcome('false', text('scripts field is not an object'))})"


def checksum(declared: str, content: str, check: str) -> str:
    """``check`` is the struct column made by ``integrity.add_verification``."""
    mismatch = (
        f"concat('checksum mismatch: expected ', left({check}.expected, 16), "
        f"'... got ', left({check}.actual, 16), '...')"
    )
    return (
        f"CASE WHEN {declared} IS NULL OR {declared} = '' THEN "
        + outcome("false", "'dist.integrity missing from metadata'")
        + f" WHEN {content} IS NULL THEN "
        + outcome("false", "'tarball bytes not yet fetched; cannot verify'")
        + f" WHEN {check}.error IS NOT NULL THEN "
        + outcome("false", f"concat('integrity parse error: ', {check}.error)")
        + f" WHEN NOT {check}.matches THEN {outcome('false', mismatch)}"
        + " ELSE " + outcome("true", f"concat({check}.algo, ' verified')") + " END"
    )


def known_quarantine(blocked: str, quarantined: str, loaded: bool = True) -> str:
    """``blocked``/``quarantined`` hold the reason, NULL when the key is not in that state."""
    if not loaded:
        return outcome("true", "'no quarantine db loaded'")
    return (
        f"CASE WHEN {blocked} IS NOT NULL THEN "
        + outcome("false", f"concat('explicitly blocked: ', {blocked})")
        + f" WHEN {quarantined} IS NOT NULL THEN "
        + outcome("false", f"concat('explicitly quarantined: ', {quarantined})")
        + f" ELSE {outcome('true', text('not in quarantine db'))} END"
    )


def source_match(
    repository: str, git_head: str, has_bytes: str, compared: str, matched: str, suspicious: str,
    threshold: float = 0.95,
) -> str:
    """Tri-state: NULL without usable pointers, bytes or comparable files."""
    pointer = f"split_part(trim({repository}), '#', 1)"
    ratio = f"({matched} / {compared})"
    pct = f"cast(floor({ratio} * 100) AS bigint)"
    good = (
        f"concat('source-match: ', {pct}, '% of files match upstream repo at sha=', left({git_head}, 7), "
        f"' (', {matched}, '/', {compared}, ')')"
    )
    bad = (
        f"concat('source-match: only ', {pct}, '% of files match (sha=', left({git_head}, 7), '); ', "
        f"{suspicious}, ' suspicious file(s) differ')"
    )
    return (
        f"CASE WHEN {repository} RLIKE '(?i)^(git[+])?(https?|ssh|git)://' AND {git_head} <> '' "
        f"AND {has_bytes} AND {compared} > 0 AND ({pointer} RLIKE {regex(REPOSITORY['github'])} "
        f"OR {pointer} RLIKE {regex(REPOSITORY['gitlab'])}) THEN "
        f"IF({ratio} >= {threshold}D, {outcome('true', good)}, {outcome('false', bad)}) END"
    )


def quarantine_lookup(releases: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``blocked_reason``, ``quarantined_reason`` and ``allowlisted`` from a policy-state table.

    ``state(state, key, reason)`` has one row per state and key; it is turned into one row
    per key, so the join never multiplies releases.
    """
    per_key = state.groupBy("key").agg(
        F.expr("max(IF(state = 'blocked', coalesce(reason, 'no reason'), NULL)) AS blocked_reason"),
        F.expr("max(IF(state = 'quarantined', coalesce(reason, 'no reason'), NULL)) AS quarantined_reason"),
        F.expr("bool_or(state = 'allowlist') AS _allowlisted"),
    )
    keyed = releases.withColumn("key", F.concat_ws("@", "package", "version"))
    joined = keyed.join(per_key, "key", "left")
    return joined.withColumn("allowlisted", F.expr("coalesce(_allowlisted, false)")).drop("key", "_allowlisted")
