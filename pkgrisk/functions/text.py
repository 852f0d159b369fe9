"""SQL fragments over strings: quoting, order hashes, entropy, file-name parts."""

from __future__ import annotations

from pkgrisk.functions.sql import regex, text


def quoted(value: str) -> str:
    """Value in quotes for evidence text: single quotes, double if it holds one, None for NULL."""
    body = (
        f"replace(replace(replace(replace({value}, '\\\\', '\\\\\\\\'), '\\n', '\\\\n'), "
        f"'\\r', '\\\\r'), '\\t', '\\\\t')"
    )
    return (
        f"CASE WHEN {value} IS NULL THEN 'None' "
        f"WHEN contains({value}, '\\'') AND NOT contains({value}, '\"') THEN concat('\"', {body}, '\"') "
        f"ELSE concat('\\'', replace({body}, '\\'', '\\\\\\''), '\\'') END"
    )


def order_hash(seed: int | str, *cols: str) -> str:
    """Deterministic pseudo-random order key: SHA-256 of ``seed|c1|c2...`` as hex."""
    parts = ", ".join(f"coalesce(cast({c} AS string), '')" for c in cols)
    return f"sha2(concat_ws('|', {text(str(seed))}, {parts}), 256)"


def unit_interval(hex_digest: str) -> str:
    """First 12 hex digits of a digest as a double in [0, 1)."""
    return f"(cast(conv(substring({hex_digest}, 1, 12), 16, 10) AS double) / {16**12}D)"


def group_key(*cols: str) -> str:
    """One never-NULL string for a tuple of columns, NULL distinct from the empty string."""
    if not cols:
        return "''"
    parts = ", ".join(f"coalesce(concat('v', cast({c} AS string)), 'n')" for c in cols)
    return f"concat_ws('\\u0001', {parts})"


def shannon_entropy(value: str) -> str:
    """Bits per character; 0 for NULL or empty text.

    Characters are sorted once and equal runs taken by one regular expression, so long texts do not cost one scan per
    distinct character, and lambdas run once per distinct character only.
    """
    runs = f"regexp_extract_all(array_join(sort_array(split({value}, '')), ''), {regex(r'(?s)(.)\1*')}, 0)"
    bits = f"-aggregate({runs}, 0D, (s, r) -> s + (length(r) / n) * log2(length(r) / n))"
    n = f"array(cast(length({value}) AS double))"
    return f"IF(coalesce(length({value}), 0) = 0, 0D, get(transform({n}, n -> {bits}), 0))"


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def suffix(path: str) -> str:
    """Last dotted suffix of the file name in lower case; leading-dot names have none."""
    return f"lower(regexp_extract({path}, {regex(r'[^/](\.[^./]+)$')}, 1))"


def stem(path: str) -> str:
    """File name without its last suffix."""
    return f"regexp_replace({base_name(path)}, {regex(r'^(.+)\.[^.]+$')}, '$1')"


def newline_count(value: str) -> str:
    return f"(length({value}) - length(replace({value}, '\\n', '')))"
