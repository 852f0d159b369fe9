"""Subresource-integrity strings: strongest alternative, digest, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.sql import texts
from pkgrisk.functions.text import quoted

# Supported algorithms, strongest first.
ALGORITHMS = ("sha512", "sha384", "sha256", "sha1")


def strongest(integrity: str) -> str:
    """struct<strength, pos, algo, digest, is_hex> of the strongest alternative, NULL if none fits."""
    words = f"filter(split(trim(regexp_replace({integrity}, r'(?U)\\s+', ' ')), ' '), w -> contains(w, '-'))"
    rest = "substring(w, instr(w, '-') + 1)"
    algo = "lower(trim(substring_index(w, '-', 1)))"
    parsed = (
        f"transform({words}, (w, i) -> named_struct('strength', array_position(array({texts(ALGORITHMS)}), {algo}), "
        f"'pos', i, 'algo', {algo}, "
        f"'digest', trim(IF(startswith({rest}, 'hex:'), substring({rest}, 5), {rest})), "
        f"'is_hex', startswith({rest}, 'hex:')))"
    )
    return f"array_min(filter({parsed}, s -> s.strength > 0 AND s.digest <> ''))"


def digest_hex(content: str, algo: str) -> str:
    return (
        f"CASE {algo} WHEN 'sha512' THEN sha2({content}, 512) WHEN 'sha384' THEN sha2({content}, 384) "
        f"WHEN 'sha256' THEN sha2({content}, 256) WHEN 'sha1' THEN sha1({content}) END"
    )


def base64_of_hex(hex_text: str) -> str:
    """Base64 of a hex digest on one line (the built-in breaks lines at 76 characters)."""
    return f"regexp_replace(base64(unhex({hex_text})), '[\\r\\n]', '')"


def add_verification(df: DataFrame, integrity: str, content: str, out: str = "check") -> DataFrame:
    """Add ``out`` = struct<algo, expected, actual, error, matches>, hashing the bytes once per row.

    Successive projections, because each step is used several times by the next.
    """
    unpadded = "regexp_replace(trim({}), '=+$', '')".format
    error = (
        f"CASE WHEN {integrity} IS NULL OR {integrity} = '' THEN 'integrity is empty or not a string' "
        f"WHEN _best IS NULL THEN concat('no supported algorithm in integrity string: ', {quoted(integrity)}) END"
    )
    return (
        df.withColumn("_best", F.expr(strongest(integrity)))
        .withColumn("_hex", F.expr(digest_hex(content, "_best.algo")))
        .withColumn("_exp", F.expr("IF(_best.is_hex, lower(_best.digest), _best.digest)"))
        .withColumn("_act", F.expr(f"IF(_best.is_hex, _hex, {base64_of_hex('_hex')})"))
        .withColumn(out, F.expr(
            f"named_struct('algo', coalesce(_best.algo, 'sha512'), 'expected', coalesce(_exp, ''), "
            f"'actual', coalesce(_act, ''), 'error', {error}, 'matches', coalesce("
            f"IF(_best.is_hex, _exp = _act, {unpadded('_exp')} = {unpadded('_act')}), false))"
        ))
        .drop("_best", "_hex", "_exp", "_act")
    )
