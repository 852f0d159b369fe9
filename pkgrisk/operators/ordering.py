"""Exact order statistics, rank cuts and running sums that do not gather a group in one task.

Hot groups are the rule here (two labels, a handful of sources, one global group), so
nothing below runs a window over a whole group. Each operator first adds up counts per
bucket of the order key (map-side combined), turns the small bucket table into offsets,
and only then looks at rows, bucket by bucket. Numeric keys are divided like a radix sort
divides them, from the leading bits on and only where a stretch holds too many values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.text import group_key
from pkgrisk.session import stored

# Leading hex digits of the order hash used as bucket: 16^4 buckets per stratum.
HASH_DIGITS = 4
# Leading hex digits by which the rows of a stratum are dealt when they meet its cuts.
SALT = "coalesce(substring(_h, 1, 2), '')"
# Distinct values that one task may sort; stretches with more are divided by the next bits of the key.
STRETCH = 1 << 17
# Bits of a key that are left below its first and second digit: 20 and 22 bits, and at most 2^22 values under one.
LEFT = (44, 22)


def hash_cuts(
    df: DataFrame, strata: Sequence[str], order: str, targets: str,
    with_start: bool = False, carry: dict[str, str] | None = None, salted: bool = False, settled: bool = False,
) -> DataFrame:
    """Per stratum, the order hash at given ranks.

    ``order`` is a SQL expression for the hash, ``targets`` one for an array<bigint> of
    ranks over the stratum size ``n`` (0 = before the first row). Returns
    ``_stratum, n, cuts`` with ``cuts[i]`` the hash of the row at rank ``targets[i]``,
    NULL for rank 0. Only rows of buckets that hold a wanted rank are sorted, about
    ``size(targets) / 65536`` of a stratum. ``with_start`` lets ``targets`` use ``start``,
    the rows of all earlier strata; ``carry`` adds aggregates of ``df`` per stratum.
    ``salted`` repeats a stratum's row for every ``_salt`` that its rows have, by which they can be joined evenly.
    ``settled`` starts jobs: bucket counts, edges and cuts are written to the shared folder first, so that their sizes
    are known when joins with rows are planned. Where they are small, no row is shuffled, which adaptive execution
    learns too late: it shuffles both sides of a join before it knows the size of either.
    """
    carry = carry or {}
    base = df.selectExpr(f"{group_key(*strata)} AS _stratum", f"{order} AS _h", "*").selectExpr(
        "*", f"substring(_h, 1, {HASH_DIGITS}) AS _b"
    )
    counts = base.groupBy("_stratum", "_b").agg(
        F.expr("count(*) AS c"), *[F.expr(f"{e} AS {name}") for name, e in carry.items()]
    )
    base = base.select("_stratum", "_h", "_b")
    if settled:
        counts = stored(counts, "counts")
    sizes = counts.groupBy("_stratum").agg(
        F.expr("sum(c) AS n"), *[F.expr(f"max({name}) AS {name}") for name in carry]
    )
    if with_start:
        sizes = sizes.selectExpr("*", "sum(n) OVER (ORDER BY _stratum) - n AS start")
    sizes = sizes.selectExpr("_stratum", "n", f"{targets} AS ks")
    edges = (
        counts.selectExpr("_stratum", "_b", "c", "sum(c) OVER (PARTITION BY _stratum ORDER BY _b) AS upto")
        .join(sizes, "_stratum")
        .selectExpr(
            "_stratum", "_b", "upto - c AS before", "filter(ks, k -> k > upto - c AND k <= upto) AS wanted"
        )
        .filter("size(wanted) > 0")
    )
    if settled:
        edges = stored(edges, "edges")
    ranked = base.join(edges, ["_stratum", "_b"]).selectExpr(
        "*", "before + row_number() OVER (PARTITION BY _stratum, _b ORDER BY _h) AS rank"
    )
    found = (
        ranked.filter("array_contains(wanted, rank)")
        .groupBy("_stratum")
        .agg(F.expr("map_from_entries(collect_set(struct(rank, _h))) AS at"))
    )
    out = sizes.join(found, "_stratum", "left").selectExpr(
        "_stratum", "n", "transform(ks, k -> try_element_at(at, k)) AS cuts"
    )
    if salted:
        # The sum is asked for only so that the exchange of ``counts`` is the same here.
        salts = counts.selectExpr("_stratum", f"{SALT.replace('_h', '_b')} AS _salt", "c").groupBy("_stratum", "_salt").agg(F.expr("sum(c) AS c"))
        out = salts.filter("c > 0").select("_stratum", "_salt").join(out, "_stratum")
    return stored(out, "cuts") if settled else out


def hash_segments(
    df: DataFrame, strata: Sequence[str], order: str, targets: str, out: str = "segment", **options
) -> DataFrame:
    """Number each row by the segment its rank falls in: 0 up to ``targets[0]``, 1 up to ``targets[1]``…

    Keys are expected to be unique within a stratum; exact copies share a hash and so a segment.
    The rows themselves are not shuffled: one comparison with the stratum's cut hashes.
    """
    cuts = hash_cuts(df, strata, order, targets, **options, salted=True)
    tagged = df.selectExpr("*", f"{group_key(*strata)} AS _stratum", f"{order} AS _h").selectExpr("*", f"{SALT} AS _salt")
    passed = F.expr("size(filter(cuts, c -> c IS NULL OR _h > c))")
    return tagged.join(cuts, ["_stratum", "_salt"]).withColumn(out, passed).drop("_stratum", "_salt", "_h", "n", "cuts")


def ordered_bits(key: str, dtype: str) -> str:
    """SQL: a bigint that sorts like the number ``key``; NULL sorts first."""
    if dtype in ("double", "float"):
        bits = f"cast(java_method('java.lang.Double', 'doubleToLongBits', cast({key} AS double)) AS bigint)"
        ordered = f"get(transform(array({bits}), b -> b ^ (shiftright(b, 63) & 9223372036854775807L)), 0)"
        return f"IF({key} IS NULL, -9223372036854775807L - 1, {ordered})"
    return f"coalesce(cast({key} AS bigint), -9223372036854775807L - 1)"


def value_prefix(
    df: DataFrame, key: str, sums: Sequence[str], group: Sequence[str] = (), stretch: int = STRETCH,
    wanted: Callable[[str, str, str], str] | None = None,
) -> DataFrame:
    """Exclusive running sums along a numeric key, equal keys merged.

    ``df`` is first reduced to one row per (group, key). Keys become ordered 64-bit numbers; sums are taken by their
    leading 20 bits, and by the next 22 only inside stretches that hold more than ``stretch`` values. Offsets come from
    windows over such digits, and the only windows over values are those of single stretches: whatever the number of
    values and their distribution, none holds more than 2^22 rows. Adds ``before_<s>`` and ``total_<s>`` for every summed column.

    ``wanted(before, size, total)`` is a SQL condition over the first sum's offset, sum and total of a stretch; where
    it does not hold the stretch is left out: nothing of it is shuffled or sorted.
    """
    group = list(group)
    kind = dict(df.dtypes)[key]
    names, carried = ", ".join([*group, key]), ", ".join([*group, key, *sums])

    def each(template: str) -> str:
        return ", ".join(template.replace("#", s) for s in sums)

    def held(before: str, alias: str = "") -> str:
        return wanted(before.replace("#", sums[0]), f"{alias}_t_{sums[0]}", f"{alias}total_{sums[0]}") if wanted else "true"

    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    # One statement, so it is analysed once. The exchange of ``merged`` is one and the same wherever it is read.
    return df.sparkSession.sql(f"""
        WITH merged AS (
          SELECT *, shiftright(_k, {LEFT[0]}) AS _d, shiftright(_k, {LEFT[1]}) AS _e FROM (
            SELECT *, {ordered_bits(key, kind)} AS _k, {group_key(*group)} AS _g FROM (SELECT {names}, {each('sum(#) AS #')} FROM {{df}} GROUP BY ALL))
        ), tops AS (
          SELECT * FROM (
            SELECT _g, _d, _n > {stretch} AS _large, {each('_t_#')}, {each('sum(_t_#) OVER (PARTITION BY _g) AS total_#')},
              {each(f'coalesce(sum(_t_#) OVER (PARTITION BY _g ORDER BY _d {before}), 0) AS _o_#')}
            FROM (SELECT _g, _d, count(*) AS _n, {each('sum(#) AS _t_#')} FROM merged GROUP BY _g, _d))
          WHERE {held('_o_#')}
        ), subs AS (
          SELECT * FROM (
            SELECT _g, _d, _e, {each('_t_#')}, {each('total_#')}, {each(f'_o_# + coalesce(sum(_t_#) OVER (PARTITION BY _g, _d ORDER BY _e {before}), 0) AS _p_#')}
            FROM (SELECT m._g, m._d, m._e, {each('_o_#')}, {each('total_#')}, {each('sum(#) AS _t_#')}
                  FROM merged m JOIN (SELECT _g, _d, {each('_o_#')}, {each('total_#')} FROM tops WHERE _large) t ON m._g = t._g AND m._d = t._d GROUP BY ALL))
          WHERE {held('_p_#')}
        ), found AS (
          SELECT {carried}, m._g, m._d, NULL AS _e, {each('_o_#')}, {each('total_#')} FROM merged m JOIN tops t ON m._g = t._g AND m._d = t._d WHERE NOT _large
          UNION ALL
          SELECT {carried}, m._g, m._d, m._e, {each('_p_#')}, {each('total_#')} FROM merged m JOIN subs t ON m._g = t._g AND m._d = t._d AND m._e = t._e
        )
        SELECT {carried}, {each(f'_o_# + coalesce(sum(#) OVER (PARTITION BY _g, _d, _e ORDER BY {key} {before}), 0) AS before_#')}, {each('total_#')} FROM found
    """, df=df)


def kth_values(df: DataFrame, key: str, ranks: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Values at 1-based ranks, one row per group with its size ``n``.

    ``ranks`` names each wanted rank by a SQL expression over ``n``. Only stretches of the key that hold a wanted rank
    are refined and sorted.
    """
    def wanted(before: str, size: str, total: str) -> str:
        held = " OR ".join(f"({k}) > {before} AND ({k}) <= {before} + {size}" for k in ranks.values())
        return f"exists(array({total}), n -> {held})"

    prefix = value_prefix(df.selectExpr(*group, key, "1L AS _c"), key, ["_c"], group, wanted=wanted)
    prefix = prefix.withColumnRenamed("total__c", "n")
    return prefix.groupBy(*group).agg(
        F.expr("max(n) AS n"),
        *[
            F.expr(f"max(IF({k} > before__c AND {k} <= before__c + _c, {key}, NULL)) AS {name}")
            for name, k in ranks.items()
        ],
    )


def salted_prefix_prune(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    size: str,
    within: str | None,
    tiebreak: str,
    salts: int = 1024,
) -> DataFrame:
    """Rows of a group, in order, while ``within`` holds for the running size.

    ``within`` is a SQL condition over ``sum_before`` and the row; it must turn false once
    and stay false as the sum grows. Then a row that fails on the sum over its own salt's
    rows alone also fails on the whole group, so each of ``salts`` slices is cut first;
    what survives per group is at most ``salts`` budgets. Exact for groups of any size.
    Without a condition all rows stay, unsummed.
    """
    if within is None:
        return df
    by = ", ".join(group)
    salted = df.selectExpr("*", f"pmod(xxhash64({tiebreak}), {salts}) AS _salt")
    local = salted.selectExpr(
        "*", f"sum({size}) OVER (PARTITION BY {by}, _salt ORDER BY {order}) - {size} AS sum_before"
    ).filter(within).drop("sum_before", "_salt")
    return local.selectExpr(
        "*", f"sum({size}) OVER (PARTITION BY {by} ORDER BY {order}) - {size} AS sum_before"
    ).filter(within)


def segmented_lag(
    df: DataFrame, group: Sequence[str], segment: str, order: str, value: str, out: str
) -> DataFrame:
    """Previous value within a group, computed segment by segment.

    Each (group, segment) is a separate window; the first row of a segment takes the last
    value of the nearest earlier segment from a table with one row per segment.
    """
    group = list(group)
    by = ", ".join(group)
    tagged = df.selectExpr("*", f"{segment} AS _seg", f"{value} AS _val")
    carried = tagged.groupBy(*group, "_seg").agg(F.expr(f"max_by(_val, struct({order})) AS _last")).selectExpr(
        *group, "_seg", f"lag(_last) OVER (PARTITION BY {by} ORDER BY _seg) AS _carry"
    )
    inner = tagged.selectExpr("*", f"lag(_val) OVER (PARTITION BY {by}, _seg ORDER BY {order}) AS _prev")
    return (
        inner.join(carried, group + ["_seg"], "left")
        .withColumn(out, F.expr("coalesce(_prev, _carry)"))
        .drop("_seg", "_val", "_prev", "_carry")
    )
