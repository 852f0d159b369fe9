"""Reproducible splits, folds and samples. Order is a hash of the key, so results do not
depend on row order or partitioning, and sizes follow the stated formulas exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.sql import text_array
from pkgrisk.functions.text import group_key, order_hash, unit_interval
from pkgrisk.operators.ordering import hash_segments


def stratified_split(
    df: DataFrame, strata: Sequence[str], key: str, train: float = 0.7, val: float = 0.15,
    test: float | None = None, seed: int = 42, rounding: str = "floor",
) -> DataFrame:
    """Add ``split``: per stratum the first ``round(n·train)``, next ``round(n·val)``, rest test.

    ``rounding`` is ``floor`` or ``half_even``; fractions given in full must sum to 1.
    """
    if test is not None and abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"split fractions must sum to 1.0, got {train + val + test}")
    f = "floor" if rounding == "floor" else "bround"
    n_train, n_val = f"cast({f}(n * {train!r}D) AS bigint)", f"cast({f}(n * {val!r}D) AS bigint)"
    targets = f"array(least(n, {n_train}), least(n, {n_train} + {n_val}))"
    out = hash_segments(df, strata, order_hash(seed, key), targets, "_seg")
    return out.withColumn("split", F.expr("element_at(array('train', 'val', 'test'), _seg + 1)")).drop("_seg")


def holdout_split(df: DataFrame, key: str, frac: float = 0.05, seed: int = 42, per: Sequence[str] = ()) -> DataFrame:
    """Add ``is_test``: ``max(1, floor(n·frac))`` rows, overall or per group."""
    out = hash_segments(df, per, order_hash(seed, key), f"array(greatest(1L, floor(n * {frac!r}D)))", "_seg")
    return out.withColumn("is_test", F.expr("_seg = 0")).drop("_seg")


def kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, settled: bool = False) -> DataFrame:
    """Add ``fold`` 0..k−1, balanced within every label and over all rows.

    Labels are laid end to end (ordered); fold ``i`` takes as many rows of a label as there
    are positions congruent to ``i`` in its stretch. ``settled`` is that of ``ordering.hash_cuts``.
    """
    # Ranks at which folds end: running counts of positions = i (mod k) in [start, start + n).
    count = f"(floor((start + n + {k - 1} - i) / {k}) - floor((start + {k - 1} - i) / {k}))"
    targets = (
        f"transform(sequence(0, {k - 2}), j -> cast(aggregate(sequence(0, j), 0L, "
        f"(a, i) -> a + cast({count} AS bigint)) AS bigint))"
    )
    return hash_segments(df, [label], order_hash(seed, key), targets, "fold", with_start=True, settled=settled)


def weighted_draws(packages: DataFrame, items: dict[str, int], k: int, seed: int, name: str = "package") -> DataFrame:
    """``k`` draws with replacement per package: ``draw, u, item``; weight is at least 1.

    The item list is configuration, so its cumulative weights are a literal array.
    """
    ids = sorted(items)
    weights = [max(1, items[i]) for i in ids]
    upto, total = [], 0
    for w in weights:
        total += w
        upto.append(total)
    drawn = packages.selectExpr("*", f"explode(sequence(0, {k - 1})) AS draw").withColumn(
        "u", F.expr(unit_interval(order_hash(seed, name, "draw")))
    )
    cumulative = f"array({', '.join(map(str, upto))})"
    return drawn.withColumn("item", F.expr(
        f"get({text_array(ids)}, size(filter({cumulative}, c -> c <= u * {total})))"
    ))


def quota_sample(pairs: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Equal quota ``max(1, n // strata)`` per stratum, then hash order, cut to ``n`` rows."""
    n_strata = pairs.agg(F.expr(f"count(DISTINCT {group_key(stratum)}) AS n_strata"))
    tagged = pairs.join(F.broadcast(n_strata))  # exactly one row
    h = order_hash(seed, key)
    quota = f"array(least(n, greatest(1L, {n}L DIV any_strata)))"
    kept = hash_segments(tagged, [stratum], h, quota, "_seg", carry={"any_strata": "max(n_strata)"})
    return kept.filter("_seg = 0").withColumn("_h", F.expr(h)).orderBy("_h").limit(n).drop("_seg", "_h", "n_strata")


def interleave(a: DataFrame, b: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Both corpora in one reproducible shuffled order (a range-partitioned sort)."""
    both = a.withColumn("corpus", F.lit("a")).unionByName(b.withColumn("corpus", F.lit("b")), allowMissingColumns=True)
    return both.withColumn("order_hash", F.expr(order_hash(seed, "corpus", key))).orderBy("order_hash")
