"""A Bloom filter of keys as a small table, which keeps rows with other keys out of a shuffle.

The keys' hashes are dealt to at most ``BLOCKS`` blocks; a block is one bitmap of 32,768 bits, in which every key sets
``PROBES`` bits. The table is broadcast: it has at most ``BLOCKS`` rows of 4 KiB, 16 MiB in all, however many keys there
are. More than some 13 million keys let more foreign rows pass, so a join on the keys always follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 4096
BLOCK_BITS = 32768
PROBES = 4


def _hashes(keys: Sequence[str]) -> tuple[str, str]:
    by = ", ".join(keys)
    return f"pmod(xxhash64({by}), {BLOCKS})", f"xxhash64({by}, 1)"


def _bit(probe: int) -> str:
    return f"(shiftrightunsigned(_f_hash, {15 * probe}) & {BLOCK_BITS - 1})"


def key_filter(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The filter of all keys in ``rows``; two slim numbers of each row are shuffled. No rows give an empty filter."""
    block, value = _hashes(keys)
    slim = rows.selectExpr(f"{block} AS _f_block", f"{value} AS _f_hash").repartition("_f_block")
    bits = ", ".join(_bit(k) for k in range(PROBES))
    return slim.selectExpr("_f_block", f"explode(array({bits})) AS _f_bit").groupBy("_f_block").agg(
        F.expr("bitmap_construct_agg(_f_bit) AS _f_bits")
    )


def maybe_in(rows: DataFrame, filter_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and few others. Nothing of ``rows`` is shuffled.

    Key columns must have the same types as in the filter, as they are hashed. A NULL in a key is a value like others.
    """
    block, value = _hashes(keys)
    tagged = rows.selectExpr("*", f"{block} AS _f_block", f"{value} AS _f_hash")

    def is_set(bit: str) -> str:
        byte = f"cast(conv(hex(substring(_f_bits, cast({bit} DIV 8 AS int) + 1, 1)), 16, 10) AS int)"
        return f"shiftright({byte}, cast({bit} % 8 AS int)) & 1 = 1"

    found = tagged.join(F.broadcast(filter_), "_f_block").filter(" AND ".join(is_set(_bit(k)) for k in range(PROBES)))
    return found.select(*rows.columns)


def prefilter(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that a join with ``wanted`` on ``keys`` may need. Keys of different types are not filtered."""
    if rows.select(*keys).dtypes != wanted.select(*keys).dtypes:
        return rows
    return maybe_in(rows, key_filter(wanted, keys), keys)
