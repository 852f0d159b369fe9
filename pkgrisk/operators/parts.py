"""Long texts as numbered parts: the blocks of a group in order, of any number, and no group in one row or task.

Blocks are dealt by ranges of their order and sorted there; a task then joins neighbouring blocks of a group until a part
is full. A part ends where its range ends, so a group's parts come from as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pkgrisk.functions.sql import text as literal
from pkgrisk.operators.treediff import block_text

PART_CHARS = 32 << 20
#: characters of finished parts that are sent on together
SEND_CHARS = 8 << 20


def _join(n_keys: int, part_chars: int, separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # later ranges have larger numbers
        key, held, size = None, [], 0
        done, waiting, schema = [], 0, None

        def finish() -> None:
            nonlocal number, held, size, waiting
            if held:
                done.append((*key, number, len(held), separator.join(held)))
                number, waiting = number + 1, waiting + size
            held, size = [], 0

        def send() -> pa.RecordBatch:
            nonlocal done, waiting
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done), schema)]
            done, waiting = [], 0
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            schema = pa.schema([*list(batch.schema)[:n_keys], ("part", pa.int64()), ("n_blocks", pa.int64()), ("text", pa.string())])
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
            for own, block in zip(keys, batch.column(n_keys)):
                block = block.as_py()
                more = len(block) + (len(separator) if held else 0)
                if own != key or held and size + more > part_chars:
                    finish()
                    key, more = own, len(block)
                    if waiting >= SEND_CHARS:
                        yield send()
                held.append(block)
                size += more
        finish()
        if done:
            yield send()

    return run


def text_parts(
    blocks: DataFrame, group: Sequence[str], order: Sequence[str], block: str, part_chars: int = PART_CHARS, separator: str = "",
) -> DataFrame:
    """``*group, part, n_blocks, text``: the SQL text ``block`` of every row, joined within its group in ``order``.

    A group's texts joined by ``separator`` in the order of ``part`` are its blocks joined by it. Part numbers rise, with
    gaps. A part has at most ``part_chars`` characters unless one block alone has more. NULL blocks are left out, as in
    ``array_join``; rows equal in ``order`` follow by their text; NULL is a group like others. Blocks are shuffled once.
    Numbers and cuts hold within one evaluation: write the parts before they are used twice.
    """
    keys, by = [f"_g{k}" for k in range(len(group))], [f"_o{k}" for k in range(len(order))]
    named = blocks.selectExpr(
        *[f"`{g}` AS {k}" for g, k in zip(group, keys)], *[f"{o} AS {k}" for o, k in zip(order, by)], f"{block} AS _block"
    ).filter("_block IS NOT NULL")
    placed = named.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by, "_block").select(*keys, "_block")
    schema = StructType([
        *[StructField(k, placed.schema[k].dataType) for k in keys], StructField("part", LongType()), StructField("n_blocks", LongType()),
        StructField("text", StringType()),
    ])
    out = placed.mapInArrow(_join(len(keys), part_chars, separator), schema)
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], "part", "n_blocks", "text")


def diff_parts(changes: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``case_id, part, n_blocks, text``: what ``treediff.pack_blocks`` joins without a cap, for cases of any size."""
    return text_parts(changes, ["case_id"], ["path"], block_text(), part_chars)


def record_parts(files: DataFrame, part_chars: int = PART_CHARS, separator: str = "\n\n") -> DataFrame:
    """``package, part, n_blocks, text``: all files of a package under their paths, in path order."""
    headed = f"concat('// === ', path, ' ===', {literal(chr(10))}, content)"
    return text_parts(files, ["package"], ["path"], headed, part_chars, separator)
