"""Products of many rows with a table too large for a worker: a stream of table blocks, one held at a time."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A block's size in bytes where a table goes in blocks; what a worker holds besides its batch of rows.
BLOCK_BYTES = 8 * 1024 * 1024


def pack(arrays: Mapping[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


def packed_blocks(table: DataFrame, ids: str, step: int, arrays: Callable[[pa.Table], Mapping[str, np.ndarray]]) -> DataFrame:
    """(block, payload): rows whose ids share a block of ``step`` ids, as one packed set of arrays.

    ``arrays`` gets the block's rows in the order of their ids. Blocks are made where the rows lie; nothing is collected.
    """
    dealt = table.withColumn("block", F.expr(f"CAST(`{ids}` div {step} AS int)"))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(ids, "ascending")])
        return pa.table({"block": pa.array([part.column("block")[0].as_py()], pa.int32()), "payload": pa.array([pack(arrays(part))], pa.binary())})

    return dealt.groupBy("block").applyInArrow(run, "block int, payload binary")


def map_blocks(rows: DataFrame, blocks: DataFrame, n_blocks: int, work: Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]],
               schema: T.StructType | str, prepare: Callable[[int, dict[str, np.ndarray]], Any], parts: int | None = None) -> DataFrame:
    """``work`` over every pair of a block of a table and a slice of the rows.

    Rows are dealt by a hash of their content into ``parts`` slices, and each slice meets each block: a row is sent once for each block, a
    block once for each slice. Both arrive sorted by block and slice, the block first, so a worker keeps the one block at hand and
    streams rows past it, however many blocks there are. ``prepare`` turns a block's number and arrays into what ``work`` needs.
    """
    hashable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    if parts is None:
        parts = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(n_blocks, 1)))
    names = rows.columns
    dealt = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"), F.pmod(F.xxhash64(*hashable), F.lit(parts)).cast("int").alias("_part"),
        F.lit(None).cast("binary").alias("_payload"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    copies = blocks.select(
        F.col("block").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.col("payload").alias("_payload"),
        F.lit(None).cast(dealt.schema["_row"].dataType).alias("_row"))

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for record in records:
            payloads, block = record.column(2), record.column(0).to_pylist()
            starts = [i for i in range(record.num_rows) if payloads[i].is_valid]
            for low, high in zip([0, *starts], [*starts, record.num_rows]):
                if low < record.num_rows and payloads[low].is_valid:
                    held, at = None, block[low]
                    held = prepare(at, unpack(payloads[low].as_py()))
                    low += 1
                if low >= high:
                    continue
                if held is None or at != block[low]:
                    raise ValueError(f"block {block[low]} of the table is missing")
                yield from work(held, pa.RecordBatch.from_struct_array(record.column(3).slice(low, high - low)))

    both = dealt.unionByName(copies)
    return both.repartition("_block", "_part").sortWithinPartitions("_block", "_part", F.col("_payload").isNull()).mapInArrow(run, schema)
