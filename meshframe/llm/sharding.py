"""Shards of near equal bytes through fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import pin, table
from meshframe.session import ensure_checkpoint_dir

# Virtual slots that records are hashed into, whatever the number of shards.
SLOTS = 4096
# A slot above 1 / (shards * HOT_SHARE) of all bytes is cut into PIECES further slots.
HOT_SHARE = 32
PIECES = 64
MAP = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("shard", T.IntegerType()),
    T.StructField("bytes", T.LongType()), T.StructField("n_rows", T.LongType())])


def _assign(slots: Column, loads: Column) -> Column:
    """Shard of each slot: in the given order, each goes to the shard with the least bytes so far."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def step(state, slot):
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == least, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["shards"], F.array(least)).alias("shards"),
        )

    return F.aggregate(slots, start, step, lambda state: state["shards"])


def _digest(text: Column, modulus: int) -> Column:
    """A number below ``modulus`` from a text, the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint") % modulus).cast("int")


def slot_records(records: DataFrame, key: Column, size: Column, content: Column, shards: int) -> DataFrame:
    """The records with ``_bytes`` and their virtual slot ``_slot``.

    The slot follows from the key alone (a string; null as the empty one). A slot that holds more than its share, as a key that repeats
    in a third of all rows makes it, is cut into pieces by ``content``, a string that tells rows apart; so where a record goes
    does not depend on how the input is split. Only records whose content itself holds more than a share are dealt by their place in the
    input, among slots of their own; they are equal, so any of them may go anywhere. At most shards * HOT_SHARE slots, and
    as many contents, are that large, so their lists may be broadcast.
    """
    sized = pin(records.withColumns({
        "_bytes": size.cast("bigint"), "_slot": _digest(key, SLOTS), "_mark": F.md5(F.coalesce(content, F.lit("")).cast("binary")),
        "_piece": _digest(content, PIECES), "_nth": F.pmod(F.monotonically_increasing_id(), F.lit(PIECES)).cast("int"),
    }))
    total = sized.agg(F.sum("_bytes")).scalar()

    def large(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("_sum") * shards * HOT_SHARE > total).drop("_sum")

    slots = large(sized.groupBy("_slot").agg(F.sum("_bytes").alias("_sum"))).withColumn("_hot", F.lit(True))
    cut = sized.join(F.broadcast(slots), "_slot", "left")
    contents = large(cut.where("_hot").groupBy("_mark").agg(F.sum("_bytes").alias("_sum"))).withColumn("_same", F.lit(True))
    piece = F.col("_slot") * PIECES + F.col("_piece")
    return cut.join(F.broadcast(contents), "_mark", "left").withColumn(
        "_slot", F.when(F.col("_hot").isNull(), F.col("_slot")).when(F.col("_same").isNull(), SLOTS + piece)
        .otherwise(SLOTS * (1 + PIECES) + piece * PIECES + F.col("_nth"))).drop("_mark", "_piece", "_nth", "_hot", "_same")


def slot_map(slotted: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """First map: rows (version, slot, shard, bytes, n_rows), one per slot that holds records.

    At most SLOTS + 2 * shards * HOT_SHARE * PIECES rows, so the one row that gathers them has a fixed bound.
    """
    slots = slotted.groupBy("_slot").agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("n_rows"))
    gathered = slots.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("bytes")).alias("neg"), F.col("_slot").alias("slot"), "bytes", "n_rows"
    ))).alias("slots"))
    empty = F.array_repeat(F.lit(0).cast("bigint"), shards)
    return gathered.select(F.inline(F.zip_with(
        "slots", _assign(F.col("slots"), empty),
        lambda s, shard: F.struct(F.lit(version).alias("version"), s["slot"].alias("slot"), shard.alias("shard"),
                                  s["bytes"].alias("bytes"), s["n_rows"].alias("n_rows")),
    )))


def grow_map(current: DataFrame, shards: int) -> DataFrame:
    """Next version of a map with one more shard: the new shard takes slots, all others stay.

    ``shards`` counts those before. Slots move in a fixed hashed order while the new shard stays within
    an equal share of all bytes, so no slot moves between old shards.
    """
    gathered = current.agg(
        F.array_sort(F.collect_list(F.struct(
            F.xxhash64("slot").alias("order"), "version", "slot", "shard", "bytes", "n_rows"))).alias("slots"),
        F.sum("bytes").alias("total"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("got"), F.array().cast("array<boolean>").alias("moves"))

    def step(state, slot):
        fits = (state["got"] + slot["bytes"]) * (shards + 1) <= F.col("total")
        return F.struct(
            (state["got"] + F.when(fits, slot["bytes"]).otherwise(0)).alias("got"),
            F.concat(state["moves"], F.array(fits)).alias("moves"),
        )

    return gathered.withColumn("moves", F.aggregate("slots", start, step, lambda s: s["moves"])).select(
        F.inline(F.zip_with("slots", "moves", lambda s, moves: F.struct(
            (s["version"] + 1).alias("version"), s["slot"].alias("slot"),
            F.when(moves, F.lit(shards)).otherwise(s["shard"]).alias("shard"),
            s["bytes"].alias("bytes"), s["n_rows"].alias("n_rows"),
        )))
    )


def write_map(slots: DataFrame, path: str) -> None:
    """Add a version of the map to the table at ``path``; earlier versions stay readable."""
    slots.select(*[F.col(f.name).cast(f.dataType) for f in MAP.fields]).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest one by default."""
    stored = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0] or 0
    return stored.where(F.col("version") == version)


def place(slotted: DataFrame, slots: DataFrame, order: list[str]) -> DataFrame:
    """The records with ``shard`` and ``slot``, their gapless place in the shard from 0.

    Places follow the virtual slot and, within it, ``order``; rows equal in ``order`` are interchangeable. Columns of the records
    with these names, or named virtual_slot, are replaced.
    The window runs within a virtual slot; offsets come from the map, which has a fixed bound.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select(
        F.col("slot").alias("_slot"), "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_offset")
    )
    nth = F.row_number().over(Window.partitionBy("_slot").orderBy(*order))
    return (
        slotted.drop("shard", "slot", "virtual_slot").withColumn("_nth", nth).join(F.broadcast(offsets), "_slot")
        .withColumn("slot", (F.col("_offset") + F.col("_nth") - 1).cast("bigint"))
        .withColumnRenamed("_slot", "virtual_slot").drop("_offset", "_nth")
    )


def op8_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in shards of near equal size (law ``bytes``), by the stored map's first version; ``next_shard`` is
    where a document goes by the second, which the map is edited to for one more shard.

    Null and empty texts have size 1 and CRC 0; a null doc_id hashes as an empty one; equal rows are
    placed beside each other; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    records = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    content = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size")
    slotted = slot_records(records, F.col("doc_id").cast("string"), F.col("size"), content, shards)
    path = f"{ensure_checkpoint_dir(spark)}/shard-map-{uuid.uuid4().hex}"
    write_map(slot_map(slotted, shards), path)
    first = read_map(spark, path, 1)
    write_map(grow_map(first, shards), path)
    after = read_map(spark, path, 2).select(F.col("slot").alias("_later"), F.col("shard").alias("next_shard"))
    return place(slotted, first, ["doc_id", "text_crc32", "size"]).join(
        F.broadcast(after), F.col("virtual_slot") == F.col("_later")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
    )
