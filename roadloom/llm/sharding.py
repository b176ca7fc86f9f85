"""Sharding over a fixed number of virtual slots, balanced by bytes.

A record's hash (MD5 of id and size) gives one of `slots` virtual slots. Bytes are summed by slot. A slot map
says which shard owns which slot; it is stored, one file set a version, in the shared folder. A new map hands
slots out largest first, each to the shard that holds least so far. Rebalancing edits an older map: a slot stays
with its shard while that shard is below its share, and only the overflow moves to the
lightest shards; more shards than before start empty. The map has `slots` rows at any size of
the corpus, so it is folded in one row and broadcast.

The law is `bytes`: the shards' sizes are near equal. Only DataFrame functions are used.

Defined results: a record's size is the UTF-8 bytes of its text (null: none) plus 1; text_crc32 of a null text is that of
the empty text. Rows without id hash by their text, so they spread too. Equal rows share a virtual slot and
take consecutive positions. `slot` is the record's position within its shard, gapless from 0; `virtual_slot` is the slot of
the map. An empty table gives an empty table. Columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.llm.common import append, shared_dir, stored, text_or_empty

RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot"]
#: Each slot's positions are dealt in 16^d parts, so that no window holds a whole slot: d grows to 2 with the rows, about so many a part, so there are 256 parts at most.
PART_ROWS = 20_000


def record_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long") + 1


def _hashed() -> Column:
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty()))
    return F.md5(F.concat(named, F.lit("|"), record_size(F.col("text")).cast("string")))


def _slot(h: Column, slots: int) -> Column:
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def _part(h: Column, digits: int) -> Column:
    """Leading digits of what orders the records of a slot."""
    return F.substring(h, 9, digits)


def cell_loads(docs: DataFrame, slots: int, digits: int) -> DataFrame:
    """virtual_slot, part, n, bytes: what each part of each slot holds."""
    each = docs.select(_hashed().alias("h"), record_size(F.col("text")).alias("b")).select(_slot(F.col("h"), slots).alias("virtual_slot"), _part(F.col("h"), digits).alias("part"), "b")
    return each.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


def assign(loads: DataFrame, shards: int, slots: int, previous: DataFrame | None = None, version: int = 1) -> DataFrame:
    """The slot map (version, virtual_slot, shard, bytes): a fold over at most `slots` rows, largest slot first."""
    spark = loads.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(loads, "virtual_slot", "left").na.fill(0, ["bytes"])
    if previous is not None:
        every = every.join(previous.select("virtual_slot", F.col("shard").alias("old")), "virtual_slot", "left")
    else:
        every = every.withColumn("old", F.lit(None).cast("int"))
    listed = every.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "old"))).alias("s"), F.sum("bytes").alias("total"))
    share = F.col("total") / F.lit(float(shards))

    def step(acc: Column, s: Column) -> Column:
        load = acc["load"]
        least = F.array_position(load, F.array_min(load)).cast("int") - 1
        stays = s["old"].isNotNull() & (s["old"] < shards) & (F.get(load, F.coalesce(s["old"], F.lit(0))) - s["neg"] <= share)
        to = F.when(stays, s["old"]).otherwise(least)
        return F.struct(
            F.transform(load, lambda v, i: F.when(i == to, v - s["neg"]).otherwise(v)).alias("load"),
            F.concat(acc["out"], F.array(F.struct(s["virtual_slot"].alias("virtual_slot"), to.alias("shard"), (-s["neg"]).alias("bytes")))).alias("out"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint>>)").alias("out"),
    )
    return listed.select(F.explode(F.aggregate("s", start, step)["out"]).alias("m")).select(F.lit(version).alias("version"), "m.virtual_slot", "m.shard", "m.bytes")


def store_map(slot_map: DataFrame, folder: str, version: int) -> DataFrame:
    """Writes one version of the map; earlier versions stay readable beside it."""
    path = f"{folder}/version={version}"
    slot_map.drop("version").coalesce(1).write.parquet(path)
    return load_map(slot_map.sparkSession, folder, version)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, bytes long").parquet(f"{folder}/version={version}").withColumn("version", F.lit(version))


def shard(docs: DataFrame, shards: int = 8, slots: int = 4096, folder: str | None = None, previous: DataFrame | None = None, version: int = 1) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot, grown_shard and virtual_slot."""
    folder = folder or shared_dir(docs.sparkSession, "slot-map")
    # One pass over the texts tells both the slots' bytes and the positions' starts.
    digits = 1 if docs.count() <= slots * 16 * PART_ROWS else 2
    cells = stored(cell_loads(docs, slots, digits), "slot-cells")
    loads = cells.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"))
    slot_map = store_map(assign(loads, shards, slots, previous, version), folder, version)

    in_shard = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    # slots * 256 rows at most, so it is small at any size of the corpus.
    starts = cells.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot").select(F.col("virtual_slot").alias("__vs"), F.col("part").alias("__pt"), F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("__start"))

    rows = docs.withColumn("__h", _hashed())
    rows = rows.withColumns({"__vslot": _slot(F.col("__h"), slots), "__part": _part(F.col("__h"), digits), "__size": record_size(F.col("text")), "__crc": F.crc32(F.encode(text_or_empty(), "utf-8"))})
    rows = rows.join(F.broadcast(starts), (F.col("__vslot") == F.col("__vs")) & (F.col("__part") == F.col("__pt")))
    position = F.col("__start") + F.row_number().over(Window.partitionBy("__vslot", "__part").orderBy(F.substring("__h", 9, 24), "doc_id", "__crc", "__size")) - 1
    held = rows.withColumn("__position", position)
    done = append(held, F.col("__size"), F.col("__crc"), F.lit("bytes"), F.col("__shard"), F.col("__position"), F.lit(None).cast("int"), F.col("__vslot"), names=RESULTS)
    return done.drop("__h", "__vslot", "__part", "__size", "__crc", "__vs", "__pt", "__shard", "__start", "__position")
