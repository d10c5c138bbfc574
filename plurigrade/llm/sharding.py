"""Sharding by fixed virtual slots, with DataFrame functions only.

Records are hashed by their text into ``SLOTS`` virtual slots for good, so copies of a text meet in one slot and shard.
Bytes and rows are added up per slot, and a versioned map says which shard holds each slot: version 0 deals the slots in
stripes, and every later version is an edit of the one before that moves slots only where bytes are uneven or shards were
added.  The map has one row per slot, so it is small whatever the table's size; it is written with its version into the
shared folder, and records find their shard through it.

The law is ``bytes``: an edit visits the slots from the largest down, leaves a slot where it is while its shard stays
within the even share, and gives any other to the shard with the least bytes so far.  Copies of one text that make up
more than one part in ``HOT`` of a shard's even share are a hot group: no map could hold the law with them in one slot,
so they are salted over as many slots as they need, by id and, where rows repeat, by the number of the copy.

Rows that repeat id and text are one row with a count until the very end.  Each row of the documents is read once: ids,
sizes and digests are stored, and all that follows reads those.

A null text is the empty text.  Rows without id come last in their slot.  An empty table has an empty result.  Texts of any
length are hashed whole.  Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurigrade.llm.common import shared_dir, stored

SLOTS = 4096
#: Parts of a shard's even share above which copies of a text are split, and parts of that into which repeated rows are.
HOT, FINE = 4, 16
#: Groups of a slot's rows that are numbered apart.
LANES = 16


def hashed(name: Column, buckets: int | Column) -> Column:
    """A bucket from the first 32 bits of a hexadecimal digest."""
    return F.pmod(F.conv(F.substring(name, 1, 8), 16, 10).cast("long"), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("long")


def units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, digest, copies``: each id and text once."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.md5(whole.cast("binary")).alias("digest"))
    return rows.groupBy("key", "size", "text_crc32", "digest").agg(F.count("*").alias("copies"))


def pieces(rows: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """``rows`` (of :func:`units`) with ``virtual_slot`` and ``piece``; repeated rows of hot groups are cut to pieces of some copies.

    The hot groups number at most ``HOT * shards``, since each holds more than that part of all bytes; so they are broadcast.
    """
    weight = F.col("size") * F.col("copies")
    total = rows.agg(F.sum(weight).alias("all_bytes"))
    limit = F.ceil(F.col("all_bytes") / (HOT * shards)).cast("long")
    groups = rows.groupBy("digest").agg(F.sum(weight).alias("bytes"), F.first("size").alias("size"))
    hot = groups.crossJoin(F.broadcast(total.select(limit.alias("limit")))).where("bytes > limit")
    named = hot.select("digest", F.ceil(F.col("bytes") * HOT / F.col("limit")).cast("long").alias("parts"), F.greatest(F.floor(F.col("limit") / FINE / F.col("size")), F.lit(1)).cast("long").alias("each"))
    met = rows.join(F.broadcast(named), "digest", "left")
    cut = met.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.floor((F.col("copies") - 1) / F.col("each")), F.lit(0)).cast("long"))))
    salt = hashed(F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("piece").cast("string")).cast("binary")), F.col("parts"))
    name = F.when(F.col("parts").isNull(), F.col("digest")).otherwise(F.md5(F.concat_ws(":", "digest", salt.cast("string")).cast("binary")))
    held = F.coalesce(F.least(F.col("each"), F.col("copies") - F.col("piece") * F.col("each")), F.col("copies"))
    return cut.select("key", "size", "text_crc32", "digest", "piece", held.cast("long").alias("copies"), hashed(name, slots).alias("virtual_slot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """``virtual_slot, bytes, rows``: at most one row per slot."""
    return rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt to the shards in stripes."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map (one version's rows), for ``shards`` shards and the present sizes of the slots.

    One fold over the slots, largest first; ties by slot number.  Empty slots come last and stay, unless their shard is no more.
    """
    held = slot_map.join(sizes, "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    line = held.agg(
        (F.max("version") + 1).alias("version"),
        F.ceil(F.sum("bytes") / shards).cast("long").alias("share"),
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard"))).alias("slots"),
    )

    def step(state: Column, x: Column) -> Column:
        loads, share = state["loads"], F.col("share")
        size = -x["less"]
        stays = (x["shard"] < shards) & ((size == 0) | (F.get(loads, x["shard"]) + size <= share))
        least = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        to = F.when(stays, x["shard"]).otherwise(least)
        # The chosen shard is stored first, so that it is worked out once for the loads and the list.
        return F.struct(
            F.transform(F.array(to), lambda t: F.transform(loads, lambda v, i: F.when(i == t, v + size).otherwise(v)))[0].alias("loads"),
            F.concat(state["to"], F.array(to)).alias("to"),
        )

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("to"))
    return (
        line.select("version", "slots", F.aggregate("slots", start, step)["to"].alias("to"))
        .select("version", F.explode(F.arrays_zip("slots", "to")).alias("x"))
        .select("version", F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.to").alias("shard"))
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored maps at ``path``; versions are never overwritten."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot long, shard int, version int").parquet(path).where(F.col("version") == version)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``before``, the places in the shard that come before the row's.

    A slot's rows are numbered in ``LANES`` lanes, dealt by id and piece, and only the lanes' totals meet across them: at
    most ``LANES`` rows per slot, which is why they are broadcast.
    """
    name = F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("piece").cast("string"), "digest")
    laned = rows.withColumn("lane", hashed(F.md5(name.cast("binary")), LANES).cast("int"))
    totals = laned.groupBy("virtual_slot", "lane").agg(F.sum("copies").alias("rows")).join(F.broadcast(slot_map), "virtual_slot")
    order = Window.partitionBy("shard").orderBy("virtual_slot", "lane")
    offsets = totals.select("virtual_slot", "lane", "shard", (F.sum("rows").over(order) - F.col("rows")).alias("offset"))
    own = Window.partitionBy("virtual_slot", "lane").orderBy(F.col("key").asc_nulls_last(), "digest", "piece")
    numbered = laned.withColumn("inside", F.sum("copies").over(own) - F.col("copies"))
    return numbered.join(F.broadcast(offsets), ["virtual_slot", "lane"]).withColumn("before", F.col("offset") + F.col("inside")).drop("offset", "inside", "lane")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version`` of every document.

    Map version 0 and its edit for these sizes are stored at ``path``, by default in the cluster's shared folder.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "slot-map")
    rows = pieces(stored(units(docs, key, text), "units"), shards, slots)
    store_map(first_map(spark, shards, slots), path)
    store_map(rebalanced(load_map(spark, path, 0), slot_sizes(rows), shards), path)
    out = placed(rows, load_map(spark, path, 1))
    return out.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(1).alias("map_version"),
    )
