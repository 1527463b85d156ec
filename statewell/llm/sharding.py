"""Shards by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of slots; the bytes of each slot are summed on
the way; the map gives each slot a shard so that shards are near equal in bytes.
Rebalancing edits the map: slots leave only shards above the new mean.

Definitions:
* the size of a record is the UTF-8 bytes of its text (null: none) plus ``overhead``;
* null ids hash like a value of their own, together with the text's checksum, so a common id still spreads;
* equal rows share a slot; their positions in it are interchangeable; every row keeps a position of its own;
* an empty table gives an empty result and a map in which every slot has no bytes;
* other columns, whatever their names, are carried in a struct and cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statewell.common import ensure_checkpoint_dir
from statewell.llm.base import stored

SLOTS = 4096


def records(
    docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS, overhead: int = 8, carry: list[str] | None = None
) -> DataFrame:
    """``(row, key, size, crc, vslot)``: each row (or the columns ``carry`` of it) with its size, checksum and virtual slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.struct(*(docs.columns if carry is None else carry)).alias("row"),
        F.col(key).alias("key"),
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    ).withColumn("vslot", F.pmod(F.xxhash64("key", "crc"), F.lit(slots)).cast("int"))


def slot_bytes(spark: SparkSession, sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(vslot, bytes, n)`` for every slot, empty ones included; partial sums before the shuffle."""
    found = sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n")
    )


def _dealt(slots: Column, loads: Column) -> Column:
    """Give slots, largest first, each to the shard with the least bytes; returns the shard of each in order."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("owner"))

    def give(state: Column, slot: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, j: F.when(j == at, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["owner"], F.array(at)).alias("owner"),
        )

    return F.aggregate(slots, start, give)["owner"]


def _deal(slots: DataFrame, loads: Column) -> DataFrame:
    """One row holds the fixed number of slots; ties go by slot number."""
    order = F.struct((-F.col("bytes")).alias("less"), F.col("vslot"), F.col("bytes"))
    one = slots.agg(F.sort_array(F.collect_list(order)).alias("slots")).withColumn("owner", _dealt(F.col("slots"), loads))
    return one.select(F.inline(F.arrays_zip(F.col("slots.vslot").alias("vslot"), F.col("owner").alias("shard"))))


def build_map(by_slot: DataFrame, shards: int) -> DataFrame:
    """``(version, vslot, shard)``, version 1."""
    dealt = _deal(by_slot, F.array_repeat(F.lit(0).cast("long"), shards))
    return dealt.select(F.lit(1).alias("version"), "vslot", "shard")


def rebalance(current: DataFrame, by_slot: DataFrame, shards: int) -> DataFrame:
    """The next version for new sizes or another number of shards.

    A shard keeps its slots, largest first, up to the new mean; the rest and the
    slots of shards that are gone are dealt to the shards with the least bytes.
    """
    held = current.join(by_slot, "vslot")
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    mean = by_slot.agg(F.ceil(F.sum("bytes") / shards).cast("long").alias("mean")).scalar()
    placed = held.withColumn("stays", (F.sum("bytes").over(order) <= mean) & (F.col("shard") < shards))
    kept = {r["shard"]: r["bytes"] for r in placed.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    start = F.array(*[F.lit(kept.get(s, 0)).cast("long") for s in range(shards)])  # one number a shard
    moved = _deal(placed.filter("not stays").select("vslot", "bytes"), start)
    version = current.agg((F.max("version") + 1).alias("v")).scalar()
    return placed.filter("stays").select("vslot", "shard").unionByName(moved).select(version.alias("version"), "vslot", "shard")


def _files(spark: SparkSession, path: str, pattern: str = "") -> tuple:
    """The file system of a path and what lies there by a pattern."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path + pattern)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [f.getPath() for f in fs.globStatus(place) or []]


def save_map(slot_map: DataFrame, path: str) -> bool:
    """Add a version to the stored map; earlier versions stay readable. False if that version is there already.

    The version is written to a hidden folder as one file and then renamed into its place, so a crash leaves nothing that
    a reader sees, and of two sessions that write the same version one stays. Rename must be atomic, as it is on HDFS.
    """
    spark = slot_map.sparkSession
    version = slot_map.agg(F.max("version")).first()[0]
    staging = f"{path.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    slot_map.drop("version").coalesce(1).write.parquet(staging)
    fs, parts = _files(spark, staging, "/*.parquet")
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={version}")
    fs.mkdirs(home)
    target = spark._jvm.org.apache.hadoop.fs.Path(home, "map.parquet")
    done = len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(home, "*.parquet")) or []) == 0 and fs.rename(parts[0], target)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)
    return done


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest unless one is named."""
    whole = spark.read.parquet(path).select("version", "vslot", "shard")
    wanted = whole.agg(F.max("version").alias("v")).scalar() if version is None else F.lit(version)
    return whole.filter(F.col("version") == wanted)


def assign(sized: DataFrame, slot_map: DataFrame, by_slot: DataFrame) -> DataFrame:
    """Add ``shard`` and ``slot``, the row's position in its shard, gapless from 0.

    Positions are those of the slot, known from the counts, plus the rank of the
    row inside its slot, so no task ever holds a shard. The map has a fixed
    number of rows and is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.join(by_slot, "vslot").select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("vslot").orderBy("key", "crc", "size")
    ranked = sized.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(offsets), "vslot").withColumn("slot", (F.col("first") + F.col("rank")).cast("long")).drop("first", "rank")


def shard_documents(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """All rows with size, checksum, virtual slot, shard and position; the map is stored and, with a path, taken from there and edited."""
    spark = docs.sparkSession
    sized = records(docs, key, text, slots, carry=carry)
    by_slot = stored(slot_bytes(spark, sized.drop("row"), slots).coalesce(1), "slot-bytes")
    if map_path is None:
        slot_map = stored(build_map(by_slot, shards), "slot-map")
    else:
        slot_map = kept_map(by_slot, shards, map_path)
    return assign(sized, slot_map, by_slot)


def kept_map(by_slot: DataFrame, shards: int, path: str) -> DataFrame:
    """The map for these sizes: the stored one if sizes and shards are those it was made for, else a new version, which is appended."""
    spark = by_slot.sparkSession
    if not _files(spark, path.rstrip("/"), "/version=*/*.parquet")[1]:
        made = build_map(by_slot, shards)
    else:
        current = stored(load_map(spark, path), "slot-map")
        rows, kinds, least, most = current.agg(F.count("*"), F.countDistinct("vslot"), F.min("vslot"), F.max("vslot")).first()
        if rows != kinds or rows != by_slot.count() or least != 0 or most != rows - 1:
            raise ValueError(f"the latest version of {path} does not give each of the virtual slots one shard")
        if not made_for(by_slot, shards, path).isEmpty():
            made = rebalance(current, by_slot, shards)
        else:
            return current
    made = stored(made.join(by_slot.select("vslot", "bytes"), "vslot").withColumn("shards", F.lit(shards)), "slot-map")
    if not save_map(made, path):
        return kept_map(by_slot, shards, path)
    return made.select("version", "vslot", "shard")


def made_for(by_slot: DataFrame, shards: int, path: str) -> DataFrame:
    """Slots whose bytes, or whose number of shards, differ from what the latest version was made for; all, if that is not stored."""
    whole = by_slot.sparkSession.read.option("mergeSchema", "true").parquet(path)
    if not {"bytes", "shards"} <= set(whole.columns):
        return by_slot.select("vslot")
    latest = whole.join(whole.agg(F.max("version").alias("version")), "version").select("vslot", F.col("bytes").alias("was"), "shards")
    same = F.col("bytes").eqNullSafe(F.col("was")) & F.col("shards").eqNullSafe(F.lit(shards))
    return by_slot.join(latest, "vslot").filter(~same).select("vslot")


def map_folder(spark: SparkSession, name: str, sf_dir: str) -> str:
    """Where the map of a query over one input is kept: below the setting ``statewell.map.folder``, else in the checkpoint folder."""
    digest = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    root = spark.conf.get("statewell.map.folder", None)
    if root is None:
        ensure_checkpoint_dir(spark)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/map-{name}-{digest}"
