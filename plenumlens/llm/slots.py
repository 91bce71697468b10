"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Every record is hashed into one of a few thousand slots, for good. Bytes are added up per
slot, and a map says which shard owns which slot. Moving data later means editing a few rows
of the map (a new version of it), never hashing anything anew.

Only DataFrame functions are used. What is gathered in one row is the list of slots, whose
length is the fixed number of slots, never the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenumlens.session import materialize

SLOTS = 4096
#: Records of a slot are numbered in this many parts, so that no sort holds a whole slot.
PARTS = 16
#: Bytes a record costs besides its text.
OVERHEAD = 8


def _unsigned(key: Column, digits: int, start: int = 1) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), start, digits), 16, 10).cast("long")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: the first 48 bits of its MD5, modulo the number of slots. Null hashes as ''."""
    return F.pmod(_unsigned(key, 12), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the overhead."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def slot_bytes(records: DataFrame) -> DataFrame:
    """Rows (vslot, bytes, rows) of records (vslot, size); one partial aggregate, at most one row per slot."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _fold(ordered: Column, loads: Column, shards: int) -> Column:
    """Give each slot, in order, to the shard with the least bytes so far (the lowest of equals)."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("owners"))

    def step(state: Column, slot: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        grown = F.transform(state["loads"], lambda v, i: F.when(i + 1 == at, v + slot["bytes"]).otherwise(v))
        return F.struct(grown.alias("loads"), F.concat(state["owners"], F.array(at - 1)).alias("owners"))

    return F.aggregate(ordered, start, step, lambda state: state["owners"])


def first_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Version 1 of the map, rows (version, vslot, shard): largest slots first, each to the lightest shard.

    ``sizes`` has one row per slot that holds data; slots without data get no row (see
    :func:`shard_of_empty`).
    """
    slots = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes"))).alias("slots"))
    owners = _fold(F.col("slots"), F.array(*[F.lit(0).cast("long")] * shards), shards)
    return (slots.select(F.explode(F.arrays_zip(F.col("slots.vslot").alias("vslot"), owners.alias("shard"))).alias("m"))
            .select(F.lit(version).alias("version"), F.col("m.vslot").alias("vslot"), F.col("m.shard").alias("shard")))


def shard_of_empty(vslot: Column, shards: int) -> Column:
    """The shard of a slot that the map has no row for."""
    return F.pmod(vslot, F.lit(shards)).cast("int")


def edit_map(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards and the sizes of today, moving few slots.

    Slots are seen largest first. A slot stays with its shard as long as that shard holds no
    more than the mean of all shards; what doesn't fit, slots of shards that are gone and new
    slots go, largest first, to the lightest shards. ``slot_map`` has one version. Slots without
    data leave the map.
    """
    held = sizes.join(slot_map.select("vslot", "version", "shard"), "vslot", "left")
    size, slot, shard = F.col("bytes").cast("long"), F.col("vslot").cast("int"), F.col("shard").cast("int")
    rows = F.sort_array(F.collect_list(F.struct((-size).alias("less"), slot.alias("vslot"), size.alias("bytes"), shard.alias("shard"))))
    all_slots = held.agg(F.coalesce(F.max("version"), F.lit(0)).alias("was"), F.sum("bytes").alias("total"), rows.alias("slots"))
    kind = "array<struct<less:bigint,vslot:int,bytes:bigint,shard:int>>"
    start = F.struct(F.array(*[F.lit(0).cast("long")] * shards).alias("loads"),
                     F.array().cast(kind).alias("stay"), F.array().cast(kind).alias("move"))

    def step(state: Column, slot: Column) -> Column:
        at = slot["shard"]
        fits = at.isNotNull() & (at >= 0) & (at < shards) & (
            (F.coalesce(F.get(state["loads"], at), F.lit(0)) + slot["bytes"]) * shards <= F.col("total"))
        none = F.array().cast(kind)
        return F.struct(
            F.transform(state["loads"], lambda v, i: F.when(fits & (i == at), v + slot["bytes"]).otherwise(v)).alias("loads"),
            F.concat(state["stay"], F.when(fits, F.array(slot)).otherwise(none)).alias("stay"),
            F.concat(state["move"], F.when(fits, none).otherwise(F.array(slot))).alias("move"))

    split = all_slots.withColumn("split", F.aggregate("slots", start, step)).select("was", "split.*")
    owned = split.withColumn("owners", _fold(F.col("move"), F.col("loads"), shards))
    kept = F.transform("stay", lambda s: F.struct(s["vslot"].alias("vslot"), s["shard"].alias("shard")))
    moved = F.zip_with("move", "owners", lambda s, o: F.struct(s["vslot"].alias("vslot"), o.alias("shard")))
    return (owned.select((F.col("was") + 1).cast("int").alias("version"), F.explode(F.concat(kept, moved)).alias("m"))
            .select("version", "m.vslot", "m.shard"))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS,
                  keep: list[str] | None = None) -> DataFrame:
    """Every document's shard, and its place among the shard's documents.

    Returns the columns ``keep`` (default: only the key) with size, law ('bytes'), shard, slot
    (0, 1, 2... without gaps in each shard), vslot and version; other columns of the input and
    clashing names are left out. Null keys hash as an empty string, repeated rows are all
    placed, and rows with equal keys are numbered in the order of their size and text hash (ties
    are equal rows). An empty table gives an empty result.
    """
    keep = [key] if keep is None else keep
    own = ["size", "vslot", "shard", "slot", "law", "version"]
    value = F.col(key)
    records = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("__row"), value.cast("string").alias("__key"),
        F.xxhash64(docs[text].cast("string")).alias("__tie"), record_size(docs[text]).alias("size"),
        slot_of(value, slots).alias("vslot"), F.pmod(_unsigned(value, 6, 13), F.lit(PARTS)).cast("int").alias("__part"))
    sizes = records.groupBy("vslot", "__part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    totals = sizes.groupBy("vslot").agg(F.sum("bytes").alias("bytes"))
    owners = first_map(totals, shards)
    # one row per slot and part, slots * PARTS at most
    starts = sizes.join(F.broadcast(owners), "vslot").select(
        "vslot", "__part", "shard", "version", (F.coalesce(F.sum("rows").over(
            Window.partitionBy("shard").orderBy("vslot", "__part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0))).alias("__start"))
    place = F.row_number().over(Window.partitionBy("vslot", "__part").orderBy("__key", "size", "__tie"))
    placed = records.withColumn("__place", place).join(F.broadcast(starts), ["vslot", "__part"])
    named = [c for c in keep if c not in own]
    return placed.select(*[F.col("__row")[c].alias(c) for c in named], "size", F.lit("bytes").alias("law"),
                         F.col("shard").cast("int").alias("shard"),
                         (F.col("__start") + F.col("__place") - 1).cast("long").alias("slot"), "vslot", "version")


# --- stored maps, and records that spread whatever their keys ---

MAP = "version int, vslot int, shard int"


def stored_map(spark: SparkSession, maps: str, version: int | None = None) -> DataFrame:
    """One version of the map below ``maps`` (default: the newest), rows (version, vslot, shard); no rows if there is none."""
    known = spark.read.schema(MAP).parquet(maps)
    if version is not None:
        return known.where(F.col("version") == version)
    newest = known.agg(F.max("version")).first()[0]
    return known.where(F.col("version") == F.lit(newest))


def update_map(sizes: DataFrame, shards: int, maps: str) -> DataFrame:
    """Store the next version of the map below ``maps`` and read it back.

    The first version is made for the sizes (vslot, bytes) as they are; each later one edits the
    newest, so that few slots move. A version is a folder of its own, written as a whole; earlier
    ones stay, and tell where a record was.
    """
    spark = sizes.sparkSession
    spark.createDataFrame([], MAP).write.mode("append").partitionBy("version").parquet(maps)
    now = stored_map(spark, maps)
    was = now.agg(F.max("version")).first()[0]
    slots = materialize(sizes.select("vslot", "bytes"), "slot-sizes")  # at most one row per slot, read by several aggregates
    found = first_map(slots, shards) if was is None else edit_map(now, slots, shards)
    made = materialize(found, "slot-map")
    made.coalesce(1).write.mode("append").partitionBy("version").parquet(maps)
    return stored_map(spark, maps, (was or 0) + 1)


def spread_records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS, keep: list[str] | None = None) -> DataFrame:
    """Written rows (__row, __key, __tie, size, vslot, __part), one per document.

    The slot is the hash of key and text, the same in every run; only rows that repeat, key and
    text, are spread at random, so that no key, null or not, fills a slot. ``keep`` are the columns in ``__row``.
    """
    keep = [key] if keep is None else keep
    rows = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("__row"), docs[key].cast("string").alias("__key"),
        F.xxhash64(docs[text].cast("string")).alias("__tie"), record_size(docs[text]).alias("size"))
    again = rows.groupBy("__key", "__tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("__key").alias("k"), F.col("__tie").alias("t"))
    marked = rows.join(again, F.col("__key").eqNullSafe(F.col("k")) & (F.col("__tie") == F.col("t")), "left")
    salt = F.when(F.col("t").isNotNull(), F.floor(F.rand(9) * (1 << 30)))
    # concat_ws leaves out nulls: a null key differs from an empty one by the text before it
    name = F.concat_ws(":", F.when(F.col("__key").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "__key")), F.col("__tie"), salt)
    named = marked.select("__row", "__key", "__tie", "size", name.alias("name"))
    return materialize(named.select("__row", "__key", "__tie", "size", slot_of(F.col("name"), slots).alias("vslot"),
                                    F.pmod(_unsigned(F.col("name"), 6, 13), F.lit(PARTS)).cast("int").alias("__part")), "slot-records")


def place_records(records: DataFrame, owners: DataFrame) -> DataFrame:
    """The columns of ``__row`` of :func:`spread_records` with size, law ('bytes'), shard, slot, vslot and version.

    ``slot`` counts 0, 1, 2... without gaps within a shard. ``owners`` is one version of the map with
    a row for every slot that holds data.
    """
    sizes = records.groupBy("vslot", "__part").agg(F.count(F.lit(1)).alias("rows"))
    # one row per slot and part, slots * PARTS at most
    starts = sizes.join(F.broadcast(owners), "vslot").select(
        "vslot", "__part", "shard", "version", (F.coalesce(F.sum("rows").over(
            Window.partitionBy("shard").orderBy("vslot", "__part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0))).alias("__start"))
    place = F.row_number().over(Window.partitionBy("vslot", "__part").orderBy("__key", "size", "__tie"))
    placed = records.withColumn("__place", place).join(F.broadcast(starts), ["vslot", "__part"])
    own = ["size", "vslot", "shard", "slot", "law", "version"]
    named = [c for c in records.schema["__row"].dataType.names if c not in own]
    return placed.select(*[F.col("__row")[c].alias(c) for c in named], "size", F.lit("bytes").alias("law"), "shard",
                         (F.col("__start") + F.col("__place") - 1).cast("long").alias("slot"), "vslot", "version")
