"""Sharding over fixed virtual slots (DataFrame functions only).

Records are hashed into SLOTS virtual slots, sizes are summed for each slot (partial aggregation; SLOTS
rows at most), and a stored, versioned table maps slots to shards. The first version deals the slots, largest
first, each to the lightest shard, so shards hold nearly equal bytes. Rebalancing loads a version, edits it and
stores the next one: ``grown`` gives a new shard just enough slots of the others, ``levelled`` moves slots from the
fullest to the emptiest shard. Records whose slot did not move stay where they are.

The slot comes from doc_id, text and, for rows repeated whole, from the number of the hundred they are in: such
rows are counted, not gathered, and made anew from their number, so no slot holds more than chance gives it,
whatever doc_id or text a third of the rows may share. A record's place in its shard is its slot's offset there plus its
place in the slot; the only window is over a slot's rows, never over a shard's.

Law: ``bytes``. Edge cases: a null text has 0 bytes and the CRC of the empty text; a null doc_id is a value like any other; rows repeated whole are placed one by one (which has which
place is immaterial); very long texts are read once and never moved; input columns other than doc_id and text are
ignored, whatever their names; an empty table gives an empty result and a map whose slots are all empty.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import copies, kept

SLOTS, TOGETHER = 8192, 100
Totals = Iterable[tuple[int, int, int]]


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS, together: int = TOGETHER) -> DataFrame:
    """(doc_id, size, text_crc32, h, part, n, virtual_slot): n rows, ``together`` at most, that are alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("h")
    )
    alike = each.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("rows"))
    many = F.floor((F.col("rows") - 1) / together)
    part = copies(alike.withColumn("parts", many + 1), "parts").withColumnRenamed("_copy", "part")
    n = F.least(F.col("rows") - F.col("part") * together, F.lit(together)).cast("long")
    return part.select("doc_id", "size", "text_crc32", "h", "part", n.alias("n"), slot_of(F.col("h"), F.col("part"), slots=slots).alias("virtual_slot"))


def slot_totals(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots that hold anything: SLOTS entries at most, whatever the input."""
    got = rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("n")).collect()
    return sorted((r["virtual_slot"], r["b"], r["n"]) for r in got)


def dealt(totals: Totals, shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0 of the map: largest slot first, each to the shard with the fewest bytes."""
    size = dict.fromkeys(range(slots), 0) | {s: b for s, b, _ in totals}
    heap = [(0, k) for k in range(shards)]
    out = [0] * slots
    for slot in sorted(size, key=lambda s: (-size[s], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size[slot], shard))
    return out


def grown(mapping: list[int], totals: Totals, shards: int) -> list[int]:
    """An edited map with one more shard: it takes slots from the fullest shard until it holds its share."""
    size = dict.fromkeys(range(len(mapping)), 0) | {s: b for s, b, _ in totals}
    load, own, out = [0] * shards, [[] for _ in range(shards)], list(mapping)
    for slot, shard in enumerate(mapping):
        load[shard] += size[slot]
        own[shard].append(slot)
    for slots_ in own:
        slots_.sort(key=lambda s: (size[s], -s))
    share, took = sum(load) / (shards + 1), 0
    while any(own):
        shard = max((k for k in range(shards) if own[k]), key=lambda k: (load[k], -k))
        slot = next((s for s in reversed(own[shard]) if took + size[s] <= share), None)
        if slot is None or not size[slot]:
            break
        own[shard].remove(slot)
        out[slot], took, load[shard] = shards, took + size[slot], load[shard] - size[slot]
    return out


def levelled(mapping: list[int], totals: Totals, shards: int) -> list[int]:
    """An edited map whose shards are level again after the slots' sizes changed, by few moves: each takes from the
    fullest shard the slot that brings it and the emptiest one nearest to each other."""
    size = dict.fromkeys(range(len(mapping)), 0) | {s: b for s, b, _ in totals}
    load, own, out = [0] * shards, [set() for _ in range(shards)], list(mapping)
    for slot, shard in enumerate(mapping):
        load[shard] += size[slot]
        own[shard].add(slot)
    while True:
        most, least = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[most] - load[least]
        slot = min((s for s in own[most] if 0 < size[s] < gap), key=lambda s: (abs(gap - 2 * size[s]), s), default=None)
        if slot is None:
            return out
        own[most].remove(slot)
        own[least].add(slot)
        out[slot], load[most], load[least] = least, load[most] - size[slot], load[least] + size[slot]


def map_table(spark: SparkSession, mapping: list[int], version: int) -> DataFrame:
    """A version of the slot-to-shard map as rows (version, slot, shard)."""
    made = F.from_json(F.lit(json.dumps(mapping)), "array<int>")
    return spark.range(1).select(F.lit(version).alias("version"), F.posexplode(made).alias("slot", "shard"))


def stored(mapping: list[int], spark: SparkSession, path: str, version: int) -> None:
    """Appends a version to the map at ``path``; earlier versions stay."""
    map_table(spark, mapping, version).coalesce(1).write.mode("append").parquet(path)


def loaded(spark: SparkSession, path: str, version: int | None = None) -> tuple[list[int], int]:
    """(the map at ``path``, its version): the latest, or the one asked for. SLOTS rows."""
    table = spark.read.schema("version int, slot int, shard int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == F.lit(version)).select("slot", "shard").distinct().collect()
    out = [0] * len(rows)
    for r in rows:
        out[r["slot"]] = r["shard"]
    return out, version


def rebalanced(spark: SparkSession, path: str, docs: DataFrame, edit=grown) -> list[int]:
    """Loads the latest map, edits it for the documents as they are now, and stores it as the next version."""
    mapping, version = loaded(spark, path)
    after = edit(mapping, slot_totals(records(docs, len(mapping))), max(mapping) + 1)
    stored(after, spark, path, version + 1)
    return after


def placed(rows: DataFrame, mapping: list[int], totals: Totals) -> DataFrame:
    """Each row with its shard and its place there, by the map."""
    spark, count = rows.sparkSession, {s: n for s, _, n in totals}
    before, seen = [0] * len(mapping), [0] * (max(mapping, default=0) + 1)  # rows of the same shard in smaller slots
    for slot, shard in enumerate(mapping):
        before[slot] = seen[shard]
        seen[shard] += count.get(slot, 0)
    pairs = F.from_json(F.lit(json.dumps([list(x) for x in zip(mapping, before, strict=True)])), "array<array<bigint>>")
    current = spark.range(1).select(F.posexplode(pairs).alias("virtual_slot", "m")).select("virtual_slot", F.col("m")[0].cast("int").alias("shard"), F.col("m")[1].alias("before"))
    sofar = Window.partitionBy("virtual_slot").orderBy("h", "part", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.withColumn("_sofar", F.coalesce(F.sum("n").over(sofar), F.lit(0))).join(F.broadcast(current), "virtual_slot")  # SLOTS rows, by construction
    return copies(each, "n").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("_sofar") + F.col("_copy")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, str]:
    """(placed rows, where the map is stored). With a ``path`` that holds a map, its latest version is applied as it
    is; without one, version 0 is made of these documents, stored and read back."""
    spark = docs.sparkSession
    rows = kept(records(docs, slots), "slot-records")
    totals = slot_totals(rows)
    if path is None:
        path = kept(map_table(spark, dealt(totals, shards, slots), 0), "slot-map").inputFiles()[0].rpartition("/")[0]
    mapping, _ = loaded(spark, path)
    return placed(rows, mapping, totals), path
