"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots; bytes are summed per slot; a versioned
slot-to-shard map says where a slot lives. Rebalancing never rehashes records: it edits the map, so only the
records of moved slots move. Version 0 deals the slots out in turn, the next version is the edit that makes the
shards' bytes near equal.

Cases: a null text has no bytes (size 16, crc 0); a null key is a key; rows that are equal in key and text share a
virtual slot, so a key with many rows is spread; repeated rows tie and get different positions; very long texts count
with all their bytes; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path

N_SLOTS = 8192
#: Rows of one slot are numbered in so many parts, so that a hot key's rows are not sorted in one task.
PARTS = 32


@dataclass
class SlotMap:
    """A slot-to-shard map and its history; each edit appends a version."""

    n_shards: int
    versions: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def dealt(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(n_shards, [np.arange(n_slots, dtype=np.int32) % n_shards])

    @property
    def shards(self) -> np.ndarray:
        return self.versions[-1]

    def rebalance(self, slot_bytes: np.ndarray, max_edits: int = 100_000) -> int:
        """Append the version in which shards' bytes are near equal; returns the number of moved slots.

        The heaviest shard gives a slot to the lightest, or swaps one for a smaller, whichever halves their
        difference best; it ends when no edit of the two lowers the heavier one.
        """
        shards, load = self.shards.copy(), np.bincount(self.shards, slot_bytes, self.n_shards)
        for _ in range(max_edits):
            high, low = int(load.argmax()), int(load.argmin())
            gap = load[high] - load[low]
            give, take = np.flatnonzero(shards == high), np.flatnonzero(shards == low)
            take = take[np.argsort(slot_bytes[take], kind="stable")]
            back = np.concatenate([[0.0], slot_bytes[take]])  # 0: nothing is given back
            want = slot_bytes[give] - gap / 2
            at = np.clip(np.searchsorted(back, want), 1, len(back) - 1) if len(back) > 1 else np.zeros(len(give), int)
            at = np.where(np.abs(back[at - 1] - want) <= np.abs(back[at] - want), at - 1, at) if len(back) > 1 else at
            moved = slot_bytes[give] - back[at]
            ok = (moved > 0) & (moved < gap)
            if not ok.any():
                break
            k = int(np.argmin(np.where(ok, np.abs(moved - gap / 2), np.inf)))
            shards[give[k]] = low
            if at[k]:
                shards[take[at[k] - 1]] = high
            load[high] -= moved[k]
            load[low] += moved[k]
        self.versions.append(shards)
        return int((shards != self.versions[-2]).sum())

    def grow(self) -> int:
        """Append the version with one more shard, which takes evenly from all others and gives nothing."""
        shards, n = self.shards.copy(), self.n_shards
        for s in range(n):
            own = np.flatnonzero(shards == s)
            shards[own[:: n + 1]] = n
        self.n_shards += 1
        self.versions.append(shards)
        return int((shards == n).sum())

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per version and slot; those of a version that is there already stay as they are."""
        rows = pd.concat(pd.DataFrame({"version": v, "slot": np.arange(len(m)), "shard": m, "shards": self.n_shards}) for v, m in enumerate(self.versions))
        spark.createDataFrame(pa.Table.from_pandas(rows.astype("int32"), preserve_index=False)).coalesce(1).write.mode("overwrite").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        rows = spark.read.parquet(path).toPandas().sort_values(["version", "slot"])
        versions = [g["shard"].to_numpy(np.int32) for _, g in rows.groupby("version")]
        return cls(int(rows["shards"].max()), versions)


def stored(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows (doc_id, size, text_crc32, shard, slot, virtual_slot, map_version) and the map.

    A map that map_path has is edited, grown where shards are more now, and its next version appended: only rows of
    moved slots move. Without one the slots are dealt anew.

    slot is the row's place in its shard, without gaps from 0. The text is read once and not shuffled; what
    reaches the driver is one row per slot and part, a number fixed by the parameters.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    record = F.struct("doc_id", "text_crc32", "size")
    rows = rows.withColumn("virtual_slot", virtual_slot(record, n_slots)).withColumn("part", F.pmod(F.xxhash64(F.lit(1), record), F.lit(PARTS)).cast("int"))
    rows = materialize(rows, "shard-rows")
    stats = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).toPandas()
    n = np.zeros((n_slots, PARTS), np.int64)
    n[stats["virtual_slot"], stats["part"]] = stats["n"]
    slot_bytes = np.bincount(stats["virtual_slot"], stats["bytes"], n_slots)
    slots = SlotMap.load(spark, map_path) if map_path and stored(spark, map_path) else SlotMap.dealt(n_slots, n_shards)
    if len(slots.shards) != n_slots or slots.n_shards > n_shards:
        raise ValueError(f"the stored map has {len(slots.shards)} slots and {slots.n_shards} shards")
    while slots.n_shards < n_shards:
        slots.grow()
    slots.rebalance(slot_bytes)
    slots.save(spark, map_path or shared_path(spark, "slot-map"))
    order = np.argsort(slots.shards, kind="stable")
    flat = n[order].ravel()
    before = np.cumsum(flat) - flat
    first = before[np.searchsorted(slots.shards[order], slots.shards[order]) * PARTS]  # where the shard begins
    place = np.empty_like(n)
    place[order] = before.reshape(-1, PARTS) - first[:, None]
    bounded = spark.createDataFrame(
        pa.table({
            "virtual_slot": np.repeat(np.arange(n_slots, dtype=np.int32), PARTS),
            "part": np.tile(np.arange(PARTS, dtype=np.int32), n_slots),
            "shard": np.repeat(slots.shards.astype(np.int32), PARTS),
            "place": place.ravel(),
        })
    )
    in_part = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    placed = (
        rows.withColumn("at", F.row_number().over(in_part) - 1)
        .join(F.broadcast(bounded), ["virtual_slot", "part"])  # n_slots * PARTS rows, whatever the input
        .select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("at")).cast("long").alias("slot"), "virtual_slot", F.lit(len(slots.versions) - 1).alias("map_version"))
    )
    return placed, slots
