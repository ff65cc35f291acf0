"""Operator 11: sharding by fixed virtual slots.

A record is hashed into one of a few thousand virtual slots; which shard a slot belongs to is
looked up in a map of one small number a slot.  Slots never change; the map is stored in versions, and a rebalancing
writes a new version in which as few slots as needed have another shard.  The law is ``bytes``: the
map is edited until the shards' bytes are near equal, so hot sources, long texts and groups of copies weigh what they weigh.

Records are reduced to (doc_id, size, crc32 of the text) before anything is shuffled, repeated rows to their count; what reaches the
driver is one row a slot, however large the table.  The number of a row in its shard comes from
the counts of the slots before its own and from a window within its slot, so that no task sees a whole shard.

Defined results: a null text is empty, of crc32 0 and size 16; a null doc_id counts as the empty text in the hash; repeated rows
are numbered each, runs of ``RUN`` equal ones go to slots of their own, so equal rows may lie in several shards; ties of load go to the smaller
shard, of slots to the smaller slot; one record larger than a shard's share stays whole, with its shard above the others; extra
columns are ignored; an empty table gives no rows and leaves the first map as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.llm.common import shared_dir, table, written

SLOTS, SHARDS = 8192, 40
#: So many equal rows share a virtual slot.
RUN = 64
#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: The shards may differ by this part of their mean.
TOLERANCE = 0.001


def dealt(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, doc_id, size, text_crc32, run, n): equal rows in runs of at most ``RUN``, each run in the slot of its hash."""
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    runs = records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    runs = runs.withColumn("n", F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32", "run")
    slot = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % slots
    return runs.select(slot.cast("int").alias("virtual_slot"), "doc_id", "size", "text_crc32", "run", "n")


def loads(runs: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes of each slot."""
    rows, size = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in runs.groupBy("virtual_slot").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("size")).collect():  # a row a slot at most
        rows[r["virtual_slot"]], size[r["virtual_slot"]] = r["n"], r["size"]
    return rows, size


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> np.ndarray:
    """The map before any record is known: slots in turn."""
    return np.arange(slots) % shards


def rebalanced(before: Sequence[int], size: np.ndarray, shards: int = SHARDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The map ``before``, edited until the shards' bytes are near equal; it may name more or fewer shards than there shall be.

    Slots of shards that go are moved first, the largest first, to the shard with least.  Then, again and again, the fullest shard that
    holds a slot smaller than its distance to the emptiest one gives it the slot that comes nearest to half of that distance.
    Every move brings two shards closer to each other, so the moves end: when that distance is within the tolerance, or no slot fits into it.
    """
    to = np.array(before, np.int64)
    left = np.flatnonzero(to >= shards)
    to[left] = -1
    load = np.bincount(to[to >= 0], size[to >= 0], shards).astype(np.int64)
    for s in left[np.argsort(-size[left], kind="stable")]:
        to[s] = int(np.argmin(load))
        load[to[s]] += size[s]
    allowed = tolerance * size.sum() / shards
    mine = [np.flatnonzero((to == k) & (size > 0)) for k in range(shards)]
    while True:
        low = int(np.argmin(load))
        for high in np.argsort(-load, kind="stable"):
            room = load[high] - load[low]
            if room <= allowed:
                return to
            fits = mine[high][size[mine[high]] < room]
            if len(fits):
                break
        else:
            return to
        s = int(fits[np.argmin(np.abs(2 * size[fits] - room))])
        to[s] = low
        load[[high, low]] += [-size[s], size[s]]
        mine[high], mine[low] = mine[high][mine[high] != s], np.sort(np.append(mine[low], s))


def save_map(spark: SparkSession, folder: str, version: int, to: Sequence[int], size: Sequence[int]) -> None:
    """Stores a version: (virtual_slot, shard, bytes), one row a slot; a version that is there is refused."""
    rows = [(k, int(x), int(b)) for k, (x, b) in enumerate(zip(to, size, strict=True))]
    spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long").coalesce(1).write.parquet(f"{folder.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> np.ndarray:
    """The shard of each slot in a stored version."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/version={version}").select("virtual_slot", "shard").collect()
    to = np.zeros(len(rows), np.int64)
    for r in rows:
        to[r["virtual_slot"]] = r["shard"]
    return to


def placed(runs: DataFrame, to: np.ndarray, rows: np.ndarray) -> DataFrame:
    """Every row with its shard and its number there: rows go by slot, then by doc_id, size and crc32."""
    order = np.lexsort((np.arange(len(to)), to))
    before = np.zeros(len(to), np.int64)
    ahead = np.cumsum(rows[order]) - rows[order]
    first = np.searchsorted(to[order], to[order])  # where the shard of each begins
    before[order] = ahead - ahead[first]
    spark = runs.sparkSession
    where = spark.createDataFrame([(k, int(s), int(b)) for k, (s, b) in enumerate(zip(to, before, strict=True))], "virtual_slot int, shard int, before long")
    window = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "run").rowsBetween(W.unboundedPreceding, -1)
    at = runs.withColumn("at", F.coalesce(F.sum("n").over(window), F.lit(0)))
    named = at.join(F.broadcast(where), "virtual_slot")  # a row a slot
    return named.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", F.explode(F.sequence(F.col("before") + F.col("at"), F.col("before") + F.col("at") + F.col("n") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS, version: int = 1, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row's shard after the map of ``version - 1`` (the first map, where none is stored) was edited for these documents and stored."""
    spark = docs.sparkSession
    runs = written(dealt(docs, slots))
    rows, size = loads(runs, slots)
    if version == 1:
        save_map(spark, folder, 0, first_map(slots, shards), np.zeros(slots, np.int64))
    save_map(spark, folder, version, rebalanced(read_map(spark, folder, version - 1), size, shards, tolerance), size)
    return placed(runs, read_map(spark, folder, version), rows)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = shard_documents(docs, f"{shared_dir(spark).rstrip('/')}/slots-{uuid.uuid4().hex}")
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
