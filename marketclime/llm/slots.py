"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; bytes are added up per slot; a
versioned table says which shard has which slot. Balancing and rebalancing only
edit that table, whose size never depends on the data, so the driver may hold
it. Records are numbered within their shard without sorting a shard in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketclime.session import cut_lineage

SLOTS = 4096
SALTS = 64
HEAVY = 4  # shares of a slot above which equal rows are dealt out


def slot_records(docs: DataFrame, slots: int = SLOTS, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and a salt per row.

    Size is the text's UTF-8 bytes (null: none) plus ``overhead``; the CRC is
    unsigned, 0 for null or empty text. The slot hashes id and text, so a
    repeated id with another text may go elsewhere. Rows equal in both share a
    slot, unless together they weigh more than ``HEAVY`` slots' shares: then
    their place in the input deals them over all slots, so that repeated rows
    cannot tip a shard. Null ids and texts are values like others; other
    columns of ``docs`` are not looked at. An empty table gives no rows.

    The rows are written out first, so the places and with them the slots are
    settled whatever is read again later.
    """
    crc = F.coalesce(F.crc32("text"), F.lit(0).cast("long"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long")
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")).select(
        "*",
        F.xxhash64("doc_id", "text_crc32", "size").alias("_key"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_deal"),
        F.pmod(F.hash(F.spark_partition_id()), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    rows = cut_lineage(rows, "slots").withColumn("virtual_slot", _slot("_key", slots))
    heavy = heavy_keys(rows, slots)
    if heavy is not None:
        dealt = F.when(F.col("_heavy"), _slot("_deal", slots)).otherwise(F.col("virtual_slot"))
        rows = rows.join(heavy, "_key", "left").withColumn("virtual_slot", dealt)
    return rows.select("doc_id", "size", "text_crc32", "virtual_slot", "_salt")


def _slot(column: str, slots: int) -> Column:
    return F.pmod(F.col(column), F.lit(slots)).cast("int")


def heavy_keys(records: DataFrame, slots: int) -> DataFrame | None:
    """Keys of equal rows that weigh more than ``HEAVY`` slots' shares of all bytes: fewer than slots / HEAVY.

    Only rows in slots of that weight are grouped by key. None where no slot is so heavy.
    """
    weights = slot_bytes(records)
    limit = HEAVY * sum(weights.values()) // slots
    crowded = [slot for slot, weight in weights.items() if weight > limit]
    if not crowded:
        return None
    keys = records.filter(F.col("virtual_slot").isin(crowded)).groupBy("_key").agg(F.sum("size").alias("_bytes"))
    return cut_lineage(keys.filter(F.col("_bytes") > limit).select("_key", F.lit(True).alias("_heavy")), "heavy-keys")


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes per virtual slot: one number per slot, whatever the data."""
    return {r[0]: r[1] for r in records.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def balance(weights: Mapping[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """A slot-to-shard map: heaviest slot first, each to the lightest shard."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, count, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), count + 1, shard))
    return out


def rebalance(current: Sequence[int], weights: Mapping[int, int], shards: int) -> list[int]:
    """Edit a map for another number of shards, or for new weights, moving few slots.

    Slots of dropped shards are dealt out first; then slots go from the
    heaviest to the lightest shard for as long as that narrows the gap.
    """
    out = list(current)
    loads = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(out):
        weight = weights.get(slot, 0)
        if shard < shards:
            loads[shard] += weight
            held[shard].append((weight, slot))
        else:
            homeless.append((weight, slot))
    for weight, slot in sorted(homeless, reverse=True):
        shard = min(range(shards), key=lambda s: (loads[s], s))
        out[slot] = shard
        loads[shard] += weight
        held[shard].append((weight, slot))
    while True:
        high, low = max(range(shards), key=lambda s: loads[s]), min(range(shards), key=lambda s: loads[s])
        gap = loads[high] - loads[low]
        movable = [x for x in held[high] if 0 < x[0] < gap]
        if not movable:
            return out
        weight, slot = min(movable, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[high].remove((weight, slot))
        held[low].append((weight, slot))
        loads[high] -= weight
        loads[low] += weight
        out[slot] = low


def write_map(spark: SparkSession, path: str, version: int, assignment: Sequence[int]) -> None:
    """Store one version of a map as a partition of the table at ``path``; a version that exists is refused, earlier ones stay."""
    rows = spark.createDataFrame(list(enumerate(assignment)), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A stored version: virtual_slot and shard."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def place_records(records: DataFrame, assignment: DataFrame) -> DataFrame:
    """Add ``shard`` and ``slot``, the row's place within its shard, gapless from 0.

    Offsets are running sums over (slot, salt) cells, a fixed number; rows are
    ordered only inside a cell.
    """
    cells = records.groupBy("virtual_slot", "_salt").agg(F.count(F.lit(1)).alias("_n")).join(assignment, "virtual_slot")
    upto = Window.partitionBy("shard").orderBy("virtual_slot", "_salt")
    cells = cells.select("virtual_slot", "_salt", "shard", (F.sum("_n").over(upto) - F.col("_n")).alias("_offset"))
    cells = cut_lineage(cells, "slot-cells")
    inside = Window.partitionBy("virtual_slot", "_salt").orderBy("doc_id", "text_crc32", "size")
    numbered = records.withColumn("_place", F.row_number().over(inside) - 1)
    return (
        numbered.join(cells, ["virtual_slot", "_salt"])
        .withColumn("slot", (F.col("_offset") + F.col("_place")).cast("long"))
        .drop("_offset", "_place", "_salt")
    )


def shard_documents(docs: DataFrame, path: str, shards: int = 24, version: int = 1) -> DataFrame:
    """Put all documents into shards of nearly equal bytes.

    The map is stored below ``path`` as ``version``; edited for one more shard
    it is stored as the version after that, and ``next_shard`` is each row's
    shard under it. Repeated rows, null ids and null texts each keep a row; an
    empty table gives no rows and both maps.
    """
    spark = docs.sparkSession
    records = slot_records(docs)
    weights = slot_bytes(records)
    first = balance(weights, shards)
    write_map(spark, path, version, first)
    write_map(spark, path, version + 1, rebalance(first, weights, shards + 1))
    edited = read_map(spark, path, version + 1).withColumnRenamed("shard", "next_shard")
    return place_records(records, read_map(spark, path, version)).join(edited, "virtual_slot")
