"""Consistent-hash ring with virtual nodes and bounded loads.

Keys are placed in ring order on the first shard clockwise that is not full, so the balance is given by the capacities. The
placement is worked out from the number of keys on each arc (a few hundred numbers, whatever the data) and every row then
finds its shard by its rank on the ring. Ranks come from fixed-width bins of the hash: counts first, then a window per bin.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oscillar.llm.common import identified, table

RING_BITS = 60
VIRTUAL_NODES = 64
BIN_ROWS = 100_000


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """Positions of the virtual nodes in ascending order, and the shard of each. A key belongs to the first node at or after it."""
    nodes = sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Row limits per shard; without slack they add up to the rows, so counts are at most one apart."""
    return [int((rows // shards + (s < rows % shards)) * (1 + slack)) for s in range(shards)]


def placements(counts: dict[int, int], owners: list[int], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where keys go that enter in ring order and overflow clockwise.

    The arc numbered len(owners) lies behind the last node and belongs to node 0.
    """
    load, out = [0] * len(limits), []
    for arc in sorted(counts):
        left, at, k = counts[arc], 0, arc % len(owners)
        for step in range(len(owners)):
            if not left:
                break
            shard = owners[(k + step) % len(owners)]
            take = min(left, limits[shard] - load[shard])
            if take > 0:
                out.append((arc, at, at + take, shard, load[shard]))
                load[shard], at, left = load[shard] + take, at + take, left - take
    return out


def place(keys: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """Adds shard and slot to rows that have ring_pos (0 to 2**60 - 1); rows that tie there are ordered by their other columns.

    An empty table gives an empty result.
    """
    spark, others = keys.sparkSession, [c for c in keys.columns if c != "ring_pos"]
    positions, owners = ring(shards, virtual_nodes)
    bounds = np.array(positions, np.int64)

    @F.arrow_udf("int")
    def arc_of(pos: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, np.asarray(pos), side="left").astype(np.int32))

    keys = keys.withColumn("arc", arc_of("ring_pos"))
    counts = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per virtual node
    total = sum(counts.values())
    begins, at = {}, 0
    for arc in sorted(counts):
        begins[arc], at = at, at + counts[arc]
    spans = [(a, begins[a] + lo, begins[a] + hi, s, slot) for a, lo, hi, s, slot in placements(counts, owners, capacities(total, shards, slack))]
    spans = spark.createDataFrame(spans, "arc int, rank_from long, rank_to long, shard int, first_slot long")
    shift = RING_BITS - min(24, max(0, (total // BIN_ROWS).bit_length()))
    keys = keys.withColumn("bin", F.shiftright("ring_pos", shift))
    bins = keys.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("bin_start", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    turn = F.row_number().over(Window.partitionBy("bin").orderBy("ring_pos", *others))
    ranked = keys.withColumn("turn", turn).join(bins, "bin").withColumn("rank", F.col("bin_start") + F.col("turn") - 1)
    out = ranked.join(F.broadcast(spans), "arc").filter("rank >= rank_from AND rank < rank_to")  # spans: two rows per virtual node at most
    return out.select(*others, "shard", (F.col("first_slot") + F.col("rank") - F.col("rank_from")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; law rows: counts at most one apart.

    size is the text's UTF-8 bytes plus 1, and a null text has no bytes and the checksum 0. The key is the id; rows without
    an id are spread by their place in the files. Repeated rows tie and take neighbouring slots. An empty table gives an
    empty result. Extra columns are ignored.

    With slack, a shard may hold so much more than its equal share (law key: counts are bounded, and a further shard moves
    about the rows that it takes and those that it makes room for); without, shards are filled evenly and more rows move.
    """
    rows = identified(docs, id_col, text_col)
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))
    rows = rows.select(
        "doc_id",
        (F.octet_length("content") + 1).cast("long").alias("size"),
        F.crc32("content").alias("text_crc32"),
        F.conv(F.substring(hashed, 1, RING_BITS // 4), 16, 10).cast("long").alias("ring_pos"),
    )
    out = place(rows, shards, slack=slack)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
