"""Exact dedup: group by a 128-bit content hash, keep one id, compare bytes inside the groups.

DataFrame functions only. One wide aggregation carries the texts (equal texts meet in the map-side combine, so a hot group
sends one row per task); ids come back by a join of narrow rows, in which large groups stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import join_counted, keyed, table, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. The largest id of a group stays; null ids lose to any other and, if a group has no other,
    keep_id is null and one of its rows is kept. Of rows that repeat text and id, the last one in the files is kept. An empty
    table gives an empty result. Other columns are ignored, whatever their names.

    bits: of the hash that makes the groups (a multiple of 8); texts that differ under one hash are told apart by their bytes.
    """
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content")))
    rows = rows.withColumn("sha", F.unhex(F.sha2("content", 256))).withColumn("key", F.expr(f"substring(sha, 1, {bits // 8})"))
    keep = [F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n")]
    groups = written(rows.groupBy("key").agg(*keep, (F.min("content") != F.max("content")).alias("collided")), "exact-groups")
    narrow = rows.select("doc_id", "row", "sha", "key")
    out = join_counted(narrow, groups.filter("NOT collided").select("key", "keep", F.col("n").alias("group_size"), "n"), ["key"])
    collided = groups.filter("collided").select("key")
    if not collided.isEmpty():  # different texts under one hash: these rows are grouped by their bytes
        odd = written(rows.join(collided, "key", "left_semi"), "exact-collisions")
        sizes = written(odd.groupBy("content").agg(*keep), "exact-sizes").withColumn("group_size", F.col("n"))
        out = out.unionByName(join_counted(odd, sizes, ["content"]).select(*out.columns))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""
