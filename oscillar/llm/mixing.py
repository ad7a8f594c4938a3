"""Mixing sources to target weights over a curriculum that changes with time.

Every source has a weight and a schedule: its share of the mix moves linearly from start to end over the training run, with
mean one. A document's place in its source's cumulative demand of words, put through the inverse of the schedule's integral,
is its training position; the result is range-sorted by position. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oscillar.llm.common import keyed, table, written

WEIGHTS = (3, 1, 2)
#: (share at the start, share at the end), mean one, dealt to the sources in their order.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size → target and slope too. A row per source, so one window over all of them is small.

    Targets are the water level: min(most * size, level * weight), which is what resharing the excess by weight comes to.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("rank"), F.lit(len(values))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", pick(weights)).withColumn("slope", pick([b - a for a, b in schedules]) / 2)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("wanted", F.sum("source_size").over(everything) * total)
    s = s.withColumn("filled", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    s = s.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("wanted") - F.col("filled")) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"), "slope")


def position_of(share: Column, slope: Column) -> Column:
    """The time t in [0, 1] at which t + slope * (t * t - t), the schedule's integral, reaches the share."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise(((slope - 1) + root) / (2 * slope))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document, sorted by position: doc_id, size, source_size, target, taken, source, position.

    Size is the number of words; a null or empty text has size 0 and taken 0. Documents follow each other in the order of
    md5(id) within a source (null ids: md5 of their place in the files), ties by id and size; repeated rows each take their
    own words.
    taken is the difference of the rounded cumulative target before and after the document, so a source's words come within
    one of its target and no document exceeds the repeat limit. A source that is null is a source of its own. An empty
    table gives an empty result. Extra columns are ignored.

    Running sums are cut into bins of the md5 order, as many as the rows ask for, so no source is one task's work.
    """
    return placed(docs, id_col, text_col, source_col, **how).drop("turn").orderBy("position", "doc_id")


def bin_digits(n: int) -> int:
    """Digits of the md5 order that make the bins of so many rows."""
    return 2 if n < 2**26 else 3 if n < 2**32 else 4


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, key: list[str] | None = None, **how) -> DataFrame:
    """The rows of mix_sources, unsorted, with turn (their place in the md5 order) and the columns of key; among these row may be the number of keyed()."""
    key = key or []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("content"), *key)
    rows = rows if "row" in key else keyed(rows)
    own = F.concat_ws("|", F.lit("row"), "row")
    rows = rows.select(
        *key,
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("content", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), own)).alias("turn"),
    )
    rows = rows.withColumn("bin", F.substring("turn", 1, bin_digits(docs.count())))
    per_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), **how)
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = per_bin.withColumn("bin_start", F.sum("bin_size").over(before) - F.col("bin_size"))
    side = lambda df: df.withColumnsRenamed({"source": "s_"})
    bins = bins.join(side(targets), F.col("source").eqNullSafe(F.col("s_"))).drop("s_", "bin_size").withColumnsRenamed({"source": "s_", "bin": "b_"})
    run = Window.partitionBy("source", "bin").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("upto", F.sum("size").over(run)).join(bins, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bin") == F.col("b_")))
    upto, size = F.col("upto") + F.col("bin_start"), F.col("size")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share = F.when(F.col("source_size") > 0, (upto - size / 2) / F.col("source_size")).otherwise(F.lit(0.0))
    taken = F.least(F.floor(ratio * upto) - F.floor(ratio * (upto - size)), 2 * size).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", position_of(share, F.col("slope")).alias("position"), "turn", *key)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: str = "row", **how) -> DataFrame:
    """key, copies, position: how often each row is read when the mix is carried out on whole documents; 0 copies are left out.

    key: a column that no two rows share. With ratio = target / source_size, every document of a source is read
    floor(ratio) times, and once more if its middle lies within the words that are still wanted, by running sums in a second
    md5 order (so those left out are spread over all positions). A source's words, copies counted, come within half a
    document of its target. Documents without words are left out, as the mix takes none of theirs. All copies have the
    position that mix_sources gives the document.
    """
    rows = placed(docs, id_col, text_col, source_col, [key], **how).filter("size > 0").withColumn("draw", F.md5(F.concat(F.lit("again "), "turn")))
    rows = written(rows.withColumn("bin", F.substring("draw", 1, bin_digits(docs.count()))).drop("doc_id", "taken", "turn"), "mix-places")
    before = Window.partitionBy("s_").orderBy("b_").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy(F.col("source").alias("s_"), F.col("bin").alias("b_")).agg(F.sum("size").alias("bin_size"))
    bins = bins.select("s_", "b_", (F.sum("bin_size").over(before) - F.col("bin_size")).alias("bin_start"))
    run = Window.partitionBy("source", "bin").orderBy("draw", key).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("upto", F.sum("size").over(run)).join(bins, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bin") == F.col("b_")))
    whole = F.floor(F.col("target") / F.col("source_size"))
    middle = F.col("bin_start") + F.col("upto") - F.col("size") / 2
    copies = (whole + (middle <= F.col("target") - whole * F.col("source_size")).cast("int")).cast("int")
    return out.select(key, copies.alias("copies"), "position").filter("copies > 0")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), md5(text), '') AS turn
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, [-0.5::DOUBLE, 0, 0.5][rank % 3 + 1] AS slope, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM s2),
s4 AS (SELECT *, (wanted - (sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
s5 AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS lam FROM s4),
s6 AS (SELECT source, source_size, slope, least(cap, coalesce(lam * weight, cap)) AS target FROM s5),
r1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM rows),
r2 AS (SELECT r1.*, source_size, target, slope,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
         CASE WHEN source_size > 0 THEN (upto - size / 2) / source_size ELSE 0 END AS share
       FROM r1 JOIN s6 ON r1.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target,
  least(floor(ratio * upto) - floor(ratio * (upto - size)), 2 * size)::BIGINT AS taken, source,
  CASE WHEN slope = 0 THEN share ELSE ((slope - 1) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope) END AS position
FROM r2
"""
