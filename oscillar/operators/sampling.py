"""Balanced samples of labelled windows: weights from the counts of a hierarchy, draws without replacement by exponential keys.

A hierarchy is a list of levels from the widest to the group of windows; at each level every value under those above it has the
same chance, and so has every row of the last. Samplers differ in their levels alone, or mix two hierarchies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscillar.functions import signal

#: so many groups (some MB) are broadcast.
FEW = 100_000
#: cells of keys in an octave.
CELLS = 64


def group_weights(rows: DataFrame, levels: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """levels and weight: the chance of each single row of a group. Rows that lack a level are left out.

    shares: the chances of the values of the first level, which are even otherwise; those that the rows don't have fall to the
    others in proportion.
    """
    groups = rows.dropna("any", subset=levels).groupBy(*levels).agg(F.count(F.lit(1)).alias("weight_")).withColumn("weight_", 1 / F.col("weight_"))
    for depth in range(len(levels), 0, -1):
        above = levels[: depth - 1]
        values = groups.select(*levels[:depth]).distinct()
        if depth == 1 and shares:
            share = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col(levels[0]).cast("string"))
            known = values.select(levels[0], F.coalesce(share, F.lit(0.0)).alias("share_"))
            known = known.join(F.broadcast(known.agg(F.sum("share_").alias("all_")))).select(levels[0], (F.col("share_") / F.col("all_")).alias("part_"))
        else:
            known = values.groupBy(*above).agg((1 / F.count(F.lit(1))).alias("part_"))
        groups = groups.join(known, above or [levels[0]]) if above or (depth == 1 and shares) else groups.join(F.broadcast(known))  # one row
        groups = groups.withColumn("weight_", F.col("weight_") * F.col("part_")).drop("part_")
    return groups.withColumnRenamed("weight_", "weight")


def weighted(rows: DataFrame, groups: DataFrame, levels: list[str], name: str = "weight") -> DataFrame:
    """rows with the weight of their group; groups of group_weights()."""
    groups = groups.withColumnRenamed("weight", name)
    return rows.join(F.broadcast(groups) if groups.count() <= FEW else groups, levels)


def balanced_weights(rows: DataFrame, mode: str, dataset: str, state: str, group: str, mix: float = 0.5) -> DataFrame:
    """rows with weight, their chance in a single draw.

    mode: "uniform" draws dataset, group and row; "state" draws dataset, state, group and row; "hybrid" does the latter in a share
    `mix` of the draws. A group lies in one state of its dataset.
    """
    ways = {"uniform": [dataset, group], "state": [dataset, state, group]}
    if mode in ways:
        return weighted(rows, group_weights(rows.dropna("any", subset=[state]), ways[mode]), ways[mode])
    if mode != "hybrid":
        raise ValueError(f"no mode {mode!r}")
    both = rows.dropna("any", subset=[state])
    for way, levels in ways.items():
        both = weighted(both, group_weights(rows.dropna("any", subset=[state]), levels), levels, f"{way}_")
    return both.withColumn("weight", mix * F.col("state_") + (1 - mix) * F.col("uniform_")).drop("state_", "uniform_")


def mixed_groups(rows: DataFrame, dataset: str, state: str, group: str) -> DataFrame:
    """dataset, group of the groups that lie in several states, which a sampler by states doesn't take."""
    return rows.dropna("any", subset=[dataset, state, group]).groupBy(dataset, group).agg(F.min(state).alias("low_"), F.max(state).alias("high_")).filter("low_ <> high_").select(dataset, group)


def task_weights(rows: DataFrame, family: str, target: str, dataset: str, state: str, group: str, target_share: float = 0.5) -> DataFrame:
    """rows with weight for tasks of the families global and target (column family).

    A share of the draws goes to target tasks, where all target numbers have the same chance before states, datasets and groups;
    global tasks draw dataset, state and group. Without target tasks all draws are global.
    """
    tasks = rows.filter(F.col(family).isin("global", "target")).withColumn("index_", F.when(F.col(family) == "target", F.col(target).cast("string")).otherwise("all"))
    inner = {"global": [dataset, state, group], "target": [state, dataset, group]}
    shares = {"global": 1 - target_share, "target": target_share}
    there = {r[0] for r in tasks.select(family).distinct().collect()}  # two at most
    out = None
    for kind in sorted(there):
        levels = ["index_", *inner[kind]]
        own = tasks.filter(F.col(family) == kind)
        own = weighted(own, group_weights(own, levels), levels).withColumn("weight", F.col("weight") * (shares[kind] / sum(shares[k] for k in there) if len(there) > 1 else 1.0))
        out = own if out is None else out.unionByName(own)
    return (tasks.withColumn("weight", F.lit(0.0)) if out is None else out).drop("index_")


def draw(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if there are fewer) drawn without replacement by their weight (a sampling operator); rows of weight 0 or none are never drawn.

    A row's exponential key is -log(u) / weight, u from a hash of seed and key, and the n smallest are the draw; so reruns agree.
    Keys are counted in cells: those below the border cell are in, and only its own rows are put in order.
    """
    u = 1 - signal.hash_fraction(seed, F.col(key).cast("string"))
    keyed = rows.filter("weight > 0").withColumn("key_", -F.log(u) / F.col("weight"))
    keyed = keyed.withColumn("cell_", F.when(F.col("key_") > 0, F.floor(F.log2(F.when(F.col("key_") > 0, F.col("key_"))) * CELLS)).otherwise(-(1 << 40)).cast("long"))
    counts = sorted((r.cell_, r["count"]) for r in keyed.groupBy("cell_").count().collect())  # some thousands of cells, whatever the rows
    border, left = None, n
    for cell, count in counts:
        if count >= left:
            border = cell
            break
        left -= count
    if border is None:
        return keyed.drop("key_", "cell_")
    last = keyed.filter(F.col("cell_") == border).orderBy("key_", key).limit(left)
    return keyed.filter(F.col("cell_") < border).unionByName(last).drop("key_", "cell_")
