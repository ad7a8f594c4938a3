"""Labelled-corpus tooling: leak-free splits, audits, profiles of normal behaviour, evaluation metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def allocation(total: Column, ratios: tuple[float, ...]) -> list[Column]:
    """Groups per split of a bucket: all to train if one, train and test if two, else one each and the rest by largest remainder."""
    rest = F.greatest(total - len(ratios), F.lit(0))
    floors = [F.floor(rest * r) for r in ratios]
    left = rest - sum(floors[1:], floors[0])
    parts = [rest * r - f for r, f in zip(ratios, floors, strict=True)]
    out = []
    for i, f in enumerate(floors):
        better = F.lit(0)
        for j in range(len(ratios)):
            if j != i:
                first = (ratios[j], -j) > (ratios[i], -i)
                better = better + ((parts[j] > parts[i]) | ((parts[j] == parts[i]) & F.lit(first))).cast("int")
        many = 1 + f + (better < left).cast("int")
        few = F.when(total == 1, F.lit(1 if i == 0 else 0)).otherwise(F.lit(1 if i in (0, len(ratios) - 1) else 0))
        out.append(F.when(total < 3, few).otherwise(many))
    return out


def assign_splits(groups: DataFrame, dataset: str, stratum: str, group: str, seed: int = 0, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """dataset, stratum, group_id, split: whole groups in one split, allocated in each (dataset, stratum) by hash order.

    A bucket's counts come from one aggregate; ranks come from windows over bins of the hash, so no bucket is one task's work.
    """
    g = groups.select(F.col(dataset).alias("dataset"), F.col(stratum).alias("stratum"), F.col(group).cast("string").alias("group_id")).distinct()
    g = g.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}\0"), "group_id"), 256)).withColumn("bin", F.substring("h", 1, 2))
    bins = g.groupBy("dataset", "stratum", "bin").agg(F.count(F.lit(1)).alias("k"))
    bucket = Window.partitionBy("dataset", "stratum")
    bins = bins.withColumns({"before": F.sum("k").over(bucket.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"), "total": F.sum("k").over(bucket)})
    turn = F.row_number().over(Window.partitionBy("dataset", "stratum", "bin").orderBy("h", "group_id"))
    ranked = g.withColumn("turn", turn).join(bins, ["dataset", "stratum", "bin"]).withColumn("rank", F.col("before") + F.col("turn"))
    train, val, _ = allocation(F.col("total"), ratios)
    split = F.when(F.col("rank") <= train, SPLITS[0]).when(F.col("rank") <= train + val, SPLITS[1]).otherwise(SPLITS[2])
    return ranked.select("dataset", "stratum", "group_id", split.alias("split"))


def leaking_groups(assigned: DataFrame) -> DataFrame:
    """Groups found in more than one split; empty for a sound assignment."""
    return assigned.groupBy("group_id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def corpus_counts(assigned: DataFrame) -> DataFrame:
    """Groups by dataset and split with all subtotals (cube); null means all."""
    return assigned.cube("dataset", "split").agg(F.count(F.lit(1)).alias("groups"), F.count_distinct("stratum").alias("strata"))


def healthy_profile(rows: DataFrame, keys: list[str], value: str, group: str, least: int = 8, least_groups: int = 2, floor: float = 1e-3) -> DataFrame:
    """Mean and floored deviation for every level of the keys (exact, then dropping keys from the left), with validity."""
    levels = [keys[i:] for i in range(len(keys))]
    sets = ", ".join("(" + ", ".join(k) + ")" for k in levels)
    view = rows.select(*keys, F.col(value).alias("v"), F.col(group).alias("g"))
    out = view.sparkSession.sql(
        f"SELECT {', '.join(keys)}, grouping_id() AS level, count(v) AS n, avg(v) AS mean, greatest(coalesce(stddev_samp(v), 0), {floor}) AS std, count(DISTINCT g) AS independent"
        f" FROM {{view}} GROUP BY GROUPING SETS ({sets})",
        view=view,
    )
    return out.withColumn("valid", (F.col("n") >= least) & (F.col("independent") >= least_groups))


def profile_scores(rows: DataFrame, profile: DataFrame, keys: list[str], value: str, clip: float = 12.0) -> DataFrame:
    """rows with z and level: the first valid profile from the exact key to the most general, clipped.

    A profile has a row per key combination; each level is an equi-join.
    """
    out, found = rows, []
    for i in range(len(keys)):
        on = keys[i:]
        level = (1 << i) - 1 << (len(keys) - i)  # grouping_id: a bit for each dropped key
        p = profile.filter((F.col("level") == level) & F.col("valid")).select(*on, F.struct("mean", "std", F.lit(i).alias("level")).alias(f"p{i}"))
        out = out.join(p, on, "left")
        found.append(f"p{i}")
    best = F.coalesce(*found)
    raw = (F.col(value) - best["mean"]) / best["std"]
    z = F.when(raw.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), raw)))
    return out.select(*rows.columns, z.alias("z"), best["level"].alias("profile_level"))


def classification_metrics(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """label, support, precision, recall, f1 per class and for 'macro' and 'accuracy', from one count of the confusion matrix."""
    m = pairs.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("fn_"), F.lit(0).cast("long").alias("fp_")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("fn_"), F.col("n").alias("fp_"))))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    both = m.select(hit.alias("tp"), sides.alias("s")).select("s.label", (F.col("tp") * (F.col("s.fn_") > 0).cast("long")).alias("tp"), "s.fn_", "s.fp_")
    per = both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fn_").alias("support"), F.sum("fp_").alias("called"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = safe(F.col("tp"), F.col("called")), safe(F.col("tp"), F.col("support"))
    per = per.select("label", "support", p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"), "tp")
    macro = per.filter("support > 0").agg(F.lit("macro").alias("label"), F.sum("support").alias("support"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    total = per.agg(F.lit("accuracy").alias("label"), F.sum("support").alias("support"), *((F.sum("tp") / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")))
    return per.drop("tp").unionByName(macro).unionByName(total)


def calibration_error(pairs: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """n and the expected calibration error over equal bins, the last one inclusive."""
    b = pairs.groupBy(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    return b.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def auroc(pairs: DataFrame, score: str = "confidence", positive: str = "correct", cells: int = 256) -> DataFrame:
    """n_pos, n_neg and the area under the curve by mid-ranks; rows are counted per score before they are ranked.

    Scores lie in cells between their approximate quantiles: negatives are summed over cells first, then within a cell, so no task ranks all scores.
    """
    y = F.col(positive).cast("int")
    per = pairs.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cuts = pairs.agg(F.percentile_approx(F.col(score).cast("double"), [k / cells for k in range(1, cells)]).alias("cuts"))
    per = per.join(F.broadcast(cuts)).withColumn("cell", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("s"))), F.lit(0))).drop("cuts")  # one row
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    sums = per.groupBy("cell").agg(F.sum("neg").alias("held"))
    sums = sums.select("cell", (F.sum("held").over(upto) - F.col("held")).alias("before"))
    inside = F.sum("neg").over(Window.partitionBy("cell").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    wins = per.withColumn("inside", inside).join(sums, "cell").withColumn("wins", F.col("pos") * (F.col("before") + F.col("inside") + F.col("neg") / 2))
    return wins.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("wins") / (F.sum("pos") * F.sum("neg"))).alias("auroc"))


def routing_matrix(pairs: DataFrame, labels: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """truth, predicted, n for every cell of the fixed labels, empty ones included."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    counts = pairs.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gate_checks(metrics: DataFrame, gates: list[tuple[str, str, float, bool]]) -> DataFrame:
    """name, observed, passed for gates (name, 'min' or 'max', threshold, required) on metrics (name, value); optional gates pass, and record."""
    g = metrics.sparkSession.createDataFrame(gates, "name string, kind string, threshold double, required boolean")
    met = g.join(metrics, "name", "left")
    ok = F.coalesce(F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")), F.lit(False))
    return met.select("name", "threshold", "value", ok.alias("observed_passed"), (ok | ~F.col("required")).alias("passed"))


def quota_draw(rows: DataFrame, group: str, key: str, quota: int, seed: int = 0) -> DataFrame:
    """`quota` rows drawn round robin over groups in hash order (a sampling operator: its limit is the feature)."""
    h = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return rows.withColumn("turn", turn).filter(F.col("turn") <= quota).orderBy("turn", F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(group)), 256), h).limit(quota)
