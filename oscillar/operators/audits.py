"""Audits and materialisation of a labelled corpus: coverage, gaps, contracts, windows, balanced schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def set_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """side, key: what is expected and not found (missing) and the other way round (extra)."""
    e, f = expected.select(key).distinct(), found.select(key).distinct()
    return e.join(f, key, "left_anti").select(F.lit("missing").alias("side"), key).unionByName(f.join(e, key, "left_anti").select(F.lit("extra").alias("side"), key))


def split_gaps(episodes: DataFrame, assigned: DataFrame, materialized: tuple[str, ...] = SPLITS, build: dict[str, int] | None = None) -> DataFrame:
    """gap, item, n: what is wrong with the splits of episodes (episode, dataset, split, group) by an assignment (group, split).

    build: episode counts by split, and 'total', as an earlier report gives them.
    """
    known, there = F.col("split").isin(*SPLITS), F.col("split").isin(*materialized)
    own = episodes.join(assigned.select("group", F.col("split").alias("assigned")), "group", "left")
    kinds = F.array_compact(F.array(
        F.when(~known, "episode_has_invalid_split"), F.when(known & ~there, "episode_from_nonmaterialized_split"), F.when(known & F.col("assigned").isNull(), "episode_group_missing_from_assignment"),
        F.when(known & (F.col("assigned") != F.col("split")), "episode_assignment_mismatch"),
    ))
    found = own.select(F.explode(kinds).alias("gap"), F.col("dataset").alias("item")).groupBy("gap", "item").agg(F.count(F.lit(1)).alias("n"))
    spark = episodes.sparkSession
    names = spark.createDataFrame([(s, s in materialized) for s in SPLITS], "split string, there boolean")
    per = names.join(episodes.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    empty = per.filter("there AND n = 0").select(F.lit("materialized_split_has_no_episodes").alias("gap"), F.col("split").alias("item"), "n")
    several = episodes.groupBy("group").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("group_in_several_splits").alias("gap"), F.col("group").alias("item"), "n")
    out = found.unionByName(empty).unionByName(several)
    if build:
        b = spark.createDataFrame(list(build.items()), "item string, told long")
        counts = per.select(F.col("split").alias("item"), "n").unionByName(episodes.agg(F.lit("total").alias("item"), F.count(F.lit(1)).alias("n")))
        kind = F.when(F.col("item") == "total", "build_total_episode_count_mismatch").otherwise("build_split_episode_count_mismatch")
        out = out.unionByName(b.join(counts, "item").filter("told <> n").select(kind.alias("gap"), "item", "n"))
    return out


def supervised_coverage(episodes: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """dataset, split, labelled, status: error where a dataset with labels has none in a split, limitation where it has none at all."""
    s = episodes.sparkSession.createDataFrame([(x,) for x in splits], "split string")
    datasets = episodes.groupBy("dataset").agg(F.count_if("labelled").alias("all_labelled"))
    cells = datasets.withColumn("split", F.explode(F.array(*map(F.lit, splits))))
    n = episodes.groupBy("dataset", "split").agg(F.count_if("labelled").alias("labelled"))
    out = cells.join(n, ["dataset", "split"], "left").join(F.broadcast(s), "split").withColumn("labelled", F.coalesce("labelled", F.lit(0)))
    status = F.when(F.col("all_labelled") == 0, "limitation").when(F.col("labelled") == 0, "error").otherwise("covered")
    return out.select("dataset", "split", "labelled", status.alias("status"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of every rule that a row breaks (its condition is not true); repeated keys break 'unique'."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in rules.items())))
    single = rows.select(key, F.explode(broken).alias("rule"))
    return single.unionByName(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("unique").alias("rule")))


def episode_windows(recordings: DataFrame, size: int, stride: int, least_valid: float = 0.98) -> DataFrame:
    """recording, start, valid of the windows of size samples, stride apart, of arrays x; windows of too few finite values are left out."""
    starts = F.when(F.size("x") >= size, F.sequence(F.lit(0), F.size("x") - size, F.lit(stride)))
    cut = recordings.select("recording", "x", F.explode(starts).alias("start")).select("recording", "start", F.slice("x", F.col("start") + 1, size).alias("w"))
    valid = F.size(F.filter("w", lambda v: v.isNotNull() & ~F.isnan(v))) / size
    return cut.select("recording", "start", valid.alias("valid"), "w").filter(F.col("valid") >= least_valid)


def centred_starts(n: Column, size: int, windows: int) -> Column:
    """Starts of so many windows, each in the middle of an equal stretch of n samples; all of them within the recording."""
    return F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.greatest(F.lit(0), F.least(n - size, F.floor((2 * k + 1) * n / (2 * windows) - size / 2).cast("int"))))


def supervision_tasks(episodes: DataFrame, targets: int = 5) -> DataFrame:
    """episode, task, label: one global row for every labelled episode (state not null) and a row for each target where they are supervised (affected not null)."""
    whole = F.array(F.struct(F.lit("global").alias("task"), F.col("state").alias("label")))
    each = F.transform(F.sequence(F.lit(1), F.lit(targets)), lambda t: F.struct(F.concat(F.lit("target_"), t).alias("task"), F.when(F.array_contains("affected", t), "affected").otherwise("normal").alias("label")))
    tasks = F.when(F.col("affected").isNotNull(), F.concat(whole, each)).otherwise(whole)
    return episodes.filter("state IS NOT NULL").select("episode", F.explode(tasks).alias("t")).select("episode", "t.task", "t.label")


def slot_order(seed: int, key: Column, slots: int = 5) -> Column:
    """The slots 1 to n in an order of their own for each key: by the SHA-256 of seed, key and slot."""
    told = F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda s: F.struct(F.sha2(F.concat(F.lit(f"{seed}\0"), key.cast("string"), F.lit("\0"), s), 256).alias("h"), s.alias("s")))
    return F.transform(F.array_sort(told), lambda t: t["s"])


def balanced_schedule(rows: DataFrame, levels: list[str], key: str, draws: int, seed: int = 0) -> DataFrame:
    """draw, key: so many draws with replacement, each level's value drawn evenly among those under the values drawn before (a sampling operator).

    A draw's number at a level is a hash of seed, draw and level; values are numbered, so every step is an equi-join.
    """
    pick = lambda name, n: (F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}\0{name}\0"), F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("long"), n) + 1).cast("int")
    out = rows.sparkSession.range(draws).withColumnRenamed("id", "draw")
    for depth, level in enumerate([*levels, key]):
        above = levels[:depth]
        values = rows.select(*above, level).distinct()
        by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        numbered = values.withColumns({"at_": F.row_number().over(by.orderBy(level)), "of_": F.count(F.lit(1)).over(by)})
        counts = numbered.select(*above, "of_").distinct()
        out = out.join(counts, above) if above else out.join(F.broadcast(counts))
        out = out.withColumn("at_", pick(level, F.col("of_"))).drop("of_").join(numbered.drop("of_"), [*above, "at_"]).drop("at_")
    return out.select("draw", key)


def corpus_signature(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, signature: a fingerprint of the set of rows that does not depend on their order; equal rows count each."""
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)))
    part = lambda k: F.sum(F.conv(F.substring(digest, k, 8), 16, 10).cast("decimal(38,0)"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(part(k).alias(f"s{k}") for k in (1, 9, 17, 25)))
    return sums.select(F.col("n").alias("rows"), F.md5(F.concat_ws("|", *(F.coalesce(F.col(f"s{k}").cast("string"), F.lit("0")) for k in (1, 9, 17, 25)))).alias("signature"))


def corpus_view(rows: DataFrame, wanted: list[tuple[str, str, int]], seed: int = 0) -> DataFrame:
    """The union of samples of (split, dataset, quota) views, each the first rows of its dataset and split in hash order."""
    w = rows.sparkSession.createDataFrame(wanted, "split string, dataset string, quota int")
    order = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col("episode").cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy("split", "dataset").orderBy(order, "episode"))
    return rows.join(F.broadcast(w), ["split", "dataset"]).withColumn("turn", turn).filter("turn <= quota").drop("turn", "quota")


#: fixed values: samples that a time base is told from, its bounds against the declared rate, and jitter as a share of a step.
LEAST_TIMES, RATE_SHARE, RATE_HZ, JITTER_SHARE = 3, 0.01, 0.1, 0.01


def timebase_faults(samples: DataFrame, keys: list[str], rate: Column) -> DataFrame:
    """keys, n, rate (by the median step), jitter (the farthest step from it) and fault of each recording's times (column at, seconds; seq gives their order).

    fault: too_few_times, not_increasing, rate_differs (from the declared one, by more than a hundredth and 0.1) or jitter (over a
    hundredth of the step); null where sound. Times that are no finite number are not increasing; null ones are left out.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    s = samples.filter("at IS NOT NULL").withColumn("declared_", rate).withColumn("step_", F.col("at") - F.lag("at").over(order))
    per = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and((F.col("step_") > 0) & (F.col("step_") < float("inf")) & ~F.isnan("step_")), F.lit(False)).alias("rising_"), F.percentile("step_", 0.5).alias("median_"), F.min("step_").alias("low_"),
        F.max("step_").alias("high_"), F.first("declared_").alias("declared_"),
    )
    inferred, jitter = 1 / F.col("median_"), F.greatest(F.col("high_") - F.col("median_"), F.col("median_") - F.col("low_"))
    near = F.abs(inferred - F.col("declared_")) <= F.greatest(RATE_SHARE * F.greatest(F.abs(inferred), F.abs("declared_")), F.lit(RATE_HZ))
    fault = (
        F.when(F.col("n") < LEAST_TIMES, "too_few_times").when(~F.col("rising_"), "not_increasing").when(~F.coalesce(near, F.lit(False)), "rate_differs")
        .when(jitter > F.greatest(F.lit(1e-9), JITTER_SHARE * F.col("median_")), "jitter")
    )
    sound = F.col("rising_")
    return per.select(*keys, "n", F.when(sound, inferred).alias("rate"), F.when(sound, jitter).alias("jitter"), fault.alias("fault"))


def unpopulated_columns(rows: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """name, n of the text columns that hold fewer than `least` finite numbers."""
    number = lambda c: F.trim(F.col(c).cast("string")).try_cast("double")
    counts = rows.agg(*(F.count_if(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf"))).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in columns))).alias("c")).select("c.name", "c.n").filter(F.col("n") < least)
