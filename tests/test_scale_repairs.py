"""Operators that cut a history into cells agree with plain versions, whatever lies in one cell."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oscillar.operators import corpus, decisions, evaluation, selection, windows


def fitted(points):
    """The isotonic regression by its definition: the least maximum over later of the greatest mean over earlier."""
    xs = sorted({x for x, _ in points})
    at = {x: [y for v, y in points if v == x] for x in xs}
    mean = lambda i, j: sum(sum(at[x]) for x in xs[i : j + 1]) / sum(len(at[x]) for x in xs[i : j + 1])
    return xs, [max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]


@pytest.mark.parametrize("shape", ["noise", "falling", "single", "outlier"])
def test_isotonic_curve_and_calibration(spark, shape):
    rng = random.Random(3)
    points = [(round(rng.random(), 2), float(rng.random() < 0.5)) for _ in range(120)]
    points = {"noise": points, "falling": [(k / 10, 1.0 - k / 10) for k in range(10)], "single": [(0.5, 1.0), (0.5, 0.0)], "outlier": [*points, (1e9, 1.0)]}[shape]
    pairs = spark.createDataFrame([*points, (None, 1.0)], "confidence double, correct double").repartition(5)
    curve = evaluation.isotonic_curve(pairs)
    xs, ys = fitted(points)
    held = {r.boundary: r.prediction for r in curve.collect()}
    assert all(held[x] == pytest.approx(ys[xs.index(x)]) for x in held) and {xs[0], xs[-1]} <= set(held)

    def plain(v):
        v = min(max(v, xs[0]), xs[-1])
        k = bisect.bisect_right(xs, v) - 1
        return ys[k] if k == len(xs) - 1 else ys[k] + (ys[k + 1] - ys[k]) * (v - xs[k]) / (xs[k + 1] - xs[k])

    asked = [-1.0, 0.0, 0.123, 0.5, 0.777, 1.0, 2.0, 2e9] + xs[:5]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(asked)] + [(99, None)], "id int, confidence double")
    got = {r.id: r.calibrated for r in evaluation.calibrated(rows, curve).collect()}
    assert got[99] is None and len(got) == len(asked) + 1
    assert all(got[k] == pytest.approx(plain(v), abs=1e-9) for k, v in enumerate(asked))


def test_forward_pairs_beyond_a_cell(spark):
    rng, day = random.Random(4), datetime(2024, 1, 1)
    at = lambda s: day + timedelta(seconds=s)
    left = [("ab"[k % 2], at(rng.randrange(40 * 3600)), k) for k in range(200)]
    right = [("ab"[k % 2], at(rng.randrange(30 * 3600)), k) for k in range(12)]
    got = windows.asof_forward(spark.createDataFrame(left, "key string, ts timestamp, id int"), spark.createDataFrame(right, "key string, ts timestamp, tag int"), ["key"], "ts", "ts", ["tag"], cell_seconds=3600)
    want = {k: min(((t, g) for b, t, g in right if b == key and t >= ts), default=(None, None)) for key, ts, k in left}
    assert {r.id: (r.matched_ts, r.matched_tag) for r in got.collect()} == want


def test_latest_samples_by_time_and_by_number(spark):
    day = datetime(2024, 1, 1)
    rows = [("dense", day + timedelta(seconds=k / 10), k, float(k)) for k in range(200)] + [("sparse", day + timedelta(seconds=10 * k), k, float(k)) for k in range(30)] + [("one", day, 0, 1.0), ("one", None, 1, 5.0)]
    got = {r.sensor: r for r in selection.latest_samples(spark.createDataFrame(rows, "sensor string, ts timestamp, event_id long, value double"), 5.0, 10.0).collect()}
    assert (got["dense"].mode, got["dense"].n, got["dense"].mean) == ("timestamps", 50, 174.5)
    assert (got["sparse"].mode, got["sparse"].n) == ("sample_count", 30) and got["sparse"]["first"] == pytest.approx(got["sparse"]["last"] - 2.9)
    assert got["one"].n == 1


def test_an_outlier_leaves_the_cells_even(spark):
    """A score of a million doesn't bring all others into one cell, and the area stays exact."""
    rng = random.Random(5)
    rows = [(rng.random() + 0.3 * (k % 2), k % 2) for k in range(400)] + [(1e6, 1), (-1e6, 0)]
    got = corpus.auroc(spark.createDataFrame(rows, "confidence double, correct int")).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got.auroc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    per = spark.createDataFrame(rows, "s double, y int")
    cuts = per.agg(F.percentile_approx("s", [k / 64 for k in range(1, 64)]).alias("c"))
    assert max(r["count"] for r in per.join(cuts).groupBy(F.size(F.filter("c", lambda c: c <= F.col("s")))).count().collect()) < 40


def test_repeated_draws_fill_every_quota(spark):
    rows = [(k, "big" if k < 50 else None if k < 53 else "one") for k in range(54)]
    got = decisions.repeated_draw(spark.createDataFrame(rows, "id int, grp string"), "grp", "id", 7).collect()
    total = {g: sum(r.copies for r in got if r.grp == g) for g in ("big", None, "one")}
    assert total == {"big": 7, None: 7, "one": 7} and all(r.copies == 1 for r in got if r.grp == "big")


def test_reference_levels_look_back_a_few_windows(spark):
    metrics = spark.createDataFrame([(w, s, 2.0 + w) for w in range(12) for s in "ab"], "win int, sensor string, rms double")
    ratios = {0: 2.0, 1: None, 2: 0.0, 5: float("nan"), 9: 4.0}
    compared = spark.createDataFrame([(w, s, ratios.get(w) if s == "a" else None) for w in range(12) for s in "ab"], "win int, sensor string, rms_ratio double")
    got = {r.win: (r.ref_rms, r.from_win) for r in windows.reference_levels(metrics, compared.withColumn("rms_ratio", F.nanvl("rms_ratio", F.lit(None).cast("double"))), 2).collect()}
    assert got == {w: (1.0, 0) if w <= 2 else (2.75, 9) if w >= 9 else (None, None) for w in range(12)}
