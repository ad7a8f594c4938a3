"""Queries on tables whose keys and groups are larger than those of the smallest tables."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscillar.operators import requests, spectra, windows
from oscillar.plans import queries as monitoring
from oscillar.sources import framed
from tests.test_entry import SF, canonical

here = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@here
@pytest.mark.parametrize("name", ["framed_samples", "framed_range", "framed_stream"])
def test_framed_ids_beyond_16_and_32_bits(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE user_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id + 70000 ELSE user_id + 5000000000 END AS user_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = monitoring.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert canonical(got) == canonical(con.execute(monitoring.ORACLE_SQL[name]).df())


def test_numbers_that_do_not_fit_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a.dat", 0, 1.0, [1, 2, 40_000])], "file string, frame long, time double, data array<int>")
    with pytest.raises(Exception, match="don't fit <i2"):
        framed.write_framed(rows, f"file://{tmp_path}/d", framed.Layout(1)).collect()
    assert framed.write_framed(rows, f"file://{tmp_path}/e", framed.Layout(1, number="<u2")).collect()[0].frames == 1


def test_levels_of_long_windows_take_one_pass(spark):
    """The mean of a window of 100,000 samples is not worked out for each of them; an empty window has the lowest level."""
    rows = spark.range(100_000).agg(F.collect_list((F.col("id") % 7).cast("double")).alias("x")).select(F.lit("a").alias("sensor"), F.lit(0).alias("win"), "x")
    rows = spark.createDataFrame([("b", 0, [1.0, 3.0]), ("c", 0, [])], "sensor string, win int, x array<double>").unionByName(rows)
    began = time.time()
    got = {r.sensor: r for r in spectra.levels(rows, "b").collect()}
    assert time.time() - began < 60
    assert got["a"].level_db == pytest.approx(20 * math.log10(np.std(np.arange(100_000) % 7))) and got["b"].level_rel_db == 0 and got["c"].level_db == pytest.approx(-240)


def test_figures_of_intervals_agree_with_every_pair(spark):
    rng = random.Random(8)
    points = [(rng.choice("ab"), round(rng.uniform(-5, 40), 1), rng.choice([None, float("nan"), 1.5, -2.0, 7.25, rng.random()])) for _ in range(400)] + [("a", None, 1.0), ("a", float("nan"), 1.0), (None, 1.0, 1.0), ("c", 3.0, None)]
    spans = [(rng.choice("abcd"), k, low, low + rng.choice([0.0, 0.1, 2.5, 11.0, float("inf")])) for k, low in enumerate(round(rng.uniform(-8, 45), 1) for _ in range(300))]
    got = windows.interval_figures(spark.createDataFrame(points, "sensor string, at double, value double").repartition(3), spark.createDataFrame(spans, "sensor string, id int, low double, high double"), "sensor", 4.0, head=3)
    got = {r.id: r for r in got.collect()}
    text = lambda v: None if v is None else "nan" if v != v else round(v, 9)
    for sensor, k, low, high in spans:
        met = sorted(((t, v is not None, v != v, v or 0.0, v) for s, t, v in points if s == sensor and t is not None and low <= t < high), key=lambda x: x[:4])
        if not met:
            assert k not in got
            continue
        values = [v for *_, v in met if v is not None]
        real = [v for v in values if v == v]
        want = [None] * 4 if not values else [sum(values), sum(v * v for v in values), min(real, default=float("nan")), max(real) if len(real) == len(values) else float("nan")]
        r = got[k]
        assert (r.n, r.held, [text(v) for v in r["head"]]) == (len(met), len(values), [text(v) for *_, v in met[:3]])
        assert [text(r[c]) for c in ("total", "squares", "low", "high")] == [text(v) for v in want]


def test_many_requests_of_one_crowded_window(spark):
    """20,000 requests of a window of 50,000 samples: their pairs are a thousand million."""
    samples = spark.range(50_000).select(F.lit("a").alias("sensor"), (F.col("id") / 1000).alias("ts"), (F.col("id") % 10).cast("double").alias("value"))
    asked = spark.range(20_000).select(F.col("id").alias("request"), F.lit("a").alias("sensor"), (F.col("id") % 7 / 1000).alias("start_s"), F.lit(45.0).alias("duration_s"), F.lit(None).cast("string").alias("fault"))
    began = time.time()
    got = requests.read_windows(asked, samples, preview=2).agg(F.min("n"), F.max("n"), F.count(F.lit(1)), F.max("high"), F.max(F.abs(F.col("mean") - 4.5))).first()
    assert tuple(got)[:4] == (45_000, 45_000, 20_000, 9.0) and got[4] < 1e-12 and time.time() - began < 60
