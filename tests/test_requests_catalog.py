import json

import pytest
from pyspark.sql import functions as F

from oscillar.operators import requests, spectra
from oscillar.sources import catalog

SENSORS = "sensor_id string, role string, location string, axis string, rate string"


def test_registry_faults(spark):
    rows = [("a", "baseline", None, None, None), ("b", None, "roof", "1", "100"), ("b", "target", None, "x", None), (" ", None, None, None, None), ("c", "boss", None, None, None), ("d", None, None, "w", None), ("e", None, None, None, "nan"), ("f", None, None, "NORM", "0")]
    got = {(r.sensor_id, r.axis): (r.role, r.location, r.fault) for r in requests.registry_faults(spark.createDataFrame(rows, SENSORS)).collect()}
    assert got["a", "z"] == ("baseline", "a", None) and got["b", "y"][2] == got["b", "x"][2] == "duplicate_id" and got["b", "y"][1] == "roof"
    assert {got[k][2] for k in ((None, "z"), ("c", "z"), ("d", None), ("e", "z"), ("f", "norm"))} == {"no_id", "unknown_role", "unknown_axis", "bad_rate"}
    two = spark.createDataFrame([("a", "baseline", None, None, None), ("b", "baseline", None, None, None)], SENSORS)
    assert {r.fault for r in requests.registry_faults(two).collect()} == {"several_baselines"}
    assert requests.registry_faults(two.filter("sensor_id = 'z'")).count() == 0
    assert {r.fault for r in requests.registry_faults(two.withColumn("role", F.lit("target"))).collect()} == {"no_baseline"}


def test_windows_of_requests(spark):
    registry = requests.registry_faults(spark.createDataFrame([("a", "baseline", "hall", "x", None), ("b", None, None, None, None), ("b", None, None, None, None)], SENSORS))
    kind = "request int, sensor string, axis string, start string, duration string"
    asked = [(1, "a", None, " 1.0 ", "2"), (2, "a", "Magnitude", None, "3"), (3, "a", "q", "0", "1"), (4, "b", "x", "0", "1"), (5, "a", "x", "-1", "1"), (6, "a", "x", "x", "1"), (7, "a", "x", "0", "inf"), (8, "a", "x", "0", "0"), (9, "a", "x", "0", "61"), (10, "a", "x", "900", "60"), (11, "a", "x", "0", None), (12, "a", "x", "0", "60")]
    normal = requests.normal_requests(spark.createDataFrame(asked, kind), registry)
    told = {r.request: r for r in normal.collect()}
    assert told[1].axis == "x" and told[1].location == "hall" and told[2].axis == "norm" and told[2].start_s is None
    faults = {3: "unknown_axis", 4: "unknown_sensor", 5: "start_negative", 6: "start_not_finite", 7: "duration_not_finite", 8: "duration_not_positive", 9: "duration_over_cap", 11: "duration_not_finite"}
    assert {k: r.fault for k, r in told.items() if r.fault} == faults
    samples = spark.createDataFrame([("a", k / 2, float(k)) for k in range(200)] + [("b", 0.0, 1.0)], "sensor string, ts double, value double")
    got = {r.request: r for r in requests.read_windows(normal, samples, preview=2, most=50).collect()}
    assert len(got) == 12 and {got[k].status for k in faults} == {"bad_request"} and got[10].status == "no_samples"
    assert (got[1].n, got[1].mean, got[1].preview) == (4, 3.5, [2.0, 3.0]) and (got[2].n, got[2].high, got[2].low) == (7, 199.0, 193.0)
    assert got[12].n == 120 and got[12].thinned and not got[1].thinned and got[12].rms == pytest.approx((sum(k * k for k in range(120)) / 120) ** 0.5)


def test_components_of_odd_documents(spark):
    docs = [
        {"components": [{"x_ACC": {"c_type": 0, "enable": True, "odr": 10, "samples_per_ts": 5, "data_type": "int16_t", "dim": 3}}, {"odd": {}}]},
        {"devices": [{"components": [{"m": {"c_type": 3}}]}, {"name": "empty"}]}, {"devices": []}, "torn", None,
    ]
    rows = spark.createDataFrame([(k, d if d is None or isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)], "key int, json string")
    got = {(r.key, r.component): r for r in catalog.components(rows, ["key"]).collect()}
    assert set(got) == {(0, "x_ACC"), (0, "odd"), (1, "m")}
    assert got[0, "x_ACC"].frame_bytes == 38 and got[0, "x_ACC"].subtype == "acc" and got[0, "odd"].kind == "other" and got[0, "odd"].frame_bytes is None and got[1, "m"].kind == "actuator"
    assert catalog.listed(catalog.components(rows, ["key"]), "sensor", "ACC", True).count() == 1 and catalog.listed(catalog.components(rows, ["key"]), "actuator", only_active=True).count() == 0


def test_reports_and_filters_of_odd_windows(spark):
    rows = spark.createDataFrame([(1, [0.0] * 64), (2, None), (3, []), (4, [1.0] * 4), (5, [float(k % 4 == 0) for k in range(64)])], "id int, x array<double>")
    got = {r.id: r for r in spectra.spectrum_reports(rows, "id", "x", 64.0, resolution=4.0).collect()}
    assert set(got) == {1, 5} and got[1].consistency is None and got[1].effective_kind is None and not got[1].rival and abs(got[5].effective_hz - 16) < 1
    asked = rows.withColumns({"filter": F.when(F.col("id") == 1, F.lit("60Hz")), **{c: F.lit(None).cast("double") for c in ("low_hz", "high_hz", "notch_hz", "width_hz", "filter_order")}})
    out = {r.id: r for r in spectra.filtered_windows(asked, ["id"], 64.0).collect()}
    assert set(out) == {1, 4, 5} and out[1].fault and out[1].x is None and out[4].kind == "none" and out[4].x == [0.0] * 4


def test_time_bases_and_populated_columns(spark):
    from oscillar.operators import audits

    times = {"good": [k / 100 for k in range(20)], "few": [0.0, 0.1], "still": [0.0, 0.01, 0.01, 0.03], "fast": [k / 110 for k in range(20)], "shaken": [k / 100 + (k == 7) * 2e-4 for k in range(20)], "nan": [0.0, float("nan"), 0.02, 0.03], "one": [0.0]}
    rows = spark.createDataFrame([(name, k, t) for name, ts in times.items() for k, t in enumerate(ts)] + [("good", 99, None)], "name string, seq int, at double")
    got = {r.name: r for r in audits.timebase_faults(rows, ["name"], F.lit(100.0)).collect()}
    assert {k: r.fault for k, r in got.items()} == {"good": None, "few": "too_few_times", "still": "not_increasing", "fast": "rate_differs", "shaken": "jitter", "nan": "not_increasing", "one": "too_few_times"}
    assert got["good"].rate == pytest.approx(100) and got["still"].rate is None and got["good"].n == 20
    texts = spark.createDataFrame([("1", "x", None), (" 2 ", "nan", ""), ("3e1", "4", "5")], "a string, b string, c string")
    assert {(r.name, r.n) for r in audits.unpopulated_columns(texts, ["a", "b", "c"]).collect()} == {("b", 1), ("c", 1)}


def test_frames_of_several_layouts(spark):
    from oscillar.operators import selection

    a = spark.createDataFrame([(0.0, 1.0, 2.0), (-1.0, 1.0, 2.0), (1.0, None, 2.0)], "`T ` double, `Acc X` double, acc_y double")
    b = spark.createDataFrame([(4.0, 2.0, 3.0)], "ACCY double, time double, accx double")
    same = spark.createDataFrame([(1.0, 2.0)], "`a x` double, a_x double")
    got = selection.concatenated([same.select("`a x`", "a_x"), a, same, b, spark.range(1)])
    assert got.columns == ["at", "Acc X", "acc_y"] and sorted(map(tuple, got.collect())) == [(0.0, 1.0, 2.0), (2.0, 3.0, 4.0)]
    untimed = selection.concatenated([a, b.drop("time")])
    assert [r["at"] for r in untimed.collect()] == [None, None]
    assert selection.reordered(b, ["Acc-X", "Acc-Y"]).collect() == [(3.0, 4.0)]
    with pytest.raises(ValueError, match="the columns are"):
        selection.reordered(b, ["x"])
    with pytest.raises(ValueError, match="no frame"):
        selection.concatenated([same])
    with pytest.raises(ValueError, match="no axis"):
        selection.axis_of(["a"], "x")
    assert b.select(selection.axis_of(["ACCY", "accx"], "norm")).first()[0] == 5.0
