from datetime import datetime, timedelta

import numpy as np
import pytest

from oscillar.sources import framed
from oscillar.streaming import alerts


@pytest.mark.parametrize("counter", [False, True])
def test_framed_round_trip(spark, tmp_path, counter):
    values = np.arange(10 * 4 * 3, dtype=np.int16).reshape(-1, 3) - 50
    times = np.arange(1.0, 11.0)
    (tmp_path / "acc.dat").write_bytes(framed.framed_bytes(values, times, 4, counter) + b"torn")
    (tmp_path / "empty.dat").write_bytes(b"")
    got = framed.read_framed(spark, str(tmp_path), 4, 3, counter).orderBy("seq").toPandas()
    assert len(got) == 40 and np.allclose(got[["x", "y", "z"]].to_numpy(), values * framed.SENSITIVITY_G)
    assert np.allclose(got["ts"].to_numpy()[3::4], times) and (np.diff(got["ts"]) > 0).all()


def test_replay_and_history_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time_s,acceleration_g\n0.0,0.5\n0.1,\n")
    assert [r["acceleration_g"] for r in framed.read_replay_csv(spark, str(tmp_path / "s.csv")).collect()] == [0.5, None]
    (tmp_path / "h.jsonl").write_text('{"ts":"t","label":"normal","q":0,"sensors":{"a":{"rms":0.9,"peak":2.0}}}\n')
    row = framed.read_history(spark, str(tmp_path / "h.jsonl")).first()
    assert (row["sensor"], row["rms"], row["spec"]) == ("a", 0.9, None)


def test_frames_late_and_broken(spark, tmp_path, monkeypatch):
    times = np.array([1.0, 2.0, 4.0, np.nan, 6.0, 6.05, 8.0, 90.0, 10.0])
    ts, sound, fixed = framed.sample_times(times, 2, 1.0)
    assert sound.tolist() == [True, True, True, False, True, False, True, False, True] and fixed.tolist() == [1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert ts[4:6].tolist() == [3.5, 4.0]  # late: timed back from its own time
    values = np.arange(60, dtype=np.int16).reshape(-1, 3)
    (tmp_path / "a.dat").write_bytes(framed.framed_bytes(values, np.arange(1.0, 11.0), 2))
    monkeypatch.setattr(framed, "RANGE_BYTES", 3 * framed.frame_type(2, 3).itemsize)
    got = framed.read_framed(spark, str(tmp_path), 2).orderBy("seq").toPandas()
    assert got["seq"].tolist() == list(range(20)) and np.allclose(got["ts"], np.arange(1, 21) / 2) and np.allclose(got["z"], values[:, 2] * framed.SENSITIVITY_G)
    assert framed.read_framed(spark, str(tmp_path), 2, low=2.0, high=4.0).count() == 4


def test_lost_packets_and_inventory(spark, tmp_path):
    kind = framed.frame_type(2, 3, True)
    frames = np.zeros(5, kind)
    frames["counter"] = [0, 1, 4, 5, 9]
    (tmp_path / "a.dat").write_bytes(frames.tobytes())
    assert tuple(framed.lost_packets(spark, str(tmp_path), 2).first()) == ("a.dat", 5, 5)
    assert framed.inventory(spark, str(tmp_path)).first()["bytes"] == 5 * kind.itemsize


def test_text_signals_and_export(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Time [s];Acc X\n0,5;1,25\nx;-2\n;\n")
    got = framed.read_signals(spark, str(tmp_path / "s.csv"), {"t": "Time [s]", "x": "Acc X"}, ";", ",").collect()
    assert [tuple(r) for r in got] == [(0.5, 1.25), (None, -2.0)]
    windows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 1, [3.0])], "sensor string, win long, x array<double>")
    reports = spark.createDataFrame([("a", 1, "normal", 0.8)], "sensor string, win long, label string, confidence double")
    framed.export_long_csv(windows, reports, str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("sensor", "sample").collect()
    assert [(r["sensor"], r["label"], r["value"]) for r in rows] == [("a", "normal", "1.0"), ("a", "normal", "2.0"), ("b", "unknown", "3.0")]


def test_alert_rule():
    rule, state, reasons = alerts.AlertRule(cooldown=30), alerts.AlertState(), []
    for i, x in enumerate([1, 1, 0, 1, 1, 0, 0, 0, 1, 1, 1]):
        state, reason = rule.after(state, 10.0 * i, bool(x))
        reasons.append(reason)
    wait = alerts.WAITING
    assert reasons == [wait, wait, wait, alerts.EMITTED, alerts.MERGED, alerts.CLEARING, alerts.CLEARING, alerts.CLEARED, wait, wait, alerts.EMITTED]


def run_stream(spark, rows, kind, make, tmp_path, name):
    """The rows, a file for each time, through make() and out of a memory table."""
    source = str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_decimation_agrees_with_the_whole_signal(spark, tmp_path):
    from oscillar.streaming import decimation

    rng = np.random.default_rng(4)
    x = rng.normal(size=100)
    kernel = decimation.low_pass(31, 0.2)
    assert abs(kernel.sum() - 1) < 1e-12 and np.allclose(kernel, kernel[::-1])
    whole = np.convolve(x, kernel)[:100][::4]
    at = datetime(2024, 1, 1)
    rows = [("a", at + timedelta(seconds=i), float(v)) for i, v in enumerate(x)]
    parts = [rows[lo:hi] for lo, hi in ((0, 7), (7, 50), (50, 100))]
    got = sorted(run_stream(spark, parts, "sensor string, ts timestamp, value double", lambda s: decimation.decimated_stream(s, 4, 31), tmp_path, "decimated_out"), key=lambda r: r["ts"])
    assert np.allclose([r["value"] for r in got], whole) and [r["ts"] for r in got] == [r[1] for r in rows[::4]]


def test_new_samples_and_ready_windows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    row = lambda s, i: (s, at + timedelta(seconds=i), 1.0)
    kind = "sensor string, ts timestamp, value double"
    parts = [[row("a", i) for i in range(10)], [row("a", i) for i in range(6, 14)]]
    assert len(run_stream(spark, parts, kind, alerts.new_samples, tmp_path / "x", "new_out")) == 14
    parts = [[row(s, i) for i in range(12) for s in "ab"] + [row("a", i) for i in range(12, 30)], [row("a", 100)]]
    got = run_stream(spark, parts, kind, lambda s: alerts.ready_windows(s, 2, 10, 10, 2, "1 second"), tmp_path / "y", "ready_out")
    assert sorted((r["start"] - at).total_seconds() for r in got) == [0, 2]


def test_store_takes_a_key_once(spark, tmp_path):
    kind = "episode long, value double"
    for part in ([(1, 1.0), (2, 2.0), (1, 1.0)], [(2, 9.0), (3, 3.0)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    alerts.stored(stream, str(tmp_path / "store"), "episode", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["episode"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 2, 3]


def windows_of(spark, flags):
    at = datetime(2024, 1, 1)
    return [(k, at + timedelta(seconds=10 * i), bool(x)) for k, fs in flags.items() for i, x in enumerate(fs)]


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = windows_of(spark, {"a": [1, 1, 1, 0, 0, 0, 1], "b": [0, 1, 0, 1, 1, 0, 1]})
    kind = "key string, ts timestamp, abnormal boolean"
    batch = spark.createDataFrame(rows, kind)
    want = sorted(map(tuple, alerts.alerts_batch(batch).collect()))
    source = str(tmp_path / "in")
    for at in sorted({r[1] for r in rows}):
        spark.createDataFrame([r for r in rows if r[1] == at], kind).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    query = alerts.alerts_stream(stream).writeStream.format("memory").queryName("alerts_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("alerts_out").collect())) == want


def test_windows_of_a_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("a", at + timedelta(seconds=i), 2.0) for i in range(40)] + [("b", at + timedelta(seconds=5), 2.0)]
    kind = "sensor string, ts timestamp, value double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    query = alerts.aligned_windows(stream, 10, "5 seconds").writeStream.format("memory").queryName("win_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["start"]: (r["sensors"], r["n"], r["rms"]) for r in spark.table("win_out").collect()}
    assert got[at] == (2, 11, 2.0)


def chained_file(path, layout, times):
    frames = np.zeros(len(times), layout.kind)
    frames["data"] = np.random.default_rng(3).integers(-9999, 9999, frames["data"].shape)
    frames["time"] = times
    content = frames.tobytes()
    if layout.packet:
        content += bytes(-len(content) % layout.packet)
        content = b"".join(np.uint32(k).tobytes() + content[at : at + layout.packet] for k, at in enumerate(range(0, len(content), layout.packet)))
    path.write_bytes(content)
    return frames


@pytest.mark.parametrize(("packet", "number"), [(0, "<i2"), (13, "<i2"), (7, "<f4")])
def test_ranges_give_what_one_pass_gives(spark, tmp_path, monkeypatch, packet, number):
    """A long run of unsound frames is timed alike, whichever range it lies in; frames run on across packets."""
    times = np.arange(1.0, 81.0)
    times[20:60] = np.nan
    times[70] = 500.0
    layout = framed.Layout(2, 3, number=number, packet=packet)
    frames = chained_file(tmp_path / "a.dat", layout, times)
    monkeypatch.setattr(framed, "RANGE_BYTES", 5 * layout.kind.itemsize)
    got = framed.read_framed(spark, str(tmp_path), 2, number=number, packet=packet).orderBy("seq").toPandas()
    ts, sound, _ = framed.sample_times(times, 2, 1.0)
    assert np.array_equal(got["ts"], ts) and np.allclose(got["y"], (frames["data"][:, :, 1] * sound[:, None]).ravel() * framed.SENSITIVITY_G)
    some = framed.read_framed(spark, str(tmp_path), 2, number=number, packet=packet, low=30.25, high=41.0).toPandas()
    assert sorted(some["seq"]) == np.flatnonzero((ts >= 30.25) & (ts < 41.0)).tolist()


def test_bounds_select_ranges_before_samples_are_read(spark, tmp_path, monkeypatch):
    layout = framed.Layout(2)
    chained_file(tmp_path / "a.dat", layout, np.arange(1.0, 101.0))
    monkeypatch.setattr(framed, "RANGE_BYTES", 10 * layout.kind.itemsize)
    ranges = framed.timed_ranges(framed._ranges(spark, str(tmp_path), layout, "*.dat"), layout).orderBy("first").collect()
    assert [(r.first, r.end, r.before, r.closes) for r in ranges] == [(k, k + 10, float(k) or None, k + 10.0) for k in range(0, 100, 10)]


def test_stream_of_frames_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    """Each frame comes once: torn frames wait for the rest, ranges carry the time of the frame before, new files join."""
    layout = framed.Layout(2, counter=True)
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    times = np.arange(1.0, 41.0)
    times[5:9] = np.nan
    whole = chained_file(tmp_path / "whole", layout, times).tobytes()
    monkeypatch.setattr(framed, "RANGE_BYTES", 3 * layout.kind.itemsize)

    def run():
        stream = framed.stream_framed(spark, str(source), 2, counter=True)
        stream.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()

    size = layout.kind.itemsize
    (source / "a.dat").write_bytes(whole[: 7 * size + 5])
    run()
    assert spark.read.parquet(out).count() == 14
    (source / "a.dat").write_bytes(whole[: 21 * size + 1])
    (source / "b.dat").write_bytes(whole[:size])
    (source / ".hidden.dat").write_bytes(whole)
    run()
    run()
    (source / "a.dat").write_bytes(whole)
    run()
    rows = lambda df: sorted(tuple(r) for r in df.select("file", "seq", "ts", "x", "y", "z").collect())
    (source / ".hidden.dat").unlink()
    assert rows(spark.read.parquet(out)) == rows(framed.read_framed(spark, str(source), 2, counter=True)) and spark.read.parquet(out).count() == 82


def test_converted_files_are_made_once(spark, tmp_path):
    chained_file(tmp_path / "a.dat", framed.Layout(2), np.arange(1.0, 6.0))
    out = f"file://{tmp_path}/parquet"
    assert framed.converted(spark, str(tmp_path), out, samples=2).count() == 10
    (tmp_path / "a.dat").write_bytes(b"")
    assert framed.converted(spark, str(tmp_path), out, samples=2).count() == 10


def test_write_framed_round_trip(spark, tmp_path):
    layout = framed.Layout(2, 3, counter=True, packet=11)
    rows = [(f"f{k % 3}.dat", k // 3, float(k // 3 + 1), list(range(k, k + 6))) for k in range(30)]
    made = framed.write_framed(spark.createDataFrame(rows, "file string, frame long, time double, data array<int>"), f"file://{tmp_path}/d", layout).collect()
    assert sorted(map(tuple, made)) == [(f"f{k}.dat", 10) for k in range(3)]
    got = framed.read_framed(spark, f"{tmp_path}/d", 2, counter=True, packet=11, sensitivity=1.0).collect()
    assert sorted((r.file, r.seq, r.x) for r in got) == sorted((f, 2 * n + j, float(d[3 * j])) for f, n, _, d in rows for j in range(2))
    with pytest.raises(ValueError, match="packets"):
        framed.write_framed(spark.createDataFrame(rows, "file string, frame long, time double, data array<int>"), str(tmp_path), framed.Layout(2, packet=64))
