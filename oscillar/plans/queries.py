"""Registered queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.functions import signal
from oscillar.operators import corpus, decisions, spectra, transients, windows
from oscillar.plans import corpus_queries, label_queries, signal_queries, source_queries
from oscillar.streaming import alerts

DAY = 86_400
REFERENCE = "view"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, so that sums in another order compare equal."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _samples(spark, d):
    return windows.sample_windows(_t(spark, d, "events"))


def _features(spark, d):
    return windows.window_features(_samples(spark, d))


def window_features(spark, d):
    return _rounded(_features(spark, d))


def window_quality(spark, d):
    return _rounded(windows.window_quality(_samples(spark, d)))


RATE = 100.0


def _arrays(spark, d):
    return windows.window_arrays(_samples(spark, d))


def _metrics(spark, d):
    return spectra.window_metrics(_arrays(spark, d), ["sensor", "win"], RATE)


def spectral_summary(spark, d):
    """Spectral figures of every sensor window, its samples taken as evenly spaced."""
    s = spectra.spectral_summaries(_arrays(spark, d), ["sensor", "win"], RATE)
    top = F.array_join(F.transform("top_hz", lambda f: F.round(f, 3).cast("string")), ",")
    return _rounded(s.select("sensor", "win", "dominant_hz", "dominant_magnitude", "centroid_hz", "bandwidth_hz", "flatness", top.alias("top_hz"), F.col("shares")[0].alias("share")), 5)


def stft_summary(spark, d):
    return _rounded(spectra.stft_summaries(_arrays(spark, d), ["sensor", "win"], RATE, 32, 16), 5)


def viewer_spectrogram(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    frames = spectra.spectrograms(e, ["id"], 64.0, 16, 16)
    return _rounded(frames.select("id", "frame", F.posexplode("power_db").alias("bin", "power_db")).filter("bin > 0"), 4)


def sensor_metrics(spark, d):
    """The metrics row of every sensor window, its band shares one column each."""
    m = _metrics(spark, d)
    return _rounded(m.select("sensor", "win", "n", "rms", "peak", "ptp", "kurtosis", "crest", "ppv", "dominant_hz", *(F.col("bands")[b].alias("band_" + b) for b in ("0_5_hz", "5_20_hz", "20_50_hz")), "flags"), 5)


def _compared(spark, d):
    return windows.compare_to_reference(_metrics(spark, d), REFERENCE)


def reference_comparison(spark, d):
    return _rounded(_compared(spark, d), 5)


def reference_levels(spark, d):
    """The level of the reference sensor of every window; reports of sensors whose peak is as high as the reference's don't count."""
    m = _metrics(spark, d)
    both = windows.compare_to_reference(m, REFERENCE)
    told = both.withColumn("rms_ratio", F.when(F.col("peak_ratio") < 1.0, F.col("rms_ratio")))
    return windows.reference_levels(m, told, 3)


def quality_vectors(spark, d):
    """The quality vector of every sensor window: shares, order and rate as measured, gaps for lost packets, half the rate for the usable band."""
    q = windows.window_quality(_samples(spark, d))
    yes = F.lit(True)
    v = windows.quality_vector(F.col("valid"), F.col("missing"), F.col("clipped"), F.col("monotonic"), F.lit(0.0), F.lit(1), F.col("rate") / 2, F.col("gaps"), F.col("rate"), (~yes, ~yes), F.col("usable"), yes)
    return _rounded(q.select("sensor", "win", F.posexplode(v).alias("place", "value")), 12)


def _labels(spark, d):
    both = _compared(spark, d)
    label, sure = windows.sensor_label(both)
    return both.select("sensor", "win", label.alias("label"), sure.alias("confidence"))


def sensor_labels(spark, d):
    return _labels(spark, d)


def network_labels(spark, d):
    return windows.network_labels(_labels(spark, d)).drop("worst_sensor", "worst_label")


def axis_labels(spark, d):
    """Every third sample is one axis: labels per axis over windows of six days, and the worst of a sensor's axes."""
    axis = F.element_at(F.array(*map(F.lit, "xyz")), (F.col("event_id") % 3 + 1).cast("int"))
    samples = windows.sample_windows(_t(spark, d, "events"), 6 * DAY).withColumn("axis", axis)
    metrics = spectra.window_metrics(windows.window_arrays(samples, ("sensor", "win", "axis")), ["sensor", "win", "axis"], RATE)
    both = windows.compare_to_reference(metrics, REFERENCE, ("win", "axis"))
    return windows.combined_axes(both.select("sensor", "win", "axis", windows.sensor_label(both)[0].alias("label")))


def aligned_comparison(spark, d):
    """Welch densities of the last eight days before the common end of all sensors, in decibels against the reference."""
    last = windows.sample_windows(spectra.aligned_windows(_t(spark, d, "events").withColumn("sensor", F.col("event_type")), 8.0 * DAY), 1000 * DAY)
    arrays = windows.window_arrays(last.withColumn("win", F.lit(0).cast("long")))
    s = spectra.density_summaries(arrays, ["sensor"], RATE, resolution=RATE / 32)
    return _rounded(spectra.density_deltas(s, REFERENCE), 4)


def history_percentiles(spark, d):
    """Each window within the windows of its sensor that the ladder calls normal."""
    f = _features(spark, d).select("sensor", "win", F.round("rms", 4).alias("rms"))
    normal = _labels(spark, d).filter("label = 'normal_relative_to_baseline'").select("sensor", "win")
    return windows.history_scores(f, f.join(normal, ["sensor", "win"], "left_semi"))


def history_context(spark, d):
    f = _features(spark, d).select("sensor", "win", *(F.round(c, 4).alias(c) for c in ("rms", "peak", "crest")))
    return windows.history_context(f, _labels(spark, d))


def block_rms(spark, d):
    return _rounded(windows.block_rms(_samples(spark, d), 4))


def envelope(spark, d):
    return _rounded(windows.envelope(_samples(spark, d)))


def linear_detrend(spark, d):
    return _rounded(windows.detrended(_samples(spark, d)).select("sensor", "win", "residual_rms"), 4)


def power_spectrum(spark, d):
    return _rounded(spectra.power_spectra(_t(spark, d, "embeddings"), "vec_id", "embedding", 64.0).select("id", "bin", "power"))


def band_powers(spark, d):
    return _rounded(spectra.band_powers(_t(spark, d, "embeddings"), "vec_id", "embedding", 64.0), 5)


def spectral_peaks(spark, d):
    return _rounded(spectra.local_peaks(_t(spark, d, "embeddings"), "vec_id", "embedding", 64.0))


def _spectra(spark, d):
    return spectra.power_spectra(_t(spark, d, "embeddings"), "vec_id", "embedding", 64.0)


def spectrum_plot(spark, d):
    return _rounded(spectra.plot_buckets(_spectra(spark, d), 1.0, 33.0, 8))


def spectral_shape(spark, d):
    return _rounded(spectra.spectral_shape(_spectra(spark, d), 5.0, 20.0))


def nearest_bins(spark, d):
    asked = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.array(F.lit(7.4), F.lit(12.5), F.col("vec_id") % 30 + 0.25)).alias("hz")).distinct()
    return _rounded(spectra.nearest_bins(_spectra(spark, d), asked))


def sliding_frames(spark, d):
    f = spectra.frames(_t(spark, d, "embeddings"), "vec_id", "embedding", 16, 8)
    rms = F.sqrt(F.aggregate("x", F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size("x"))
    return _rounded(f.select("id", "frame", rms.alias("rms")))


def residual_codes(spark, d):
    e = _t(spark, d, "embeddings")
    book = e.filter("vec_id < 16").select(F.col("vec_id").alias("code"), F.col("embedding").alias("vector"))
    out = spectra.nearest_codes(e, book, "vec_id", "embedding", stages=1)
    return _rounded(out.select("id", F.col("codes")[0].alias("code"), "error"), 4)


def modal_assurance(spark, d):
    """Squared cosine between the mean vectors of every two labels; a mean vector per label, so the pairs are few."""
    e = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "v"))
    m = e.groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    a, b = m.select(F.col("label").alias("a"), "k", F.col("v").alias("va")), m.select(F.col("label").alias("b"), "k", F.col("v").alias("vb"))
    s = a.join(b, "k").filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("ab"), F.sum(F.col("va") * F.col("va")).alias("aa"), F.sum(F.col("vb") * F.col("vb")).alias("bb"))
    return _rounded(s.select("a", "b", (F.col("ab") * F.col("ab") / (F.col("aa") * F.col("bb"))).alias("mac")))


def ringdown_check(spark, d):
    return _rounded(transients.ringdowns(_t(spark, d, "embeddings"), "vec_id", "embedding", 64.0))


def output_only_modes(spark, d):
    """Six vectors in a row stand for the channels of a recording."""
    e = _t(spark, d, "embeddings").select(F.expr("vec_id DIV 6").alias("recording"), (F.col("vec_id") % 6).alias("channel"), "embedding")
    return _rounded(transients.output_only_modes(e, "recording", "channel", "embedding", 64.0, 32))


def unit_conversion(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_retailprice", F.element_at(F.array(*map(F.lit, ("g", "MG", "m/s²", "mm/s^2", "furlong"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("unit"))
    return _rounded(p.select("p_partkey", signal.canonical_unit(F.col("unit")).alias("unit"), signal.to_g(F.col("p_retailprice"), F.col("unit")).alias("g")))


def scalar_functions(spark, d):
    c = _t(spark, d, "customer")
    return _rounded(
        c.select(
            "c_custkey", signal.stable_seed(F.col("c_name")).alias("seed"), signal.hash_fraction(7, F.col("c_name")).alias("fraction"), signal.safe_id(F.concat("c_mktsegment", F.lit("/"), "c_name")).alias("safe"),
            signal.decibel(F.abs("c_acctbal")).alias("db"), signal.peak_velocity_mm_s(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 50).cast("double")).alias("ppv"),
        )
    )


def axis_norm(spark, d):
    li = _t(spark, d, "lineitem")
    n = signal.norm3(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    return _rounded(li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean_norm"), F.max(n).alias("max_norm")))


def healthy_profile(spark, d):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return _rounded(corpus.healthy_profile(_t(spark, d, "lineitem"), keys, "l_quantity", "l_suppkey"))


def profile_scores(spark, d):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    li = _t(spark, d, "lineitem").select("l_orderkey", *keys, "l_quantity", "l_suppkey")
    profile = corpus.healthy_profile(li, keys, "l_quantity", "l_suppkey", least=2000)
    return _rounded(corpus.profile_scores(li.select("l_orderkey", *keys, "l_quantity"), profile, keys, "l_quantity"), 5)


def _splits(spark, d):
    return corpus.assign_splits(_t(spark, d, "documents"), "source", "lang", "doc_id", seed=11)


def split_assignment(spark, d):
    return _splits(spark, d)


def split_counts(spark, d):
    return corpus.corpus_counts(_splits(spark, d))


def split_leaks(spark, d):
    return corpus.leaking_groups(_splits(spark, d)).agg(F.count(F.lit(1)).alias("leaks"))


def _pairs(spark, d):
    return _t(spark, d, "labels").select(F.col("toxic").alias("truth"), (1 - F.col("quality")).alias("predicted"), "doc_id")


def classification_metrics(spark, d):
    return _rounded(corpus.classification_metrics(_pairs(spark, d)))


def _confidence(spark, d):
    return _pairs(spark, d).select(((F.col("doc_id") * 37 % 101) / 100.0).alias("confidence"), (F.col("truth") == F.col("predicted")).cast("int").alias("correct"))


def calibration_error(spark, d):
    return _rounded(corpus.calibration_error(_confidence(spark, d)))


def auroc(spark, d):
    return _rounded(corpus.auroc(_confidence(spark, d)))


def routing_matrix(spark, d):
    p = _pairs(spark, d).select(F.concat(F.lit("T"), "truth").alias("truth"), F.concat(F.lit("T"), "predicted").alias("predicted"))
    return corpus.routing_matrix(p, ["T0", "T1", "T2"])


def gate_checks(spark, d):
    m = corpus.classification_metrics(_pairs(spark, d)).select(F.concat_ws("_", F.lit("f1"), "label").alias("name"), F.col("f1").alias("value"))
    return _rounded(corpus.gate_checks(m, [("f1_macro", "min", 0.4, True), ("f1_accuracy", "min", 0.999, False), ("f1_1", "max", 0.9, True), ("f1_missing", "min", 0.1, True)]))


def quota_draw(spark, d):
    return corpus.quota_draw(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 40, 3).select("c_custkey", "c_mktsegment", "turn")


def nearest_event(spark, d):
    """Every click with the purchase nearest in time."""
    e = _t(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    left = e.filter("event_type = 'click'").select(F.col("ts").alias("at"), F.col("event_id").alias("click_id"))
    right = e.filter("event_type = 'purchase'").select(F.col("ts").alias("p_ts"), F.col("event_id").alias("purchase_id"))
    return windows.asof_nearest(left, right, [], "at", "p_ts", ["purchase_id"]).select("click_id", F.col("matched_purchase_id").alias("purchase_id"))


def tag_pairs(spark, d):
    """Every signup of a user with the same user's next purchase."""
    e = _t(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    starts = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("start_id"))
    ends = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("end_ts"), F.col("event_id").alias("end_id"))
    out = windows.asof_forward(starts, ends, ["user_id"], "at", "end_ts", ["end_id"])
    return out.select("start_id", "user_id", F.col("matched_end_id").alias("end_id"))


def tagged_samples(spark, d):
    """Samples inside labelled intervals: an interval from each signup, an hour long."""
    e = _t(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value", F.lit(0).alias("key"))
    spans = e.filter("event_type = 'signup'").select("key", F.col("event_id").alias("id"), F.col("at").alias("low"), (F.col("at") + 3_600_000_000).alias("high"))
    return _rounded(windows.interval_figures(e.filter("event_type <> 'signup'"), spans, "key", 3.6e9).select(F.col("id").alias("tag_id"), "n", "total"))


def alert_policy(spark, d):
    w = _features(spark, d).select(F.col("sensor").alias("key"), F.timestamp_seconds(F.col("win") * DAY).alias("ts"), (F.col("crest") > 3).alias("abnormal"))
    return alerts.alerts_batch(w, cooldown=DAY * 1.0)


def monitor(spark, d):
    """Worst sensor of every window, with the network's label: the whole chain from samples to verdicts."""
    return windows.network_labels(_labels(spark, d))


def anomaly_decisions(spark, d):
    labels = _labels(spark, d)
    return decisions.anomaly_decisions(labels, windows.network_labels(labels))


def _told(spark, d):
    """What a model might tell: mostly the rules' labels, some unknown, some of other sensors' kind."""
    k = F.length("sensor") + F.col("win")
    said = F.when(k % 13 == 0, "who_knows").when(k % 7 == 0, "mild_deviation").otherwise(F.col("label"))
    return _labels(spark, d).select("sensor", "win", said.alias("label"))


def rederived_labels(spark, d):
    return decisions.rederived(_told(spark, d), _labels(spark, d))


def quality_conflicts(spark, d):
    both = _compared(spark, d)
    both = both.withColumn("label", windows.sensor_label(both)[0])
    told = _told(spark, d).select("sensor", "win", F.col("label").alias("said"))
    return both.join(told, ["sensor", "win"]).select("sensor", "win", decisions.quality_conflict(F.col("said"), F.col("flags"), F.col("reference_flags"), F.col("label")).alias("conflict"))


def result_envelopes(spark, d):
    labels = _labels(spark, d)
    return decisions.envelopes(labels.select("win", "sensor"), labels)


def machine_classes(spark, d):
    """Sensor windows as a machine's, against their sensor's mean level."""
    f = _features(spark, d).filter("n >= 32").select("sensor", "win", "rms", "kurtosis", "crest", "skew")
    s = spectra.spectral_summaries(_arrays(spark, d), ["sensor", "win"], 1000.0).select("sensor", "win", "dominant_hz", "flatness")
    mean = f.groupBy("sensor").agg(F.avg("rms").alias("usual"))
    f = f.join(mean, "sensor").withColumn("rms_ratio", F.col("rms") / F.col("usual")).join(s, ["sensor", "win"])
    label, severity = decisions.machine_class(f)
    return _rounded(f.select("sensor", "win", label.alias("label"), severity.alias("severity")), 4)


def amplitude_scales(spark, d):
    return _rounded(decisions.amplitude_scales(_samples(spark, d)), 4)


def repeated_draw(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 20 + F.col("c_custkey") % 20).alias("grp"))
    return decisions.repeated_draw(c, "grp", "c_custkey", 12, 6)


def bound_devices(spark, d):
    n = _t(spark, d, "nation")
    seen = n.filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("board"), F.when(F.col("n_nationkey") == 5, "other").otherwise(F.col("n_name")).alias("serial"))
    return decisions.bound_devices(seen, n.filter("n_nationkey <> 7").select(F.col("n_nationkey").alias("board"), F.col("n_name").alias("serial")))


def board_coherence(spark, d):
    e = _t(spark, d, "embeddings").select(F.expr("vec_id DIV 2").alias("pair"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").cast("array<double>").alias("x"))
    both = e.filter("side = 0").select("pair", "x").join(e.filter("side = 1").select("pair", F.col("x").alias("y")), "pair")
    return _rounded(spectra.board_coherence(both, ["pair"], 64.0, 16, ((4.0, 12.0), (12.0, 33.0))), 5)


def dominant_peaks(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return _rounded(spectra.dominant_peaks(e, ["id"], 64.0), 4)


QUERIES = {
    f.__name__: f
    for f in (
        anomaly_decisions, rederived_labels, quality_conflicts, result_envelopes, machine_classes, amplitude_scales, repeated_draw, bound_devices, board_coherence, dominant_peaks,
        spectral_summary, stft_summary, viewer_spectrogram, sensor_metrics, axis_labels, aligned_comparison, history_context, spectrum_plot, spectral_shape, nearest_bins, tag_pairs,
        reference_levels, quality_vectors, monitor, window_features, window_quality, reference_comparison, sensor_labels, network_labels, history_percentiles, block_rms, envelope, linear_detrend, power_spectrum, band_powers, spectral_peaks,
        sliding_frames, residual_codes, modal_assurance, ringdown_check, output_only_modes, unit_conversion, scalar_functions, axis_norm, healthy_profile, profile_scores, split_assignment, split_counts, split_leaks,
        classification_metrics, calibration_error, auroc, routing_matrix, gate_checks, quota_draw, nearest_event, tagged_samples, alert_policy,
    )
}

_S = "SELECT event_type AS sensor, (floor(epoch(ts) / 86400))::BIGINT AS win, event_id, ts, value FROM events"
_F = f"""
f0 AS (SELECT *, value - avg(value) OVER (PARTITION BY sensor, win) AS c FROM ({_S})),
f1 AS (SELECT *, ((c >= 0) <> (lag(c) OVER (PARTITION BY sensor, win ORDER BY ts, event_id) >= 0))::INT AS crossed FROM f0),
f2 AS (SELECT sensor, win, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration, sqrt(avg(c * c)) AS rms, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4, avg(abs(c)) AS ma, max(abs(c)) AS peak,
         max(c) - min(c) AS ptp, sum(c * c) AS energy, coalesce(sum(crossed), 0) AS crossings FROM f1 GROUP BY sensor, win),
feat AS (SELECT sensor, win, n, duration, mean, std, std * std AS var, rms, peak, ptp, energy, CASE WHEN rms * rms * rms > 0 THEN m3 / (rms * rms * rms) ELSE 0 END AS skew, CASE WHEN rms * rms * rms * rms > 0 THEN m4 / (rms * rms * rms * rms) ELSE 0 END AS kurtosis,
         CASE WHEN rms > 0 THEN peak / rms ELSE 0 END AS crest, CASE WHEN ma > 0 THEN peak / ma ELSE 0 END AS impulse, CASE WHEN ma > 0 THEN rms / ma ELSE 0 END AS shape,
         CASE WHEN n > 1 THEN crossings / (n - 1) ELSE 0 END AS zcr FROM f2)"""
def _chain(samples: str, by: str) -> str:
    """Metrics, comparison and labels of windows by the keys sensor, win and by (empty, or ', axis'), samples as SQL."""
    using = "win" + by
    on = " AND ".join(f"t.{c.strip()} = b.{c.strip()}" for c in using.split(","))
    pre = lambda t: ", ".join(f"{t}.{c.strip()}" for c in using.split(","))
    return f"""
w0 AS (SELECT *, row_number() OVER (PARTITION BY sensor, {using} ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY sensor, {using}) AS n, value - avg(value) OVER (PARTITION BY sensor, {using}) AS c FROM ({samples})),
w1 AS (SELECT *, c * (0.5 - 0.5 * cos(2 * pi() * i / greatest(n - 1, 1))) AS v FROM w0),
mag AS (SELECT sensor, {using}, n, k, k * 100.0::DOUBLE / n AS hz, CASE WHEN k = 0 THEN 0 ELSE sqrt(sum(v * cos(2 * pi() * k * i / n)) ** 2 + sum(v * sin(2 * pi() * k * i / n)) ** 2) END AS m
        FROM w1, unnest(range(0, n // 2 + 1)) AS q(k) WHERE n >= 32 GROUP BY sensor, {using}, n, k),
band AS (SELECT sensor, {using}, sum(m * m) + 1e-12 AS p, coalesce(sum(m * m) FILTER (hz < 5), 0) AS a0, coalesce(sum(m * m) FILTER (hz >= 5 AND hz < 20), 0) AS a1, coalesce(sum(m * m) FILTER (hz >= 20 AND hz < 50), 0) AS a2, arg_max(hz, m) AS dominant_hz FROM mag GROUP BY sensor, {using}),
td AS (SELECT sensor, {using}, count(*) AS n, sqrt(avg(c * c)) AS rms, max(abs(c)) AS peak, max(c) - min(c) AS ptp, avg(c ** 4) AS m4, stddev_pop(value) AS std FROM w0 GROUP BY sensor, {using}),
met AS (SELECT td.* EXCLUDE (m4, std), CASE WHEN rms > 0 THEN m4 / rms ** 4 ELSE 0 END AS kurtosis, CASE WHEN rms > 0 THEN peak / rms ELSE 0 END AS crest, dominant_hz,
          CASE WHEN dominant_hz > 0.2 THEN rms * 9.80665::DOUBLE / (2 * pi() * dominant_hz) * 1000 END AS ppv, a0 / p AS b0, a1 / p AS b1, a2 / p AS b2,
          concat_ws(',', CASE WHEN n < 32 THEN 'insufficient_samples' END, CASE WHEN std < 1e-10 THEN 'flatline' END) AS flags FROM td LEFT JOIN band USING (sensor, {using})),
cmp AS (SELECT t.sensor, {pre('t')}, t.n, t.kurtosis, t.crest, CASE WHEN abs(b.rms) > 1e-12 THEN t.rms / b.rms END AS rms_ratio, CASE WHEN abs(b.peak) > 1e-12 THEN t.peak / b.peak END AS peak_ratio,
          CASE WHEN abs(b.ptp) > 1e-12 THEN t.ptp / b.ptp END AS ptp_ratio, CASE WHEN abs(b.ppv) > 1e-12 THEN t.ppv / b.ppv END AS ppv_ratio, t.rms - b.rms AS rms_delta, t.peak - b.peak AS peak_delta,
          t.dominant_hz - b.dominant_hz AS dominant_hz_delta, t.kurtosis - b.kurtosis AS kurtosis_delta, t.crest - b.crest AS crest_delta,
          sqrt((coalesce(t.b0, 0) - coalesce(b.b0, 0)) ** 2 + (coalesce(t.b1, 0) - coalesce(b.b1, 0)) ** 2 + (coalesce(t.b2, 0) - coalesce(b.b2, 0)) ** 2) AS spectral_distance,
          t.flags, CASE WHEN b.sensor IS NULL THEN 'missing_data' ELSE b.flags END AS reference_flags FROM met t LEFT JOIN met b ON {on} AND b.sensor = '{REFERENCE}' WHERE t.sensor <> '{REFERENCE}'),
lab AS (SELECT sensor, {using}, CASE WHEN regexp_matches(flags || ',' || reference_flags, 'missing_data|insufficient_samples') THEN 'insufficient_data' WHEN flags || reference_flags <> '' THEN 'possible_sensor_issue'
          WHEN coalesce(kurtosis, 0) >= 8 OR coalesce(crest, 0) >= 7 OR coalesce(peak_ratio, 1) >= 5 THEN 'impulsive_or_shock_event'
          WHEN greatest(coalesce(rms_ratio, 1), coalesce(peak_ratio, 1), coalesce(ppv_ratio, 1)) >= 3 OR spectral_distance >= 0.65 THEN 'significant_local_deviation'
          WHEN greatest(coalesce(rms_ratio, 1), coalesce(peak_ratio, 1), coalesce(ppv_ratio, 1)) >= 1.5 OR spectral_distance >= 0.35 THEN 'mild_deviation' ELSE 'normal_relative_to_baseline' END AS label FROM cmp),
sev AS (SELECT *, CASE label WHEN 'normal_relative_to_baseline' THEN 0 WHEN 'insufficient_data' THEN 1 WHEN 'possible_sensor_issue' THEN 2 WHEN 'mild_deviation' THEN 3 WHEN 'significant_local_deviation' THEN 4 ELSE 5 END AS s FROM lab)"""


_CMP = _chain(_S, "") + """,
net0 AS (SELECT win, count(*) AS sensors, count(*) FILTER (s >= 3) AS affected, count(*) FILTER (s >= 4) AS significant, count(*) FILTER (s IN (1, 2)) AS poor, coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (s >= 3), '') AS hit,
           coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (s IN (1, 2)), '') AS bad FROM sev GROUP BY win),
net1 AS (SELECT *, CASE WHEN poor > 0 THEN 'sensor_network_quality_issue' WHEN affected = 0 THEN 'normal_relative_to_reference_sensor' WHEN significant >= 2 OR affected >= greatest(2, ceil(0.6 * sensors)) THEN 'multi_sensor_structure_wide_vibration_event'
          WHEN affected > 1 AND significant = 0 THEN 'mild_multi_sensor_deviation' WHEN significant > 0 THEN 'localized_vibration_deviation' ELSE 'mild_local_deviation' END AS label FROM net0),
net AS (SELECT win, sensors, affected, significant, label, (CASE label WHEN 'sensor_network_quality_issue' THEN 0.9 WHEN 'normal_relative_to_reference_sensor' THEN 0.84 WHEN 'multi_sensor_structure_wide_vibration_event' THEN 0.84
          WHEN 'mild_multi_sensor_deviation' THEN 0.76 WHEN 'localized_vibration_deviation' THEN 0.82 ELSE 0.72 END)::DOUBLE AS confidence, CASE WHEN poor > 0 THEN bad ELSE hit END AS affected_sensors FROM net1)"""
_RATIOS = ", ".join(f"round({c}, 5) + 0 AS {c}" for c in ("kurtosis", "crest", "rms_ratio", "peak_ratio", "ptp_ratio", "ppv_ratio", "rms_delta", "peak_delta", "dominant_hz_delta", "kurtosis_delta", "crest_delta", "spectral_distance"))
_AXES = "SELECT event_type AS sensor, (floor(epoch(ts) / 518400))::BIGINT AS win, event_id, ts, value, ['x', 'y', 'z'][event_id % 3 + 1] AS axis FROM events"
_PSD = """
e0 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
e1 AS (SELECT id, i, (x[i + 1] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM e0, unnest(range(0, 64)) AS r(i)),
wsum AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * i / 64)) ** 2) AS s FROM range(0, 64) AS r(i)),
psd AS (SELECT id, k::INT AS bin, k::DOUBLE AS frequency, (sum(v * cos(2 * pi() * k * i / 64)) ** 2 + sum(v * sin(2 * pi() * k * i / 64)) ** 2) / (64 * (SELECT s FROM wsum)) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS power
        FROM e1, range(0, 33) AS q(k) GROUP BY id, k)"""
_BAND = "CASE WHEN frequency < 5 THEN '0-5' WHEN frequency < 20 THEN '5-20' WHEN frequency < 50 THEN '20-50' WHEN frequency < 100 THEN '50-100' WHEN frequency < 200 THEN '100-200' ELSE '200+' END"
_PAIRS = "SELECT toxic AS truth, 1 - quality AS predicted, doc_id FROM labels"
_CM = f"""
p AS ({_PAIRS}), labs AS (SELECT truth AS label FROM p UNION SELECT predicted FROM p),
per0 AS (SELECT label::VARCHAR AS label, (SELECT count(*) FROM p WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM p WHERE truth = label) AS support, (SELECT count(*) FROM p WHERE predicted = label) AS called FROM labs),
per1 AS (SELECT *, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM per0),
per AS (SELECT label, support, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, tp FROM per1),
cm AS (SELECT label, support, precision, recall, f1 FROM per UNION ALL SELECT 'macro', sum(support), avg(precision), avg(recall), avg(f1) FROM per WHERE support > 0
  UNION ALL SELECT 'accuracy', sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support) FROM per)"""
_SPLIT = """
g AS (SELECT DISTINCT source AS dataset, lang AS stratum, doc_id::VARCHAR AS group_id FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, stratum ORDER BY sha256('11' || chr(0) || group_id), group_id) AS rank, count(*) OVER (PARTITION BY dataset, stratum) AS total FROM g),
q AS (SELECT *, greatest(total - 3, 0) AS rest FROM r),
fl AS (SELECT *, floor(rest * 0.8::DOUBLE) AS f0, floor(rest * 0.1::DOUBLE) AS f1 FROM q),
rem AS (SELECT *, rest * 0.8::DOUBLE - f0 AS p0, rest * 0.1::DOUBLE - f1 AS p1, rest - f0 - 2 * f1 AS lft FROM fl),
cnt AS (SELECT *, CASE WHEN total < 3 THEN 1 ELSE 1 + f0 + ((CASE WHEN p1 > p0 THEN 2 ELSE 0 END) < lft)::INT END AS train,
          CASE WHEN total < 3 THEN 0 ELSE 1 + f1 + ((CASE WHEN p0 >= p1 THEN 1 ELSE 0 END) < lft)::INT END AS val FROM rem),
sp AS (SELECT dataset, stratum, group_id, CASE WHEN rank <= train THEN 'train' WHEN rank <= train + val THEN 'val' ELSE 'test' END AS split FROM cnt)"""
_PROFILE = """SELECT l_returnflag, l_linestatus, l_linenumber, grouping_id(l_returnflag, l_linestatus, l_linenumber) AS level, count(l_quantity) AS n, avg(l_quantity) AS mean,
  greatest(coalesce(stddev_samp(l_quantity), 0), 0.001) AS std, count(DISTINCT l_suppkey) AS independent
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_linestatus, l_linenumber), (l_linenumber))"""
_CONF = f"SELECT (doc_id * 37 % 101) / 100.0::DOUBLE AS confidence, (truth = predicted)::INT AS correct FROM ({_PAIRS})"

ORACLE_SQL = {
    "window_features": f"WITH {_F} SELECT sensor, win, n, round(duration, 6) AS duration, round(mean, 6) AS mean, round(std, 6) AS std, round(var, 6) AS var, round(rms, 6) AS rms, round(peak, 6) AS peak, round(ptp, 6) AS ptp, round(energy, 6) AS energy, round(skew, 6) + 0 AS skew, round(kurtosis, 6) AS kurtosis, round(crest, 6) AS crest, round(impulse, 6) AS impulse, round(shape, 6) AS shape, round(zcr, 6) AS zcr FROM feat",
    "window_quality": f"""WITH s AS (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY sensor, win ORDER BY event_id) AS dt FROM ({_S})),
per AS (SELECT sensor, win, count(*) AS n, avg((isfinite(value))::INT) AS valid, avg((value IS NULL)::INT) AS missing, avg((abs(value) >= 500)::INT) AS clipped, coalesce(bool_and(dt > 0), true) AS monotonic, stddev_pop(value) AS std, max(value) - min(value) AS ptp, quantile_cont(dt, 0.5) FILTER (dt > 0) AS step FROM s GROUP BY sensor, win)
SELECT p.sensor, p.win, n, round(valid, 6) AS valid, round(missing, 6) AS missing, round(clipped, 6) AS clipped, monotonic, coalesce(g.gaps, 0)::BIGINT AS gaps, round(1 / step, 6) AS rate, valid >= 0.98 AND monotonic AND clipped < 0.01 AS usable,
  concat_ws(',', CASE WHEN n < 32 THEN 'insufficient_samples' END, CASE WHEN std < 1e-10 THEN 'flatline' END, CASE WHEN valid < 1 THEN 'non_finite_values' END) AS flags,
  concat_ws(',', CASE WHEN clipped >= 0.01 THEN 'clipping' END, CASE WHEN NOT monotonic THEN 'timestamps_not_increasing' END, CASE WHEN g.gaps > 0 THEN 'gaps' END, CASE WHEN ptp <= 1e-7 THEN 'flatline' END) AS notes
FROM per p LEFT JOIN (SELECT s.sensor, s.win, sum((dt > 1.5 * step)::INT) AS gaps FROM s JOIN per USING (sensor, win) GROUP BY ALL) g USING (sensor, win)""",
    "reference_comparison": f"WITH {_CMP} SELECT win, sensor, n, {_RATIOS}, flags, reference_flags FROM cmp",
    "sensor_labels": f"WITH {_CMP} SELECT sensor, win, label, [0.82, 0.96, 0.9, 0.74, 0.86, 0.88][s + 1]::DOUBLE AS confidence FROM sev",
    "network_labels": f"WITH {_CMP} SELECT * FROM net",
    "monitor": f"""WITH {_CMP}, top AS (SELECT win, sensor AS worst_sensor, label AS worst_label FROM sev QUALIFY row_number() OVER (PARTITION BY win ORDER BY s DESC, sensor DESC) = 1)
SELECT net.*, worst_sensor, worst_label FROM net JOIN top USING (win)""",
    "sensor_metrics": f"WITH {_CMP} SELECT sensor, win, n, round(rms, 5) AS rms, round(peak, 5) AS peak, round(ptp, 5) AS ptp, round(kurtosis, 5) AS kurtosis, round(crest, 5) AS crest, round(ppv, 5) AS ppv, round(dominant_hz, 5) AS dominant_hz, round(b0, 5) AS band_0_5_hz, round(b1, 5) AS band_5_20_hz, round(b2, 5) AS band_20_50_hz, flags FROM met",
    "axis_labels": f"""WITH {_chain(_AXES, ', axis')}, top AS (SELECT win, sensor, max(s) AS s FROM sev GROUP BY win, sensor)
SELECT win, sensor, any_value(label) AS label, string_agg(axis, ',' ORDER BY axis) AS axes FROM sev JOIN top USING (win, sensor, s) GROUP BY win, sensor""",
    "spectral_summary": f"""WITH {_CMP}, t AS (SELECT sensor, win, sum(m) + 1e-12 AS t, sum(hz * m) / (sum(m) + 1e-12) AS c, exp(avg(ln(m + 1e-12))) / avg(m + 1e-12) AS flatness, arg_max(hz, m) AS dominant_hz, max(m) AS dominant_magnitude FROM mag GROUP BY sensor, win),
r AS (SELECT *, row_number() OVER (PARTITION BY sensor, win ORDER BY m DESC, k) AS rank FROM mag), five AS (SELECT sensor, win, string_agg(round(hz, 3)::VARCHAR, ',' ORDER BY rank) AS top_hz FROM r WHERE rank <= 5 GROUP BY sensor, win)
SELECT t.sensor, t.win, round(dominant_hz, 5) AS dominant_hz, round(dominant_magnitude, 5) AS dominant_magnitude, round(c, 5) AS centroid_hz, round((SELECT sqrt(sum((hz - c) ** 2 * m) / t.t) FROM mag WHERE mag.sensor = t.sensor AND mag.win = t.win), 5) AS bandwidth_hz,
  round(flatness, 5) AS flatness, top_hz, round((SELECT sum(m * m) FILTER (hz < 50) / (sum(m * m) + 1e-12) FROM mag WHERE mag.sensor = t.sensor AND mag.win = t.win), 5) AS share FROM t JOIN five USING (sensor, win)""",
    "stft_summary": f"""WITH w AS (SELECT sensor, win, row_number() OVER (PARTITION BY sensor, win ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY sensor, win) AS n, value - avg(value) OVER (PARTITION BY sensor, win) AS c FROM ({_S})),
sz AS (SELECT *, 32 AS size FROM w WHERE n >= 32), fr AS (SELECT sensor, win, size, f, i - f * 16 AS j, c * (CASE WHEN size = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * (i - f * 16) / (size - 1)) END) AS v FROM sz, unnest(range(0, (n - size) // 16 + 1)) AS q(f) WHERE i >= f * 16 AND i < f * 16 + size),
sp AS (SELECT sensor, win, size, f, k, sum(v * cos(2 * pi() * k * j / size)) ** 2 + sum(v * sin(2 * pi() * k * j / size)) ** 2 AS p FROM fr, unnest(range(0, size // 2 + 1)) AS q(k) GROUP BY ALL),
tot AS (SELECT sensor, win, any_value(size) AS size, count(DISTINCT f)::INT AS frames, count(DISTINCT k)::INT AS bins, sum(p) + 1e-12 AS t, max(p) AS most FROM sp GROUP BY sensor, win),
pf AS (SELECT sensor, win, arg_max(k, e) AS k FROM (SELECT sensor, win, k, sum(p) AS e FROM sp GROUP BY ALL) GROUP BY sensor, win), pt AS (SELECT sensor, win, arg_max(f, e)::INT AS f FROM (SELECT sensor, win, f, sum(p) AS e FROM sp GROUP BY ALL) GROUP BY sensor, win)
SELECT sensor, win, frames, bins, round(pf.k * 100.0::DOUBLE / size, 5) AS peak_hz, pt.f AS peak_frame, round((SELECT -sum(p / t * ln(p / t + 1e-12)) FROM sp WHERE sp.sensor = tot.sensor AND sp.win = tot.win), 5) + 0 AS entropy, round(most / t, 5) AS concentration
FROM tot JOIN pf USING (sensor, win) JOIN pt USING (sensor, win)""",
    "viewer_spectrogram": """WITH x AS (SELECT vec_id AS id, (f)::INT AS frame, j, embedding[f * 16 + j + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * j / 15)) AS v FROM embeddings, unnest(range(0, 4)) AS a(f), range(0, 16) AS b(j))
SELECT id, frame, k::INT AS bin, round(10 * log10(greatest(sum(v * cos(2 * pi() * k * j / 16)) ** 2 + sum(v * sin(2 * pi() * k * j / 16)) ** 2, 2.2250738585072014e-308)), 4) AS power_db FROM x, range(1, 9) AS q(k) GROUP BY id, frame, k""",
    "history_percentiles": f"""WITH {_F}, {_CMP.strip()}, h AS (SELECT sensor, win, round(feat.rms, 4) AS v, label = 'normal_relative_to_baseline' AS ok FROM feat LEFT JOIN lab USING (sensor, win)), m AS (SELECT sensor, count(*) AS n, quantile_cont(v, 0.5) AS med FROM h WHERE ok GROUP BY sensor)
SELECT a.sensor, a.win, CASE WHEN n >= 5 THEN round(100 * (SELECT count(*) FROM h b WHERE b.ok AND b.sensor = a.sensor AND b.v <= a.v) / n, 2) END AS percentile, CASE WHEN n >= 5 AND med > 1e-9 THEN round(a.v / med, 2) END AS x_median FROM h a LEFT JOIN m USING (sensor)""",
    "history_context": f"""WITH {_F}, {_CMP.strip()}, h AS (SELECT sensor, win, metric, round(v, 4) AS v, coalesce(label = 'normal_relative_to_baseline', false) AS ok FROM (SELECT sensor, win, rms, peak, crest FROM feat) UNPIVOT (v FOR metric IN (rms, peak, crest)) LEFT JOIN lab USING (sensor, win)),
m AS (SELECT sensor, metric, count(*) AS n, quantile_cont(v, 0.5) AS med FROM h WHERE ok GROUP BY sensor, metric),
s AS (SELECT a.sensor, a.win, a.metric, coalesce(n, 0)::BIGINT AS n_history, CASE WHEN n >= 5 THEN round(100 * (SELECT count(*) FROM h b WHERE b.ok AND b.sensor = a.sensor AND b.metric = a.metric AND b.v <= a.v) / n, 2) END AS percentile, CASE WHEN n >= 5 AND med > 1e-9 THEN round(a.v / med, 2) END AS x_median FROM h a LEFT JOIN m USING (sensor, metric))
SELECT sensor, win, metric, percentile, x_median, n_history FROM s QUALIFY row_number() OVER (PARTITION BY sensor, win ORDER BY coalesce(greatest(percentile, 100 - percentile), -1) DESC, coalesce(abs(x_median - 1), -1) DESC, metric DESC) = 1""",
    "spectrum_plot": f"""WITH {_PSD}, b AS (SELECT *, floor(ln(frequency) / ln(33) * 8)::INT AS bucket FROM psd WHERE frequency >= 1 AND frequency < 33)
SELECT id, bucket, round(quantile_cont(power, 0.5) FILTER (power > 0), 6) AS floor, arg_max(frequency, power) AS peak_hz, round(max(power), 6) AS peak FROM b GROUP BY id, bucket""",
    "spectral_shape": f"""WITH {_PSD}, p AS (SELECT *, lag(power) OVER (PARTITION BY id ORDER BY bin) AS p0, power / sum(power) OVER (PARTITION BY id) AS q FROM psd)
SELECT id, round(-sum(q * ln(q)) FILTER (q > 0) / ln(count(*)), 6) AS entropy, round(sum((power + p0) / 2) FILTER (bin > 5 AND bin < 20), 6) AS band_energy, round(sum(power), 6) AS total_power FROM p GROUP BY id""",
    "nearest_bins": f"""WITH {_PSD}, a AS (SELECT DISTINCT vec_id AS id, hz FROM embeddings, unnest([7.4::DOUBLE, 12.5, vec_id % 30 + 0.25]) AS r(hz))
SELECT id, hz, bin, round(power, 6) AS power FROM a JOIN psd USING (id) QUALIFY row_number() OVER (PARTITION BY id, hz ORDER BY abs(frequency - hz), bin) = 1""",
    "aligned_comparison": """WITH lt AS (SELECT min(m) AS e FROM (SELECT max(ts) AS m FROM events GROUP BY event_type)),
s AS (SELECT event_type AS sensor, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, value FROM events, lt WHERE ts <= e AND epoch_us(ts) > epoch_us(e) - 691200000000),
z AS (SELECT *, CASE WHEN n // 2 >= 32 THEN 32 ELSE (2 ** floor(log2(n // 2)))::BIGINT END AS size FROM s),
fr AS (SELECT sensor, size, f, i - f * (size // 2) AS j, value - avg(value) OVER (PARTITION BY sensor, f) AS c FROM z, unnest(range(0, (n - size) // (size // 2) + 1)) AS q(f) WHERE i >= f * (size // 2) AND i < f * (size // 2) + size),
vw AS (SELECT *, c * (0.5 - 0.5 * cos(2 * pi() * j / size)) AS x FROM fr),
pw AS (SELECT sensor, size, f, k, (sum(x * cos(2 * pi() * k * j / size)) ** 2 + sum(x * sin(2 * pi() * k * j / size)) ** 2) / (100 * 0.375::DOUBLE * size) * CASE WHEN k IN (0, size // 2) THEN 1 ELSE 2 END AS q FROM vw, unnest(range(0, size // 2 + 1)) AS t(k) GROUP BY sensor, size, f, k),
w AS (SELECT sensor, k * 100.0::DOUBLE / size AS hz, 100.0::DOUBLE / size AS df, avg(q) AS p FROM pw GROUP BY sensor, size, k),
b AS (SELECT sensor, band, coalesce(sum(p * df) FILTER (hz > 0 AND hz >= lo AND hz < hi), 0) AS power FROM w, (VALUES ('0-5', 0, 5), ('5-20', 5, 20), ('20-50', 20, 50)) AS t(band, lo, hi) GROUP BY sensor, band),
d AS (SELECT sensor, arg_max(hz, p) AS hz FROM w WHERE hz > 0 GROUP BY sensor), r AS (SELECT sensor, stddev_pop(value) AS rms FROM s GROUP BY sensor)
SELECT b.sensor, b.band, round(b.power, 4) AS power, round(10 * log10(greatest(b.power, 2.2250738585072014e-308) / greatest(o.power, 2.2250738585072014e-308)), 4) AS delta_db, round(d.hz - od.hz, 4) + 0 AS dominant_shift_hz, round(20 * log10(r.rms / rr.rms), 4) + 0 AS rms_db
FROM b JOIN b o ON b.band = o.band AND o.sensor = 'view' JOIN d ON d.sensor = b.sensor JOIN d od ON od.sensor = 'view' JOIN r ON r.sensor = b.sensor JOIN r rr ON rr.sensor = 'view' WHERE b.sensor <> 'view'""",
    "tag_pairs": """SELECT s.event_id AS start_id, s.user_id, arg_min(e.event_id, (e.ts, e.event_id)) AS end_id FROM events s LEFT JOIN events e ON e.event_type = 'purchase' AND e.user_id = s.user_id AND e.ts >= s.ts WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id""",
    "block_rms": f"""WITH b AS (SELECT sensor, win, sqrt(avg(value * value)) AS rms FROM (SELECT *, (row_number() OVER (PARTITION BY sensor, win ORDER BY ts, event_id) - 1) // 4 AS block FROM ({_S})) GROUP BY sensor, win, block),
m AS (SELECT sensor, win, count(*) AS blocks, quantile_cont(rms, 0.5) AS med, max(rms) AS largest FROM b GROUP BY sensor, win),
s AS (SELECT sensor, win, 1.4826::DOUBLE * quantile_cont(abs(rms - med), 0.5) AS scale FROM b JOIN m USING (sensor, win) GROUP BY sensor, win)
SELECT sensor, win, blocks, round(med, 6) AS median, round(largest, 6) AS largest, round(scale, 6) AS scale, round((largest - med) / greatest(scale, 0.05::DOUBLE * med, 1e-300), 6) AS z FROM m JOIN s USING (sensor, win)""",
    "envelope": f"""SELECT sensor, win, bucket::INT AS bucket, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean
FROM (SELECT *, ceil(row_number() OVER (PARTITION BY sensor, win ORDER BY ts, event_id) * 10 / count(*) OVER (PARTITION BY sensor, win)) - 1 AS bucket FROM ({_S})) GROUP BY sensor, win, bucket""",
    "linear_detrend": f"""WITH s AS (SELECT *, epoch_us(ts) / 1e6 - win * 86400 AS t FROM ({_S})), f AS (SELECT sensor, win, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM s GROUP BY sensor, win)
SELECT sensor, win, round(sqrt(avg((value - a * t - b) ** 2)), 4) AS residual_rms FROM s JOIN f USING (sensor, win) GROUP BY sensor, win""",
    "power_spectrum": f"WITH {_PSD} SELECT id, bin, round(power, 6) AS power FROM psd",
    "band_powers": f"""WITH {_PSD}, b AS (SELECT id, {_BAND} AS band, sum(power) AS power FROM psd WHERE bin > 0 GROUP BY ALL)
SELECT id, band, round(power, 5) AS power, round(sqrt(power), 5) AS rms, round(power / sum(power) OVER (PARTITION BY id), 5) AS fraction FROM b""",
    "spectral_peaks": f"""WITH {_PSD}, p AS (SELECT *, lag(power) OVER (PARTITION BY id ORDER BY bin) AS b, lead(power) OVER (PARTITION BY id ORDER BY bin) AS a FROM psd)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY power DESC, bin))::INT AS rank, bin, round(frequency, 6) AS frequency, round(power, 6) AS power,
  round(frequency + CASE WHEN abs(ln(b) - 2 * ln(power) + ln(a)) > 1e-15 THEN greatest(-0.5, least(0.5, 0.5 * (ln(b) - ln(a)) / (ln(b) - 2 * ln(power) + ln(a)))) ELSE 0 END, 6) AS refined_hz FROM p WHERE power > b AND power >= a QUALIFY rank <= 3""",
    "sliding_frames": "SELECT vec_id AS id, (s // 8)::INT AS frame, round(sqrt(list_sum(list_transform(embedding[s + 1:s + 16], lambda x: x::DOUBLE * x::DOUBLE)) / 16), 6) AS rms FROM embeddings, unnest(range(0, 49, 8)) AS r(s)",
    "residual_codes": """WITH d AS (SELECT e.vec_id AS id, b.vec_id AS code, list_sum(list_transform(list_zip(e.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS error FROM embeddings e, embeddings b WHERE b.vec_id < 16)
SELECT id, code, round(error, 4) AS error FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY error, code) = 1""",
    "modal_assurance": """WITH m AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS r(k) GROUP BY label, k)
SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) ** 2 / (sum(a.v * a.v) * sum(b.v * b.v)), 6) AS mac FROM m a JOIN m b USING (k) WHERE a.label <= b.label GROUP BY a.label, b.label""",
    "unit_conversion": """SELECT p_partkey, ['g', 'mg', 'm/s^2', 'mm/s^2', NULL][p_partkey % 5 + 1] AS unit, round(p_retailprice * [1.0, 0.001, 1 / 9.80665::DOUBLE, 0.001 / 9.80665::DOUBLE, NULL][p_partkey % 5 + 1]::DOUBLE, 6) AS g FROM part""",
    "scalar_functions": """WITH c AS (SELECT *, sha256(c_name) AS h, sha256('7' || chr(0) || c_name) AS h7 FROM customer)
SELECT c_custkey, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT AS seed, round(('0x' || h7[1:13])::BIGINT / 16.0::DOUBLE ** 13, 6) AS fraction, regexp_replace(c_mktsegment || '/' || c_name, '[^A-Za-z0-9._-]', '_', 'g')[1:160] AS safe,
  round(10 * log10(greatest(abs(c_acctbal), 2.2250738585072014e-308)), 6) AS db, CASE WHEN c_custkey % 50 > 0.2 THEN round(c_acctbal / 1000 * 9.80665::DOUBLE / (2 * pi() * (c_custkey % 50)) * 1000, 6) END AS ppv FROM c""",
    "axis_norm": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(m), 6) AS mean_norm, round(max(m), 6) AS max_norm
FROM (SELECT *, sqrt(l_quantity * l_quantity + (l_discount * 100) * (l_discount * 100) + (l_tax * 100) * (l_tax * 100)) AS m FROM lineitem) GROUP BY l_returnflag, l_linestatus""",
    "healthy_profile": f"SELECT l_returnflag, l_linestatus, l_linenumber, level, n, round(mean, 6) AS mean, round(std, 6) AS std, independent, n >= 8 AND independent >= 2 AS valid FROM ({_PROFILE})",
    "profile_scores": f"""WITH p AS (SELECT * FROM ({_PROFILE}) WHERE n >= 2000 AND independent >= 2),
j AS (SELECT l.*, CASE WHEN a.n IS NOT NULL THEN 0 WHEN b.n IS NOT NULL THEN 1 WHEN c.n IS NOT NULL THEN 2 END AS profile_level, coalesce(a.mean, b.mean, c.mean) AS m, coalesce(a.std, b.std, c.std) AS s FROM lineitem l
  LEFT JOIN p a ON a.level = 0 AND a.l_returnflag = l.l_returnflag AND a.l_linestatus = l.l_linestatus AND a.l_linenumber = l.l_linenumber
  LEFT JOIN p b ON b.level = 4 AND b.l_linestatus = l.l_linestatus AND b.l_linenumber = l.l_linenumber LEFT JOIN p c ON c.level = 6 AND c.l_linenumber = l.l_linenumber)
SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, round(l_quantity, 5) AS l_quantity, CASE WHEN m IS NOT NULL THEN round(greatest(-12, least(12, (l_quantity - m) / s)), 5) END AS z, profile_level FROM j""",
    "split_assignment": f"WITH {_SPLIT} SELECT * FROM sp",
    "split_counts": f"WITH {_SPLIT} SELECT dataset, split, count(*) AS groups, count(DISTINCT stratum) AS strata FROM sp GROUP BY CUBE (dataset, split)",
    "split_leaks": f"WITH {_SPLIT} SELECT count(*) AS leaks FROM (SELECT group_id FROM sp GROUP BY group_id HAVING count(DISTINCT split) > 1)",
    "classification_metrics": f"WITH {_CM} SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cm",
    "calibration_error": f"""WITH b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM ({_CONF}) GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b""",
    "auroc": f"""WITH c AS ({_CONF}), r AS (SELECT correct, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2 AS k FROM c)
SELECT sum(correct)::BIGINT AS n_pos, sum(1 - correct)::BIGINT AS n_neg, round((sum(k) FILTER (correct = 1) - sum(correct) * (sum(correct) + 1) / 2) / (sum(correct) * sum(1 - correct)), 6) AS auroc FROM r""",
    "routing_matrix": f"""SELECT t AS truth, q AS predicted, (SELECT count(*) FROM ({_PAIRS}) WHERE 'T' || truth = t AND 'T' || predicted = q) AS n FROM (VALUES ('T0'), ('T1'), ('T2')) a(t), (VALUES ('T0'), ('T1'), ('T2')) b(q)""",
    "gate_checks": f"""WITH {_CM}, g AS (SELECT * FROM (VALUES ('f1_macro', 'min', 0.4::DOUBLE, true), ('f1_accuracy', 'min', 0.999, false), ('f1_1', 'max', 0.9, true), ('f1_missing', 'min', 0.1, true)) v(name, kind, threshold, required)),
j AS (SELECT g.*, f1 AS value, coalesce(CASE WHEN kind = 'min' THEN f1 >= threshold ELSE f1 <= threshold END, false) AS ok FROM g LEFT JOIN cm ON name = 'f1_' || label)
SELECT name, round(threshold, 6) AS threshold, round(value, 6) AS value, ok AS observed_passed, ok OR NOT required AS passed FROM j""",
    "quota_draw": """WITH t AS (SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('3' || chr(0) || c_custkey::VARCHAR), c_custkey))::INT AS turn FROM customer)
SELECT * FROM t ORDER BY turn, sha256('3' || chr(0) || c_mktsegment), sha256('3' || chr(0) || c_custkey::VARCHAR) LIMIT 40""",
    "tagged_samples": """SELECT s.event_id AS tag_id, count(*) AS n, round(sum(e.value), 6) AS total FROM events s JOIN events e ON e.ts >= s.ts AND e.ts < s.ts + INTERVAL 1 HOUR AND e.event_type <> 'signup' WHERE s.event_type = 'signup' GROUP BY s.event_id""",
    "nearest_event": """WITH c AS (SELECT event_id AS click_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS purchase_id, ts FROM events WHERE event_type = 'purchase')
SELECT click_id, purchase_id FROM c LEFT JOIN p ON true QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY abs(epoch_us(c.ts) - epoch_us(p.ts)), p.ts) = 1""",
}
ORACLE_SQL["alert_policy"] = f"""WITH RECURSIVE {_F}, w AS (SELECT sensor AS key, win * 86400.0::DOUBLE AS sec, (crest > 3)::BIGINT AS flag, row_number() OVER (PARTITION BY sensor ORDER BY win) AS i FROM feat),
s AS (SELECT DISTINCT sensor AS key, 0::BIGINT AS i, 0.0::DOUBLE AS sec, 0::BIGINT AS votes, -1::BIGINT AS calm, -1e300::DOUBLE AS last, '' AS reason FROM feat
  UNION ALL SELECT w.key, w.i, w.sec, CASE WHEN calm >= 0 AND flag = 0 AND calm + 1 >= 3 THEN 0 ELSE (votes * 2 + flag) % 32 END,
    CASE WHEN calm >= 0 THEN CASE WHEN flag = 1 THEN 0 WHEN calm + 1 >= 3 THEN -1 ELSE calm + 1 END WHEN bit_count((votes * 2 + flag) % 32) >= 3 AND w.sec - last >= 86400 THEN 0 ELSE -1 END,
    CASE WHEN calm < 0 AND bit_count((votes * 2 + flag) % 32) >= 3 AND w.sec - last >= 86400 THEN w.sec ELSE last END,
    CASE WHEN calm >= 0 THEN CASE WHEN flag = 1 THEN 'active_event_merged' WHEN calm + 1 >= 3 THEN 'cleared_after_generated_normal_outputs' ELSE 'waiting_for_clear_hysteresis' END
      WHEN bit_count((votes * 2 + flag) % 32) < 3 THEN 'waiting_for_generated_output_persistence' WHEN w.sec - last < 86400 THEN 'popup_cooldown' ELSE 'persistent_non_normal_event' END
  FROM s JOIN w ON w.key = s.key AND w.i = s.i + 1)
SELECT key, make_timestamp((sec * 1e6)::BIGINT) AS ts, reason = 'persistent_non_normal_event' AS emitted, calm >= 0 AS active, reason FROM s WHERE i > 0"""
ORACLE_SQL["board_relations"] = f"""WITH {_PSD}, b AS (SELECT id // 6 AS episode, id % 6 AS board, {_BAND} AS band, sum(power) AS power FROM psd WHERE bin > 0 GROUP BY ALL)
SELECT t.episode, t.board, t.band, round(10 * log10(greatest(t.power, 1e-18) / greatest(r.power, 1e-18)), 4) + 0 AS transmissibility_db FROM b t LEFT JOIN b r ON r.episode = t.episode AND r.band = t.band AND r.board = 0 WHERE t.board <> 0"""
_TOLD = "told AS (SELECT sensor, win, CASE WHEN (length(sensor) + win) % 13 = 0 THEN 'who_knows' WHEN (length(sensor) + win) % 7 = 0 THEN 'mild_deviation' ELSE label END AS said FROM lab)"
_NET = _CMP[_CMP.index("net0 AS"):]
ORACLE_SQL |= {
    "anomaly_decisions": f"""WITH {_CMP}, g AS (SELECT win, coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (s >= 4), '') AS sig, coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (s = 3), '') AS mild, count(*) FILTER (s >= 4) AS ns, count(*) FILTER (s >= 3) AS n_odd, bool_or(s = 2) AS issue FROM sev GROUP BY win)
SELECT win, label, label IN ('localized_vibration_deviation', 'multi_sensor_structure_wide_vibration_event') OR n_odd > 0 AS anomaly, CASE WHEN label = 'multi_sensor_structure_wide_vibration_event' OR ns >= 2 THEN 'critical' WHEN label = 'localized_vibration_deviation' OR ns > 0 THEN 'warning'
  WHEN label = 'sensor_network_quality_issue' OR issue THEN 'quality' WHEN label LIKE 'mild%' OR mild <> '' THEN 'notice' ELSE 'normal' END AS severity, concat_ws('|', label, affected_sensors, sig, mild) AS dedupe_key FROM net JOIN g USING (win)""",
    "rederived_labels": f"""WITH {_chain(_S, "")}, {_TOLD}, ok AS (SELECT win, bool_and(said <> 'who_knows') AS whole FROM told GROUP BY win),
pick AS (SELECT win, sensor, CASE WHEN whole THEN said ELSE label END AS label FROM lab JOIN told USING (win, sensor) JOIN ok USING (win)),
sev2 AS (SELECT *, CASE label WHEN 'normal_relative_to_baseline' THEN 0 WHEN 'insufficient_data' THEN 1 WHEN 'possible_sensor_issue' THEN 2 WHEN 'mild_deviation' THEN 3 WHEN 'significant_local_deviation' THEN 4 ELSE 5 END AS s FROM pick),
{_NET.replace("FROM sev GROUP", "FROM sev2 GROUP")} SELECT win, label, CASE WHEN whole THEN 'model' ELSE 'rules' END AS source FROM net JOIN ok USING (win)""",
    "quality_conflicts": f"""WITH {_CMP}, {_TOLD} SELECT sensor, win, (flags || reference_flags <> '' AND said NOT IN ('insufficient_data', 'possible_sensor_issue')) OR (label NOT IN ('insufficient_data', 'possible_sensor_issue') AND said IN ('insufficient_data', 'possible_sensor_issue')) AS conflict FROM cmp JOIN told USING (sensor, win) JOIN lab USING (sensor, win)""",
    "result_envelopes": f"""WITH {_CMP} SELECT win, count(*) AS attempted, coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (s <> 1), '') AS checked, coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (s = 1), '') AS failed FROM sev GROUP BY win""",
    "machine_classes": f"""WITH {_F}, {_chain(_S, "").strip()}, sp AS (SELECT sensor, win, exp(avg(ln(m + 1e-12))) / avg(m + 1e-12) AS flat, arg_max(hz, m) * 10 AS hz FROM mag GROUP BY sensor, win), u AS (SELECT sensor, avg(rms) AS usual FROM feat WHERE n >= 32 GROUP BY sensor),
q AS (SELECT f.sensor, f.win, f.rms / usual AS r, f.kurtosis AS k, f.crest AS c, abs(f.skew) AS sk, hz, flat FROM feat f JOIN u USING (sensor) JOIN sp USING (sensor, win) WHERE f.n >= 32),
v AS (SELECT *, greatest(0, least(1, 0.35 / (1 + exp(-(r - 1.25) / 0.25)) + 0.3 / (1 + exp(-(k - 5) / 1.5)) + 0.2 / (1 + exp(-(c - 4.5))) + 0.15 / (1 + exp(-(sk - 1) / 0.7)))) AS sv FROM q)
SELECT sensor, win, CASE WHEN sv < 0.32 AND r < 1.35 AND k < 4.5 THEN 'healthy' WHEN flat > 0.65 AND r > 1.2 AND hz >= 80 THEN 'unknown_abnormal' WHEN r > 1.35 AND k < 4.8 AND hz < 120 THEN 'imbalance_or_looseness'
  WHEN k > 5 OR c > 4.5 OR r > 2 THEN CASE WHEN hz >= 200 THEN 'inner_race_fault' WHEN hz >= 80 THEN 'outer_race_fault' WHEN r > 1.35 THEN 'imbalance_or_looseness' ELSE 'unknown_abnormal' END ELSE 'unknown_abnormal' END AS label, round(sv, 4) AS severity FROM v""",
    "amplitude_scales": f"""WITH s AS ({_S}), m AS (SELECT win, quantile_cont(value, 0.5) AS med, quantile_cont(abs(value), 0.95) AS high FROM s GROUP BY win), d AS (SELECT win, any_value(high) AS high, quantile_cont(abs(value - med), 0.5) AS mad FROM s JOIN m USING (win) GROUP BY win) SELECT win, round(greatest(1.4826 * mad, high / 3, 1e-6), 4) AS scale FROM d""",
    "repeated_draw": """WITH c AS (SELECT c_custkey, c_nationkey * 20 + c_custkey % 20 AS grp FROM customer), r AS (SELECT c_custkey, grp, row_number() OVER (PARTITION BY grp ORDER BY sha256('6' || chr(0) || c_custkey::VARCHAR), c_custkey) AS turn, count(*) OVER (PARTITION BY grp) AS n FROM c) SELECT c_custkey, grp, ((12 - turn) // n + 1)::INT AS copies FROM r WHERE turn <= 12""",
    "bound_devices": "SELECT n_nationkey AS board, CASE n_nationkey WHEN 3 THEN NULL WHEN 5 THEN 'other' ELSE n_name END AS serial, CASE n_nationkey WHEN 3 THEN 'missing_device' WHEN 5 THEN 'wrong_device' WHEN 7 THEN 'unknown_board' ELSE 'bound' END AS status FROM nation",
    "board_coherence": """WITH c0 AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, f, j, embedding[f * 8 + j + 1]::DOUBLE AS x FROM embeddings, range(0, 7) AS a(f), range(0, 16) AS b(j)), c1 AS (SELECT *, (x - avg(x) OVER (PARTITION BY pair, side, f)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS v FROM c0),
ft AS (SELECT pair, side, f, k, sum(v * cos(2 * pi() * k * j / 16)) AS re, -sum(v * sin(2 * pi() * k * j / 16)) AS im FROM c1, range(0, 9) AS q(k) GROUP BY pair, side, f, k),
x AS (SELECT a.pair, a.k, sum(a.re * b.re + a.im * b.im) AS cr, sum(a.im * b.re - a.re * b.im) AS ci, sum(a.re ** 2 + a.im ** 2) AS pa, sum(b.re ** 2 + b.im ** 2) AS pb FROM ft a JOIN ft b ON a.pair = b.pair AND a.f = b.f AND a.k = b.k AND a.side = 0 AND b.side = 1 GROUP BY a.pair, a.k),
h AS (SELECT pair, k * 4 AS hz, (cr ** 2 + ci ** 2) / (pa * pb) AS c FROM x) SELECT pair, band, round(avg(c), 5) AS coherence FROM h JOIN (VALUES ('4-12', 4, 12), ('12-33', 12, 33)) t(band, lo, hi) ON hz >= lo AND hz < hi GROUP BY pair, band""",
    "dominant_peaks": f"""WITH {_PSD}, d AS (SELECT id, bin, frequency, 10 * log10(power + 1e-24) AS p, lag(power) OVER w AS b, lead(power) OVER w AS a, power FROM psd WHERE bin > 0 WINDOW w AS (PARTITION BY id ORDER BY bin)),
pk AS (SELECT * FROM d WHERE power > b AND power >= a),
lf AS (SELECT pk.id, pk.bin, min(d.p) AS low FROM pk JOIN d ON d.id = pk.id AND d.bin <= pk.bin AND d.bin >= coalesce((SELECT max(e.bin) FROM d e WHERE e.id = pk.id AND e.bin < pk.bin AND e.p > pk.p), 0) GROUP BY pk.id, pk.bin),
rt AS (SELECT pk.id, pk.bin, min(d.p) AS low FROM pk JOIN d ON d.id = pk.id AND d.bin >= pk.bin AND d.bin <= coalesce((SELECT min(e.bin) FROM d e WHERE e.id = pk.id AND e.bin > pk.bin AND e.p > pk.p), 99) GROUP BY pk.id, pk.bin),
pr AS (SELECT pk.id, pk.bin, pk.frequency, pk.p, pk.p - greatest(lf.low, rt.low) AS h FROM pk JOIN lf USING (id, bin) JOIN rt USING (id, bin)), ok AS (SELECT * FROM pr WHERE h >= 3 UNION ALL SELECT id, arg_max(bin, p), arg_max(frequency, p), max(p), 0 FROM d WHERE id NOT IN (SELECT id FROM pr WHERE h >= 3) GROUP BY id)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY h + p * 1e-3 DESC, bin))::INT AS rank, frequency, round(h, 4) AS prominence_db FROM ok QUALIFY rank <= 3""",
}
ORACLE_SQL["reference_levels"] = f"""WITH {_CMP}, c AS (SELECT cmp.win, cmp.sensor, round(met.rms / rms_ratio, 6) AS level FROM cmp JOIN met ON met.win = cmp.win AND met.sensor = cmp.sensor WHERE peak_ratio < 1 AND rms_ratio > 1e-9),
f AS (SELECT win, arg_min(level, sensor) AS level FROM c GROUP BY win), w AS (SELECT DISTINCT win FROM cmp)
SELECT w.win, arg_max(level, f.win) AS ref_rms, max(f.win) AS from_win FROM w LEFT JOIN f ON f.win BETWEEN w.win - 3 AND w.win GROUP BY w.win"""
ORACLE_SQL["quality_vectors"] = f"""WITH q AS ({ORACLE_SQL["window_quality"].replace("round(1 / step, 6)", "1 / step").replace("round(valid, 6)", "valid").replace("round(missing, 6)", "missing").replace("round(clipped, 6)", "clipped")}),
v AS (SELECT sensor, win, [valid, missing, clipped, monotonic::INT, 0, 1 / 3::DOUBLE, least(coalesce(rate, 0) / 2 / 6000, 1), least(ln(1 + gaps) / 10, 10), CASE WHEN rate IS NOT NULL THEN least(rate / 26700, 4) END, 0, 0, usable::INT, 1] AS v FROM q)
SELECT sensor, win, k::INT AS place, round(v[k + 1], 12) + 0 AS value FROM v, range(0, 13) AS r(k)"""
QUERIES |= corpus_queries.QUERIES | signal_queries.QUERIES | source_queries.QUERIES | label_queries.QUERIES
ORACLE_SQL |= corpus_queries.ORACLE_SQL | signal_queries.ORACLE_SQL | source_queries.ORACLE_SQL | label_queries.ORACLE_SQL
ORACLE_SQL["validation_export"] = f"""WITH {label_queries._REGISTRY}, {_CMP.strip()}, s AS (SELECT *, row_number() OVER (PARTITION BY sensor, win ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY sensor, win) AS n FROM ({_S})), told AS (SELECT sensor, win, label, [0.82, 0.96, 0.9, 0.74, 0.86, 0.88][s + 1]::DOUBLE AS confidence FROM sev WHERE win % 5 <> 2),
u AS (SELECT s.*, reg.location, reg.role, reg.axis, told.label AS l, told.confidence AS confidence, CASE WHEN s.sensor = '{REFERENCE}' THEN 'normal_relative_to_baseline' ELSE 'insufficient_data' END AS d, net.label AS network_label FROM s LEFT JOIN told ON told.sensor = s.sensor AND told.win = s.win LEFT JOIN net ON net.win = s.win LEFT JOIN reg ON reg.sensor_id = s.sensor)
SELECT win AS window_id, sensor AS sensor_id, location, role, axis, 100.0::DOUBLE AS sampling_rate_hz, k / 100.0::DOUBLE AS time_s, round(value, 4) AS acceleration_g, coalesce(l, d) AS small_agent_label, coalesce(confidence, CASE WHEN sensor = '{REFERENCE}' THEN 1 ELSE 0 END)::DOUBLE AS small_agent_confidence, coalesce(l, d) AS python_rule_label, coalesce(network_label, '') AS network_label,
  CASE WHEN n < 60 THEN 'short_window' ELSE '' END AS quality_flags, l IS NOT NULL AS reported FROM u"""
ORACLE_SQL["stored_profile"] = ORACLE_SQL["healthy_profile"]
