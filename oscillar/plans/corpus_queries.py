"""Registered queries of evaluation, audits, selection and text, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.functions import signal, text
from oscillar.operators import audits, evaluation, selection, spectra, windows


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _pairs(spark, d):
    return _t(spark, d, "labels").select(F.col("doc_id").alias("episode"), F.col("toxic").alias("truth"), (1 - F.col("quality")).alias("predicted"))


_PAIRS = "SELECT doc_id AS episode, toxic AS truth, 1 - quality AS predicted FROM labels"


def _episodes(spark, d):
    """Orders as episodes with a true and a predicted set of targets."""
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 5
    none = F.array().cast("array<int>")
    truth = F.when(c % 4 == 0, none).when(c % 4 == 3, F.array(F.lit(1), (c % 3 + 3).cast("int"))).otherwise(F.array((c % 5 + 1).cast("int")))
    predicted = F.when(k == 0, none).when(k == 4, F.sequence(F.lit(1), F.lit(5))).otherwise(truth)
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("episode"), F.when(F.col("o_orderkey") % 11 > 0, truth).alias("truth"), predicted.alias("predicted"))


_EPISODES = """e0 AS (SELECT o_orderkey AS episode, CASE WHEN o_custkey % 4 = 0 THEN []::BIGINT[] WHEN o_custkey % 4 = 3 THEN [1, o_custkey % 3 + 3] ELSE [o_custkey % 5 + 1] END AS t FROM orders),
ep AS (SELECT episode, CASE WHEN episode % 11 > 0 THEN t END AS truth, CASE WHEN episode % 5 = 0 THEN []::BIGINT[] WHEN episode % 5 = 4 THEN [1, 2, 3, 4, 5] ELSE t END AS predicted FROM e0)"""


def target_localization(spark, d):
    return _rounded(evaluation.localization(_episodes(spark, d)))


def per_target_scores(spark, d):
    return _rounded(evaluation.per_target(_episodes(spark, d)))


def affected_histogram(spark, d):
    return evaluation.cardinalities(_episodes(spark, d))


def weighted_scores(spark, d):
    return _rounded(evaluation.weighted_scores(_pairs(spark, d)))


def false_alert_rate(spark, d):
    w = _t(spark, d, "labels").select(F.when(F.col("toxic") == 0, "normal").otherwise("anomaly").alias("truth"), F.when(F.col("quality") == 1, "normal").otherwise("anomaly").alias("predicted"), (F.col("doc_id") % 7 + 10.0).alias("seconds"))
    return _rounded(evaluation.false_alerts(w))


def persistence_metrics(spark, d):
    """Days of a kind of event as sessions, values above 60 as alert events."""
    e = windows.sample_windows(_t(spark, d, "events")).withColumns({"session": F.concat_ws("|", "sensor", "win"), "at": F.unix_micros(F.col("ts")) / 1e6})
    s = e.groupBy(F.col("sensor").alias("dataset"), "session", (F.col("win") % 2 == 0).alias("healthy")).agg(F.min("at").alias("start"), F.max("at").alias("end"))
    return _rounded(evaluation.persistence(s, e.filter("value > 60").select("session", "at")), 4)


def explanation_metrics(spark, d):
    c = _t(spark, d, "conversations").select(F.col("text").alias("explanation"), F.when(F.col("role") == "user", "deterministic_rules").otherwise("model").alias("source"))
    return _rounded(evaluation.explanations(c))


_NAMES = list(evaluation.OPERATIONAL_WEIGHTS)


def operational_scores(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.posexplode(F.array(*map(F.lit, _NAMES))).alias("k", "name"), "o_orderkey")
    c = o.withColumn("hit", (F.col("o_orderkey") % (F.col("k") + 2) > 0).cast("double")).groupBy("dataset", "name").agg(F.avg("hit").alias("value"))
    scores = evaluation.operational_score(c.filter("name <> 'affected_f1' OR dataset <> '1-URGENT'"), ["dataset"])
    low = evaluation.lowest(scores, "dataset", "score")
    return _rounded(scores.join(low.select("dataset", F.lit(True).alias("is_lowest")), "dataset", "left").withColumn("is_lowest", F.coalesce("is_lowest", F.lit(False))))


def _margins(spark, d):
    m = F.expr("transform(sequence(0, 4), t -> round(aggregate(filter(embedding, (v, k) -> k % 5 = t), 0D, (s, v) -> s + v), 1))")  # each target has every fifth number
    return _t(spark, d, "embeddings").select(F.col("label").alias("dataset"), (F.col("vec_id") % 5 + 1).cast("int").alias("truth"), m.alias("margins"), F.col("vec_id").alias("episode"))


def margin_summary(spark, d):
    return _rounded(evaluation.margin_summary(_margins(spark, d)))


def decision_statistics(spark, d):
    return evaluation.decision_statistics(_margins(spark, d).select(F.array("truth").alias("truth"), "margins"))


def paired_gain(spark, d):
    p = _pairs(spark, d)
    other = p.select("episode", "truth", F.when(F.col("episode") % 3 == 0, F.col("truth")).otherwise(F.col("predicted")).alias("predicted"))
    return _rounded(evaluation.paired_gain_interval(evaluation.paired(p, other), samples=50, seed=4))


def regression_guard(spark, d):
    m = evaluation.weighted_scores(_pairs(spark, d)).select(F.explode(F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("macro_f1"), F.col("macro_f1"), F.lit("weighted_f1"), F.col("weighted_f1"))).alias("name", "value"))
    other = m.select("name", (F.col("value") + F.when(F.col("name") == "macro_f1", 0.02).otherwise(-0.02)).alias("value"))
    return _rounded(evaluation.regression_guard(m, other, [("macro_f1", "gain", 0.005), ("accuracy", "drop", 0.01), ("weighted_f1", "drop", 0.025), ("missing", "gain", 0.0)]))


def champion_selection(spark, d):
    c = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("score"), (F.count(F.lit(1)) % 2 == 0).alias("passed"))
    return _rounded(evaluation.best_candidate(c, "5-LOW"), 4)


def _confidence(spark, d):
    return _pairs(spark, d).select("episode", ((F.col("episode") * 37 % 101) / 100.0).alias("confidence"), (F.col("truth") == F.col("predicted")).cast("int").alias("correct"))


def isotonic_calibration(spark, d):
    c = _confidence(spark, d)
    return _rounded(evaluation.calibrated(c.select("episode", "confidence"), evaluation.isotonic_curve(c)))


def baseline_status(spark, d):
    f = windows.window_features(windows.sample_windows(_t(spark, d, "events"))).withColumn("dominant_hz", (F.col("n") % 9).cast("double"))
    own = f.groupBy("sensor").agg(F.round(F.avg("rms"), 3).alias("rms")).select("sensor", F.when(F.col("sensor") != "click", F.col("rms")).alias("rms"), F.lit(None).cast("double").alias("kurtosis"), F.lit(3.5).alias("crest"), F.lit(None).cast("double").alias("dominant_hz"))
    out = evaluation.baseline_status(f.select("sensor", "win", "rms", "kurtosis", "crest", "dominant_hz"), own, {"rms": 20.0, "kurtosis": 3.0, "crest": 3.0, "dominant_hz": 5.0})
    return _rounded(out.drop("rms", "kurtosis", "crest"), 4)


def dominant_sensors(spark, d):
    return evaluation.dominant_sensors(windows.window_features(windows.sample_windows(_t(spark, d, "events"))))


def _assigned(spark, d):
    docs = _t(spark, d, "documents")
    g = F.concat_ws("|", "source", (F.col("doc_id") % 40).cast("string"))
    split = F.element_at(F.array(*map(F.lit, ("train", "val", "test", "hold"))), F.when(F.col("doc_id") % 97 == 0, 4).otherwise((F.col("doc_id") % 40) % 3 + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("episode"), F.col("source").alias("dataset"), split.alias("split"), g.alias("group"), (F.col("lang") != "en").alias("labelled"))


_ASSIGNED = """ea AS (SELECT doc_id AS episode, source AS dataset, CASE WHEN doc_id % 97 = 0 THEN 'hold' ELSE ['train', 'val', 'test'][doc_id % 40 % 3 + 1] END AS split, concat_ws('|', source, (doc_id % 40)::VARCHAR) AS "group", lang <> 'en' AS labelled FROM documents),
asg AS (SELECT DISTINCT "group", CASE WHEN doc_id % 40 = 5 THEN 'test' ELSE ['train', 'val', 'test'][doc_id % 40 % 3 + 1] END AS split FROM (SELECT *, concat_ws('|', source, (doc_id % 40)::VARCHAR) AS "group" FROM documents) WHERE doc_id % 40 <> 7)"""


def _assignment(spark, d):
    k = F.col("doc_id") % 40
    split = F.when(k == 5, "test").otherwise(F.element_at(F.array(*map(F.lit, audits.SPLITS)), (k % 3 + 1).cast("int")))
    return _t(spark, d, "documents").filter(k != 7).select(F.concat_ws("|", "source", k.cast("string")).alias("group"), split.alias("split")).distinct()


def split_gaps(spark, d):
    return audits.split_gaps(_assigned(spark, d), _assignment(spark, d), ("train", "val"), {"train": 1, "total": 2})


def supervised_coverage(spark, d):
    return audits.supervised_coverage(_assigned(spark, d).filter("NOT (dataset = 'src3' AND labelled AND split = 'val')"))


def assignment_differences(spark, d):
    return audits.set_differences(_assigned(spark, d).filter("episode % 40 <> 9"), _assignment(spark, d), "group")


def index_violations(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_orderkey") - F.col("o_orderkey") % 50 % 2).alias("id"), "o_totalprice", "o_orderstatus", "o_orderdate")
    rules = {"price": F.col("o_totalprice") < 300_000, "status": F.col("o_orderstatus").isin("F", "O"), "date": F.col("o_orderdate") >= "1993-01-01"}
    return audits.violations(o, "id", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def episode_windows(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("recording"), F.transform("embedding", lambda v: F.when(F.abs(v) < 2.5, v)).alias("x"))
    w = audits.episode_windows(e, 24, 10, 0.97)
    return w.select("recording", "start", F.round("valid", 6).alias("valid"))


def centred_windows(spark, d):
    starts = audits.centred_starts((F.col("n_chars") + 100).cast("int"), 60, 4)
    return _t(spark, d, "documents").select("doc_id", F.posexplode(starts).alias("k", "start"))


def supervision_tasks(spark, d):
    e = _episodes(spark, d).select("episode", F.when(F.col("episode") % 7 > 0, F.when(F.size("predicted") > 0, "changed").otherwise("normal")).alias("state"), F.col("truth").alias("affected"))
    return audits.supervision_tasks(e)


def slot_orders(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.concat_ws("", audits.slot_order(3, F.col("c_custkey"))).alias("slots"))


def balanced_schedule(spark, d):
    return audits.balanced_schedule(_t(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey"), ["c_mktsegment", "c_nationkey"], "c_custkey", 200, 5)


def corpus_signature(spark, d):
    return audits.corpus_signature(_t(spark, d, "labels"), ["doc_id", "quality", "toxic"])


def corpus_view(spark, d):
    rows = _assigned(spark, d)
    return audits.corpus_view(rows.select("episode", "dataset", "split"), [("train", "src3", 20), ("val", "src3", 5), ("train", "src7", 7), ("test", "src9", 3)], 2)


def latest_windows(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("sensor"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return _rounded(selection.latest_samples(e, 86_400.0, 0.0006), 3)


def thinned_windows(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    t = selection.thinned(e, 20)
    return _rounded(t.select("id", "n", "stride", F.size("preview").alias("kept"), F.element_at("preview", -1).cast("double").alias("last"), "low", "high", "mean", "rms"), 5)


def identical_feeds(spark, d):
    e = _t(spark, d, "events").select(F.floor(F.col("event_id") / 9).alias("win"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("event_id") % 3 + 1).cast("int")).alias("sensor"), F.round(F.col("value") / 400).cast("int").alias("v"), "event_id")
    x = e.groupBy("win", "sensor").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda s: s["v"]).alias("x"))
    return selection.identical_feeds(x)


def sensor_selection(spark, d):
    n = _t(spark, d, "nation")
    known = n.select(F.col("n_name").alias("sensor"))
    aliases = n.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("alias"), F.col("n_name").alias("sensor"))
    asked = n.select((F.col("n_nationkey") % 13).cast("long").alias("place"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("N"), F.col("n_nationkey") - 1)).alias("name"))
    return selection.resolved(asked, aliases, known, "FRANCE")


def defaulted_reports(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, d, "nation").filter("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"), F.lit(0.5).alias("confidence"))
    return selection.with_defaults(c, n, "c_nationkey", {"label": "unknown", "confidence": 0.0})


def tag_columns(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    tags = e.filter("event_type IN ('signup', 'error')").select(F.col("event_type").alias("label"), F.col("ts").alias("low"), (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("high"))
    return selection.tag_columns(e.filter("event_type IN ('click', 'view')").select("id", "ts"), tags, ["signup", "error"], "ts").drop("ts")


def event_store(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "value")
    store = e.filter("event_id < 500").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min("value").alias("value"))
    return selection.inserted(store, e.filter("event_id >= 500").select("user_id", "event_id", "value"), "user_id")


def newest_alerts(spark, d):
    return selection.newest(_t(spark, d, "events").select("event_id", "event_type", "value"), "event_id", 25, F.col("value") > 60)


def latest_event(spark, d):
    return selection.latest_row(_t(spark, d, "events").select("event_id", "event_type", "value"), "event_id")


def history_compaction(spark, d):
    return selection.compacted(_t(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 30)


_KNOWN = ["building", "machinery", "furniture", "household"]


def text_functions(spark, d):
    c = _t(spark, d, "customer")
    raw = F.element_at(F.array(*map(F.lit, ("High-Pass", " lp ", "band pass", "", "bandstop", "comb", "RAW"))), (F.col("c_custkey") % 7 + 1).cast("int"))
    num = F.element_at(F.array(*map(F.lit, ("12.5", "x", "-3", "1e3", "NaN", ""))), (F.col("c_custkey") % 6 + 1).cast("int"))
    flag = F.element_at(F.array(*map(F.lit, ("yes", "OFF", "maybe", " True "))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _rounded(
        c.select(
            "c_custkey", text.token(F.col("c_name")).alias("token"), text.filter_name(raw).alias("filter"), text.alias_of(F.concat(F.lit("the "), F.col("c_mktsegment")), _KNOWN, {"the automobile": "machinery"}, "other").alias("scenario"),
            text.number(num, 7.0, 0.0, 100.0).alias("number"), text.truth(flag).alias("flag"), text.holds_term(F.col("c_mktsegment"), ["build", "house hold"]).alias("held"), text.redacted(F.lower("c_mktsegment"), ["furn"]).alias("redacted"),
        )
    )


def time_functions(spark, d):
    o = _t(spark, d, "orders")
    start = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    end = F.when(F.col("o_orderkey") % 5 == 0, "never").otherwise(F.date_format(F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_custkey % 1000 - 100)"), "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", text.seconds_between(start, end).alias("seconds"), text.estimated_samples(F.col("o_custkey") * 1000, 100, 3).alias("samples"))


def rotation_check(spark, d):
    a = F.col("c_custkey") / 10
    cos, sin = F.round(F.cos(a), 4), F.round(F.sin(a), 4)
    m = F.array(cos, -sin, F.lit(0.0), sin, cos, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.when(F.col("c_custkey") % 3 == 0, -1.0).when(F.col("c_custkey") % 3 == 1, 1.0).otherwise(1.05))
    x, y, z = signal.rotate([[0, 1, 0], [-1, 0, 0], [0, 0, 1]], F.col("c_acctbal"), F.lit(2.0), F.lit(3.0))
    return _rounded(_t(spark, d, "customer").select("c_custkey", text.rotation_valid(m).alias("valid"), (x + 10 * y + 100 * z).alias("mixed")))


def target_sets(spark, d):
    e = _episodes(spark, d)
    given = F.transform("predicted", lambda t: F.concat(F.when(t % 2 == 0, "target_").otherwise(" "), t))
    given = F.when(F.col("episode") % 9 == 0, F.concat(given, F.array(F.lit("T?")))).otherwise(given)
    s = F.col("predicted")
    return e.select("episode", F.concat_ws(",", text.target_numbers(given)).alias("numbers"), evaluation.set_name(s).alias("name"), evaluation.detailed_set_name(s).alias("detailed"), evaluation.set_index(s).alias("bits"), F.when(F.size(s) > 0, "anomaly").otherwise("normal").alias("state"))


def natural_order(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", text.natural_key(F.concat(F.lit("Run"), F.col("c_custkey"), F.lit("_"), F.col("c_nationkey"), F.lit(".csv"))).alias("key"), F.concat_ws(",", text.spread(F.sequence(F.lit(1), F.col("c_nationkey") + 1), 4)).alias("picked"))


def verdict_faults(spark, d):
    k = F.col("n_nationkey")
    sensor = F.when(k % 5 == 1, "s9").when(k % 5 == 2, "s1").otherwise("s2")
    label = F.when(k % 5 == 3, "strange").otherwise("mild_deviation")
    reply = F.concat(F.lit('Sure: ```json {"verdicts": [{"sensor": "s1", "label": "normal_relative_to_baseline"}, {"sensor": "'), sensor, F.lit('", "label": "'), label, F.lit('"}]} ``` done'))
    reply = F.when(k % 5 == 4, "no idea").otherwise(reply)
    return _t(spark, d, "nation").select("n_nationkey", text.verdict_faults(reply, ["s1", "s2"], tuple(windows.SENSOR_LABELS)).alias("faults"))


def request_parsing(spark, d):
    words = F.element_at(F.array(*map(F.lit, ("show the last 10 seconds", "2.5 min of s3", "1 hour please", "status"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    prompt = F.concat(F.lit("a<codes>"), F.col("n_name"), F.lit("</codes> b <codes>x</codes>"))
    codes = F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 5 + 1), lambda v: (v * 7 % 16).cast("int"))
    return _t(spark, d, "nation").select(
        "n_nationkey", text.asked_seconds(words).alias("seconds"), F.array_join(text.code_strings(prompt), "|").alias("codes"), text.encoded(codes, "0123456789abcdef").alias("symbols"),
        F.array_join(text.decoded(text.encoded(codes, "0123456789abcdef"), "0123456789abcdef"), ",").alias("numbers"),
    )


def scaled_features(spark, d):
    names = ("rms_g::x", "band_energy_g2::1", "cross_axis_covariance_g2::xy", "peak_frequency_hz::x", "crest_factor::x", "kurtosis::x", "spectral_entropy::x", "peak_prominence_db::x", "modal_damping_ratio::1", "transmissibility_db::1", "normal_change_z::1", "other")
    n = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))
    return _rounded(_t(spark, d, "customer").select("c_custkey", text.scaled_feature(n, F.col("c_acctbal") / 100).alias("scaled"), text.logistic(F.col("c_acctbal"), 4500.0, 0.001).alias("soft")))


def level_split(spark, d):
    return _rounded(spectra.levels(windows.window_arrays(windows.sample_windows(_t(spark, d, "events"))), "view"), 5)


def board_relations(spark, d):
    b = spectra.band_powers(_t(spark, d, "embeddings"), "vec_id", "embedding", 64.0).select(F.expr("id DIV 6").alias("episode"), (F.col("id") % 6).alias("board"), "band", "power")
    return _rounded(spectra.board_relations(b, 0), 4)


def axis_covariances(spark, d):
    li = _t(spark, d, "lineitem")
    return _rounded(li.groupBy("l_returnflag", "l_linestatus").agg(*(F.covar_samp(a, b).alias(n) for n, a, b in (("xy", "l_quantity", "l_discount"), ("xz", "l_quantity", "l_tax"), ("yz", "l_discount", "l_tax")))), 5)


QUERIES = {
    f.__name__: f
    for f in (
        target_localization, per_target_scores, affected_histogram, weighted_scores, false_alert_rate, persistence_metrics, explanation_metrics, operational_scores, margin_summary, decision_statistics, paired_gain,
        regression_guard, champion_selection, isotonic_calibration, baseline_status, dominant_sensors, split_gaps, supervised_coverage, assignment_differences, index_violations, episode_windows, centred_windows,
        supervision_tasks, slot_orders, balanced_schedule, corpus_signature, corpus_view, latest_windows, thinned_windows, identical_feeds, sensor_selection, defaulted_reports, tag_columns, event_store, newest_alerts,
        latest_event, history_compaction, text_functions, time_functions, rotation_check, target_sets, natural_order, verdict_faults, request_parsing, scaled_features, level_split, board_relations, axis_covariances,
    )
}

_S = "SELECT event_type AS sensor, (floor(epoch(ts) / 86400))::BIGINT AS win, event_id, ts, value FROM events"
_W = f"w0 AS (SELECT *, value - avg(value) OVER (PARTITION BY sensor, win) AS c FROM ({_S})), wf AS (SELECT sensor, win, count(*) AS n, sqrt(avg(c * c)) AS rms, avg(c ** 4) AS m4, max(abs(c)) AS peak, max(c) - min(c) AS ptp FROM w0 GROUP BY sensor, win)"
_CONF = f"SELECT episode, (episode * 37 % 101) / 100.0::DOUBLE AS confidence, (truth = predicted)::INT AS correct FROM ({_PAIRS})"
_WS = f"""p AS ({_PAIRS}), ls AS (SELECT truth AS l FROM p UNION SELECT predicted FROM p),
pl AS (SELECT l, count(*) FILTER (truth = l) AS s, count(*) FILTER (predicted = l) AS c, count(*) FILTER (truth = l AND predicted = l) AS tp FROM p, ls GROUP BY l),
ws AS (SELECT sum(s)::BIGINT AS n, sum(tp) / sum(s) AS accuracy, avg(2 * tp / (s + c)) AS macro_f1, sum(2 * tp / (s + c) * s) / sum(s) AS weighted_f1 FROM pl)"""
_SAME = "list_sort(truth) = list_sort(predicted)"
_MARGIN = "mg AS (SELECT label AS dataset, (vec_id % 5 + 1)::INT AS truth, list_transform(range(0, 5), lambda t: round(list_sum(list_transform(list_filter(range(0, 64), lambda k: k % 5 = t), lambda k: embedding[k + 1]::DOUBLE)), 1)) AS margins FROM embeddings)"

ORACLE_SQL = {
    "target_localization": f"""WITH {_EPISODES} SELECT count(*) FILTER (truth IS NOT NULL) AS supervised, count(*) FILTER (truth IS NULL) AS unsupervised, round(avg(({_SAME})::INT) FILTER (truth IS NOT NULL), 6) AS exact_set_match,
  count(*) FILTER (len(truth) = 1) AS single_target_episodes, round(avg(({_SAME})::INT) FILTER (len(truth) = 1), 6) AS single_target_exact, round(avg((len(predicted) = 5)::INT) FILTER (len(truth) = 1), 6) AS single_target_all_rate,
  round(avg((len(predicted) = 0)::INT) FILTER (len(truth) = 1), 6) AS single_target_none_rate, round(avg((len(predicted) BETWEEN 1 AND 4)::INT) FILTER (len(truth) = 1), 6) AS single_target_partial_rate,
  round(avg((len(predicted) > 0)::INT) FILTER (len(truth) = 0), 6) AS normal_false_positive_rate FROM ep""",
    "per_target_scores": f"""WITH {_EPISODES}, c AS (SELECT target::INT AS target, count(*) FILTER (list_contains(truth, target)) AS support, count(*) FILTER (list_contains(predicted, target)) AS called, count(*) FILTER (list_contains(truth, target) AND list_contains(predicted, target)) AS tp
  FROM ep, range(1, 6) AS r(target) WHERE truth IS NOT NULL GROUP BY target)
SELECT target, support, round(CASE WHEN called > 0 THEN tp / called ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(CASE WHEN support + called > 0 THEN 2 * tp / (support + called) ELSE 0 END, 6) AS f1 FROM c""",
    "affected_histogram": f"WITH {_EPISODES} SELECT len(predicted)::INT AS affected, count(*) AS episodes FROM ep GROUP BY 1",
    "weighted_scores": f"WITH {_WS} SELECT n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM ws",
    "false_alert_rate": "SELECT round(h, 6) AS healthy_hours, n AS false_alerts, round(n / h, 6) AS per_hour FROM (SELECT sum(doc_id % 7 + 10.0::DOUBLE) FILTER (toxic = 0) / 3600 AS h, count(*) FILTER (toxic = 0 AND quality = 0) AS n FROM labels)",
    "persistence_metrics": f"""WITH e AS ({_S}), s AS (SELECT sensor AS dataset, win, win % 2 = 0 AS healthy, min(epoch_us(ts)) / 1e6 AS st, max(epoch_us(ts)) / 1e6 AS en, count(*) FILTER (value > 60) AS ev, min(epoch_us(ts)) FILTER (value > 60) / 1e6 AS f FROM e GROUP BY sensor, win),
g AS (SELECT dataset, sum(en - st) FILTER (healthy) / 86400 AS days, coalesce(sum(ev) FILTER (healthy), 0)::BIGINT AS fe, count(*) FILTER (NOT healthy) AS ch, count(*) FILTER (NOT healthy AND f IS NOT NULL) AS det, list_sort(list(f - st) FILTER (NOT healthy AND f IS NOT NULL)) AS dl FROM s GROUP BY ROLLUP (dataset))
SELECT dataset, round(days, 4) AS healthy_days, fe AS false_events, CASE WHEN days > 0 THEN round(fe / days, 4) END AS false_events_per_day, ch AS changed_sessions, det AS detected, CASE WHEN ch > 0 THEN round(det / ch, 4) END AS recall, round(dl[len(dl) // 2 + 1], 4) AS median_delay FROM g""",
    "explanation_metrics": "SELECT count(*) AS episodes, count(DISTINCT text) AS distinct_explanations, round(count(DISTINCT text) / count(*), 6) AS distinct_fraction, round(avg((role = 'user')::INT), 6) AS fallback_fraction FROM conversations",
    "operational_scores": f"""WITH n AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', {w}::DOUBLE)" for k, (n, w) in enumerate(evaluation.OPERATIONAL_WEIGHTS.items()))}) t(k, name, w)),
c AS (SELECT o_orderpriority AS dataset, name, w, CASE WHEN name = 'affected_f1' AND o_orderpriority = '1-URGENT' THEN 0 ELSE avg((o_orderkey % (k + 2) > 0)::INT) END AS value FROM orders, n GROUP BY o_orderpriority, name, w),
s AS (SELECT dataset, exp(sum(w * ln(greatest(value, 1e-6)))) AS score FROM c GROUP BY dataset) SELECT dataset, round(score, 6) AS score, dataset = (SELECT arg_min(dataset, (score, dataset)) FROM s) AS is_lowest FROM s""",
    "margin_summary": f"""WITH {_MARGIN}, r AS (SELECT *, margins[truth] AS m, 1 + len(list_filter(range(1, 6), lambda k: margins[k] > margins[truth] OR (margins[k] = margins[truth] AND k < truth))) AS rank FROM mg)
SELECT dataset, truth, count(*) AS episodes, round(avg(m), 6) + 0 AS mean, round(quantile_cont(m, 0.5), 6) + 0 AS median, round(min(m), 6) + 0 AS least, round(max(m), 6) + 0 AS greatest, round(avg((m > 0)::INT), 6) AS positive_rate, round(avg(rank), 6) AS mean_rank, round(avg((rank = 1)::INT), 6) AS top1_rate FROM r GROUP BY dataset, truth""",
    "decision_statistics": f"""WITH {_MARGIN}, p AS (SELECT truth, list_filter(range(1, 6), lambda k: margins[k] > 0) AS p FROM mg)
SELECT count(*) AS episodes, count(*) FILTER (len(p) = 1 AND p[1] = truth) AS exact, sum((NOT list_contains(p, truth))::INT)::BIGINT AS missed, sum(len(p) - list_contains(p, truth)::INT)::BIGINT AS extra, count(*) FILTER (len(p) = 0) AS empty, count(*) FILTER (len(p) = 1) AS single FROM p""",
    "paired_gain": f"""WITH RECURSIVE st AS (SELECT 0 AS k, 0.36787944117144233::DOUBLE AS t, 0.36787944117144233::DOUBLE AS c UNION ALL SELECT k + 1, t / (k + 1), c + t / (k + 1) FROM st WHERE k < 8),
p AS (SELECT episode, truth, predicted AS a, CASE WHEN episode % 3 = 0 THEN truth ELSE predicted END AS b FROM ({_PAIRS})),
u AS (SELECT *, ('0x' || md5('4|' || r::VARCHAR || '|' || episode::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM p, range(0, 51) AS q(r)),
w AS (SELECT r, truth, a, b, CASE WHEN r = 0 THEN 1 ELSE (SELECT count(*) FROM st WHERE u.u >= st.c) END AS w FROM u),
l AS (SELECT r, 'a' AS who, truth, a AS p, w FROM w UNION ALL SELECT r, 'b', truth, b, w FROM w),
s AS (SELECT r, who, truth AS label, w AS n, CASE WHEN truth = p THEN w ELSE 0 END AS tp FROM l UNION ALL SELECT r, who, p, w, 0 FROM l),
f AS (SELECT r, who, avg(f) AS f FROM (SELECT r, who, label, CASE WHEN sum(n) > 0 THEN 2 * sum(tp) / sum(n) ELSE 0 END AS f FROM s GROUP BY r, who, label) GROUP BY r, who),
g AS (SELECT r, max(f) FILTER (who = 'b') - max(f) FILTER (who = 'a') AS gain FROM f GROUP BY r)
SELECT round(max(gain) FILTER (r = 0), 6) AS gain, round(quantile_cont(gain, 0.025) FILTER (r > 0), 6) AS lower, round(quantile_cont(gain, 0.975) FILTER (r > 0), 6) AS upper FROM g""",
    "regression_guard": f"""WITH {_WS}, m AS (SELECT unnest(['accuracy', 'macro_f1', 'weighted_f1']) AS name, unnest([accuracy, macro_f1, weighted_f1]) AS v FROM ws),
r AS (SELECT * FROM (VALUES ('macro_f1', 'gain', 0.005::DOUBLE), ('accuracy', 'drop', 0.01), ('weighted_f1', 'drop', 0.025), ('missing', 'gain', 0.0)) t(name, kind, allowed)),
j AS (SELECT r.*, v AS champion, v + CASE WHEN name = 'macro_f1' THEN 0.02::DOUBLE ELSE -0.02::DOUBLE END AS challenger FROM r LEFT JOIN m USING (name))
SELECT name, kind, round(champion, 6) AS champion, round(challenger, 6) AS challenger, round(allowed, 6) AS allowed, coalesce(CASE WHEN kind = 'gain' THEN challenger - champion >= allowed ELSE champion - challenger <= allowed END, false) AS passed FROM j""",
    "champion_selection": """WITH c AS (SELECT o_orderpriority AS name, avg(o_totalprice) AS score, count(*) % 2 = 0 AS passed FROM orders GROUP BY 1)
SELECT name, round(score, 4) AS score, name <> '5-LOW' AS promoted FROM c WHERE passed OR name = '5-LOW' ORDER BY score DESC, name LIMIT 1""",
    "isotonic_calibration": f"""WITH c AS ({_CONF}), g AS (SELECT confidence AS x, sum(correct) AS s, count(*) AS w FROM c GROUP BY confidence), q AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw, s, w FROM g),
lo AS (SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS v FROM q a JOIN q b ON b.i >= a.i), mn AS (SELECT q.i, lo.j, min(v) AS v FROM q JOIN lo ON lo.j <= q.i AND lo.k >= q.i GROUP BY q.i, lo.j), iso AS (SELECT i, max(v) AS v FROM mn GROUP BY i)
SELECT episode, round(confidence, 6) AS confidence, round(least(1, greatest(0, iso.v)), 6) AS calibrated FROM c JOIN q ON q.x = c.confidence JOIN iso USING (i)""",
    "baseline_status": f"""WITH {_W}, f AS (SELECT sensor, win, rms, m4 / rms ** 4 AS k, peak / rms AS c, n % 9 AS hz FROM wf), b AS (SELECT sensor, CASE WHEN sensor <> 'click' THEN round(avg(rms), 3) ELSE 20 END AS base FROM f GROUP BY sensor), j AS (SELECT *, rms / base AS ratio FROM f JOIN b USING (sensor))
SELECT sensor, win, hz::DOUBLE AS dominant_hz, round(ratio, 4) AS rms_ratio, round(k - 3, 4) + 0 AS kurtosis_change, round(c - 3.5::DOUBLE, 4) + 0 AS crest_change, hz - 5.0::DOUBLE AS dominant_hz_change, CASE WHEN ratio > 1.8 THEN 'high' WHEN ratio > 1.25 THEN 'elevated' ELSE 'normal' END AS rms_status,
  CASE WHEN k > 6.5 THEN 'high' WHEN k > 4.5 THEN 'elevated' ELSE 'normal' END AS kurtosis_status, CASE WHEN c > 5.5 THEN 'high' WHEN c > 4.2 THEN 'elevated' ELSE 'normal' END AS crest_status,
  CASE WHEN ratio > 1.8 OR k > 6.5 OR c > 5.5 THEN 'highly_abnormal' WHEN ratio > 1.25 OR k > 4.5 OR c > 4.2 THEN 'abnormal' ELSE 'normal' END AS status FROM j""",
    "dominant_sensors": f"""WITH {_W}, m AS (SELECT win, quantile_cont(ptp, 0.5) AS mp, quantile_cont(rms, 0.5) AS mr FROM wf GROUP BY win), o AS (SELECT win, sensor, ptp >= greatest(0.2, 3 * mp) AND rms >= greatest(0.02, 1.6 * mr) AS over_ FROM wf JOIN m USING (win))
SELECT win, sensor, over_ AND count(*) FILTER (over_) OVER (PARTITION BY win) BETWEEN 1 AND 2 AS stands_out FROM o""",
    "split_gaps": f"""WITH {_ASSIGNED}, j AS (SELECT ea.*, asg.split AS a FROM ea LEFT JOIN asg USING ("group")), ok AS (SELECT *, split IN ('train', 'val', 'test') AS known FROM j),
k AS (SELECT unnest(list_filter([CASE WHEN NOT known THEN 'episode_has_invalid_split' END, CASE WHEN known AND split = 'test' THEN 'episode_from_nonmaterialized_split' END, CASE WHEN known AND a IS NULL THEN 'episode_group_missing_from_assignment' END, CASE WHEN known AND a <> split THEN 'episode_assignment_mismatch' END], lambda x: x IS NOT NULL)) AS gap, dataset AS item FROM ok),
per AS (SELECT s AS split, (SELECT count(*) FROM ea WHERE ea.split = s) AS n FROM (VALUES ('train'), ('val'), ('test')) t(s))
SELECT gap, item, count(*) AS n FROM k GROUP BY gap, item UNION ALL SELECT 'materialized_split_has_no_episodes', split, n FROM per WHERE n = 0 AND split <> 'test' UNION ALL SELECT 'group_in_several_splits', "group", count(DISTINCT split) FROM ea GROUP BY "group" HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'build_split_episode_count_mismatch', 'train', n FROM per WHERE split = 'train' AND n <> 1 UNION ALL SELECT 'build_total_episode_count_mismatch', 'total', count(*) FROM ea HAVING count(*) <> 2""",
    "supervised_coverage": f"""WITH {_ASSIGNED}, e AS (SELECT * FROM ea WHERE NOT (dataset = 'src3' AND labelled AND split = 'val')), c AS (SELECT dataset, s AS split, (SELECT count(*) FROM e x WHERE x.dataset = d.dataset AND x.split = s AND x.labelled) AS labelled, (SELECT count(*) FROM e x WHERE x.dataset = d.dataset AND x.labelled) AS tot FROM (SELECT DISTINCT dataset FROM e) d, (VALUES ('train'), ('val'), ('test')) t(s))
SELECT dataset, split, labelled, CASE WHEN tot = 0 THEN 'limitation' WHEN labelled = 0 THEN 'error' ELSE 'covered' END AS status FROM c""",
    "assignment_differences": f"""WITH {_ASSIGNED}, x AS (SELECT DISTINCT "group" FROM ea WHERE episode % 40 <> 9), y AS (SELECT DISTINCT "group" FROM asg) SELECT 'missing' AS side, "group" FROM x WHERE "group" NOT IN (SELECT "group" FROM y) UNION ALL SELECT 'extra', "group" FROM y WHERE "group" NOT IN (SELECT "group" FROM x)""",
    "index_violations": """WITH o AS (SELECT o_orderkey - o_orderkey % 50 % 2 AS id, * FROM orders), v AS (SELECT 'price' AS rule, id FROM o WHERE NOT o_totalprice < 300000 UNION ALL SELECT 'status', id FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'date', id FROM o WHERE o_orderdate < '1993-01-01' UNION ALL SELECT 'unique', id FROM o GROUP BY id HAVING count(*) > 1)
SELECT rule, count(*) AS n, min(id) AS first_id FROM v GROUP BY rule""",
    "episode_windows": """WITH w AS (SELECT vec_id AS recording, s::INT AS start, len(list_filter(embedding[s + 1:s + 24], lambda v: abs(v) < 2.5)) / 24 AS valid FROM embeddings, unnest(range(0, 41, 10)) AS r(s)) SELECT recording, start, round(valid, 6) AS valid FROM w WHERE valid >= 0.97""",
    "centred_windows": "SELECT doc_id, k::INT AS k, greatest(0, least(n_chars + 100 - 60, floor((2 * k + 1) * (n_chars + 100) / 8 - 30)))::INT AS start FROM documents, range(0, 4) AS r(k)",
    "supervision_tasks": f"""WITH {_EPISODES}, s AS (SELECT episode, truth, CASE WHEN len(predicted) > 0 THEN 'changed' ELSE 'normal' END AS state FROM ep WHERE episode % 7 > 0)
SELECT episode, 'global' AS task, state AS label FROM s UNION ALL SELECT episode, 'target_' || t::VARCHAR, CASE WHEN list_contains(truth, t) THEN 'affected' ELSE 'normal' END FROM s, range(1, 6) AS r(t) WHERE truth IS NOT NULL""",
    "slot_orders": "SELECT c_custkey, string_agg(s::VARCHAR, '' ORDER BY sha256('3' || chr(0) || c_custkey::VARCHAR || chr(0) || s::VARCHAR)) AS slots FROM customer, range(1, 6) AS r(s) GROUP BY c_custkey",
    "balanced_schedule": """WITH h AS (SELECT i AS draw, ('0x' || sha256('5' || chr(0) || 'c_mktsegment' || chr(0) || i::VARCHAR)[1:8])::BIGINT AS h1, ('0x' || sha256('5' || chr(0) || 'c_nationkey' || chr(0) || i::VARCHAR)[1:8])::BIGINT AS h2, ('0x' || sha256('5' || chr(0) || 'c_custkey' || chr(0) || i::VARCHAR)[1:8])::BIGINT AS h3 FROM range(0, 200) AS r(i)),
a AS (SELECT c_mktsegment AS m, row_number() OVER (ORDER BY c_mktsegment) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)),
b AS (SELECT c_mktsegment AS m, c_nationkey AS k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)),
c AS (SELECT c_mktsegment AS m, c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer)
SELECT draw, c_custkey FROM h JOIN a ON a.i = h1 % a.n + 1 JOIN b ON b.m = a.m AND b.i = h2 % b.n + 1 JOIN c ON c.m = b.m AND c.k = b.k AND c.i = h3 % c.n + 1""",
    "corpus_signature": """WITH h AS (SELECT md5(concat_ws(chr(31), doc_id::VARCHAR, quality::VARCHAR, toxic::VARCHAR)) AS m FROM labels), s AS (SELECT count(*) AS n, sum(('0x' || m[1:8])::BIGINT)::VARCHAR AS a, sum(('0x' || m[9:16])::BIGINT)::VARCHAR AS b, sum(('0x' || m[17:24])::BIGINT)::VARCHAR AS c, sum(('0x' || m[25:32])::BIGINT)::VARCHAR AS d FROM h)
SELECT n AS "rows", md5(concat_ws('|', a, b, c, d)) AS signature FROM s""",
    "corpus_view": f"""WITH {_ASSIGNED}, w AS (SELECT * FROM (VALUES ('train', 'src3', 20), ('val', 'src3', 5), ('train', 'src7', 7), ('test', 'src9', 3)) t(split, dataset, quota)), r AS (SELECT episode, dataset, split, quota, row_number() OVER (PARTITION BY split, dataset ORDER BY sha256('2' || chr(0) || episode::VARCHAR), episode) AS turn FROM ea JOIN w USING (split, dataset))
SELECT split, dataset, episode FROM r WHERE turn <= quota""",
    "latest_windows": """WITH s AS (SELECT event_type AS sensor, event_id, epoch_us(ts) / 1e6 AS sec, value, max(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type) AS e, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events),
b AS (SELECT *, count(*) FILTER (sec > e - 86400) OVER (PARTITION BY sensor) >= 0.9::DOUBLE * 52 AS byt FROM s), k AS (SELECT * FROM b WHERE CASE WHEN byt THEN sec > e - 86400 ELSE back <= 52 END)
SELECT sensor, count(*) AS n, CASE WHEN any_value(byt) THEN 'timestamps' ELSE 'sample_count' END AS mode, round(CASE WHEN any_value(byt) THEN min(sec) ELSE max(e) - (count(*) - 1) / 0.0006::DOUBLE END, 3) AS first, round(max(e), 3) AS last, round(avg(value), 3) AS mean FROM k GROUP BY sensor""",
    "thinned_windows": """SELECT vec_id AS id, 64 AS n, 4 AS stride, 16 AS kept, round(embedding[61]::DOUBLE, 5) + 0 AS last, round(list_min(embedding)::DOUBLE, 5) + 0 AS low, round(list_max(embedding)::DOUBLE, 5) + 0 AS high, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / 64, 5) + 0 AS mean,
  round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / 64), 5) AS rms FROM embeddings""",
    "identical_feeds": """WITH e AS (SELECT event_id // 9 AS win, ['a', 'b', 'c'][event_id % 3 + 1] AS sensor, round(value / 400)::INT AS v, event_id FROM events), x AS (SELECT win, sensor, list(v ORDER BY event_id) AS x FROM e GROUP BY win, sensor)
SELECT win, string_agg(sensor, ',' ORDER BY sensor) AS sensors FROM x GROUP BY win, x HAVING count(*) > 1""",
    "sensor_selection": """WITH a AS (SELECT n_nationkey % 13 AS place, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE n_nationkey - 1 END AS k FROM nation)
SELECT CASE WHEN n_name = 'FRANCE' THEN -1 ELSE min(place) END::BIGINT AS place, n_name AS sensor FROM a JOIN nation ON n_nationkey = k GROUP BY n_name""",
    "defaulted_reports": "SELECT c_custkey, c_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN n_name ELSE 'unknown' END AS label, CASE WHEN n_nationkey % 4 > 0 THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "tag_columns": """WITH t AS (SELECT event_type, ts FROM events WHERE event_type IN ('signup', 'error')), h AS (SELECT DISTINCT s.event_id, t.event_type FROM events s JOIN t ON s.ts >= t.ts AND s.ts <= t.ts + INTERVAL 20 MINUTE WHERE s.event_type IN ('click', 'view'))
SELECT event_id AS id, coalesce(bool_or(h.event_type = 'signup'), false) AS tag_signup, coalesce(bool_or(h.event_type = 'error'), false) AS tag_error FROM events LEFT JOIN h USING (event_id) WHERE events.event_type IN ('click', 'view') GROUP BY event_id""",
    "event_store": """WITH s AS (SELECT user_id, min(event_id) AS event_id, min(value) AS value FROM events WHERE event_id < 500 GROUP BY user_id) SELECT user_id, event_id, value FROM s UNION ALL SELECT user_id, min(event_id), arg_min(value, event_id) FROM events WHERE event_id >= 500 AND user_id NOT IN (SELECT user_id FROM s) GROUP BY user_id""",
    "newest_alerts": "SELECT event_id, event_type, value FROM events WHERE value > 60 ORDER BY event_id DESC LIMIT 25",
    "latest_event": "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 1",
    "history_compaction": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 30",
    "text_functions": """SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS token, ['highpass', 'lowpass', 'bandpass', 'none', 'notch', NULL, 'none'][c_custkey % 7 + 1] AS filter,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') THEN lower(c_mktsegment) WHEN c_mktsegment = 'AUTOMOBILE' THEN 'machinery' ELSE 'other' END AS scenario, [12.5, 7, 0, 100, 7, 7][c_custkey % 6 + 1]::DOUBLE AS number, c_custkey % 4 IN (0, 3) AS flag,
  c_mktsegment = 'BUILDING' AS held, CASE WHEN c_mktsegment = 'FURNITURE' THEN '[redacted]' ELSE lower(c_mktsegment) END AS redacted FROM customer""",
    "time_functions": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN greatest(0, o_custkey % 1000 - 100)::DOUBLE END AS seconds, (o_custkey * 1000 // 608 * 100)::BIGINT AS samples FROM orders",
    "rotation_check": "SELECT c_custkey, c_custkey % 3 = 1 AS valid, round(2 - 10 * c_acctbal + 300, 6) AS mixed FROM customer",
    "target_sets": f"""WITH {_EPISODES} SELECT episode, CASE WHEN episode % 9 = 0 THEN '' ELSE array_to_string(list_sort(predicted), ',') END AS numbers, CASE len(predicted) WHEN 0 THEN 'NONE' WHEN 1 THEN 'T' || predicted[1]::VARCHAR ELSE 'MULTI' END AS name,
  CASE WHEN len(predicted) = 0 THEN 'NONE' ELSE array_to_string(list_transform(list_sort(predicted), lambda t: 'T' || t::VARCHAR), '+') END AS detailed, coalesce(list_sum(list_transform(predicted, lambda t: 2 ** (t - 1))), 0)::INT AS bits, CASE WHEN len(predicted) > 0 THEN 'anomaly' ELSE 'normal' END AS state FROM ep""",
    "natural_order": """SELECT c_custkey, 'run' || lpad(c_custkey::VARCHAR, 12, '0') || '_' || lpad(c_nationkey::VARCHAR, 12, '0') || '.csv' AS key, CASE WHEN c_nationkey + 1 <= 4 THEN array_to_string(range(1, c_nationkey + 2), ',') ELSE array_to_string(list_transform(range(0, 4), lambda i: round_even(i * c_nationkey / 3, 0)::BIGINT + 1), ',') END AS picked FROM customer""",
    "verdict_faults": "SELECT n_nationkey, ['', 'unknown_sensor,missing_sensor', 'missing_sensor,repeated_sensor', 'unknown_label', 'not_json'][n_nationkey % 5 + 1] AS faults FROM nation",
    "request_parsing": """SELECT n_nationkey, [10, 150, 3600, NULL][n_nationkey % 4 + 1]::DOUBLE AS seconds, n_name || '|x' AS codes, array_to_string(list_transform(range(1, n_nationkey % 5 + 2), lambda v: '0123456789abcdef'[v * 7 % 16 + 1]), '') AS symbols, array_to_string(list_transform(range(1, n_nationkey % 5 + 2), lambda v: v * 7 % 16), ',') AS numbers FROM nation""",
    "scaled_features": """WITH v AS (SELECT c_custkey, c_acctbal, c_acctbal / 100 AS v, c_custkey % 12 AS k FROM customer)
SELECT c_custkey, round(CASE k WHEN 0 THEN least(12, log10(1 + abs(v) / 1e-7)) WHEN 1 THEN least(16, log10(1 + abs(v) / 1e-14)) WHEN 2 THEN greatest(-16, least(16, sign(v) * log10(1 + abs(v) / 1e-14))) WHEN 3 THEN greatest(0, least(2, v / 500)) WHEN 4 THEN least(4, ln(1 + greatest(v, 0)) / 3)
  WHEN 5 THEN greatest(-4, least(4, sign(v) * ln(1 + abs(v)) / 4)) WHEN 6 THEN greatest(0, least(1, v)) WHEN 7 THEN greatest(0, least(2, v / 60)) WHEN 8 THEN greatest(0, least(5, v / 0.2)) WHEN 9 THEN greatest(-3, least(3, v / 40)) WHEN 10 THEN greatest(-2, least(2, v / 6)) ELSE greatest(-20, least(20, v)) END, 6) + 0 AS scaled,
  round(1 / (1 + exp(-(c_acctbal - 4500) * 0.001)), 6) AS soft FROM v""",
    "level_split": f"""WITH {_W}, l AS (SELECT sensor, win, 20 * log10(greatest(rms, 1e-12)) AS db FROM wf) SELECT a.sensor, a.win, round(a.db, 5) AS level_db, round(a.db - b.db, 5) + 0 AS level_rel_db FROM l a LEFT JOIN l b ON a.win = b.win AND b.sensor = 'view'""",
    "axis_covariances": "SELECT l_returnflag, l_linestatus, round(covar_samp(l_quantity, l_discount), 5) + 0 AS xy, round(covar_samp(l_quantity, l_tax), 5) + 0 AS xz, round(covar_samp(l_discount, l_tax), 5) + 0 AS yz FROM lineitem GROUP BY ALL",
}
