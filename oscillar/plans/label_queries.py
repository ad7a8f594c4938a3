"""Queries on nested documents, balanced samples and report figures, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscillar.operators import audits, labels, requests, sampling, selection, windows
from oscillar.sources.shared import shared_dir


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _documents(spark, d) -> DataFrame:
    """JSON lines in the shared folder, one for each order, whose fields lie at different depths; some are wrong or lacking."""
    k = "o_orderkey"
    fields = {
        "affected_targets": f"CASE WHEN {k} % 19 = 5 THEN array('target_x') WHEN {k} % 7 IN (1, 2) THEN array('1', 'target_3', CAST({k} % 6 AS STRING)) END",
        "array_path": f"IF({k} % 3 = 2, concat('/data/', element_at(array('test', 'train', 'other'), CAST({k} % 3 + 1 AS INT)), '/test/a.npz'), NULL)",
        "class_name": f"IF({k} % 5 = 1, 'damping_change', IF({k} % 23 = 9, 'odd', NULL))",
        "dataset_id": f"CASE WHEN {k} % 4 = 0 THEN concat('d', {k} % 3) WHEN {k} % 5 = 0 THEN '' END",
        "episode": f"IF({k} % 4 = 3, named_struct('provenance', named_struct('dataset_id', concat('d', {k} % 3))), NULL)",
        "episode_id": f"IF({k} % 6 = 5, concat('g', o_custkey), NULL)",
        "group": f"IF({k} % 6 = 1, concat('g', o_custkey), NULL)",
        "healthy": "IF(o_orderstatus = 'F', true, NULL)",
        "metadata": f"named_struct('dataset_id', IF({k} % 4 = 2, concat('d', {k} % 3), NULL), 'training_role', IF({k} % 11 = 0, 'representation_only', NULL))",
        "provenance": f"named_struct('dataset_id', IF({k} % 4 = 1, concat('d', {k} % 3), NULL), 'session_id', IF({k} % 6 = 3, concat('g', o_custkey), NULL), 'split', IF({k} % 3 = 1, 'validation', NULL), 'split_group', IF({k} % 6 = 2, concat('g', o_custkey), NULL))",
        "session_id": f"IF({k} % 6 = 4, concat('g', o_custkey), NULL)",
        "severity": f"IF({k} % 13 = 0, NULL, 'warning')",
        "split": f"IF({k} % 3 = 0, 'train', NULL)",
        "split_group": f"IF({k} % 6 = 0, concat('g', o_custkey), NULL)",
        "supervision_scope": f"IF({k} % 17 = 3, ' Global_only', NULL)",
        "target_supervision_available": f"IF({k} % 29 = 4, false, NULL)",
    }
    doc = F.to_json(F.struct(*(F.expr(e).alias(n) for n, e in fields.items())))
    lines = _t(spark, d, "orders").select(F.when(F.col(k) % 37 == 11, F.lit("[1]")).otherwise(doc).alias("json"), F.col(k).alias("key"))
    path = shared_dir(spark, "documents")
    lines.select(F.to_json(F.struct("key", "json")).alias("value")).write.text(path)
    return spark.read.schema("key long, json string").json(path)


def _fields(spark, d) -> DataFrame:
    return labels.index_fields(_documents(spark, d))


def nested_fields(spark, d):
    """Where each field of the documents was found, and what none has."""
    return _fields(spark, d).select("key", "dataset_id", "split", "group_id", "training_role", "stratum", F.array_join("missing", ",").alias("missing"))


def episode_labels(spark, d):
    """Labels of the documents; the dataset d2 can't locate changes."""
    out = labels.episode_labels(_fields(spark, d), F.when(F.col("dataset_id") == "d2", "global_unknown").otherwise("target"))
    told = F.array_join(F.transform(F.filter("targets", lambda t: t["affected"]), lambda t: F.concat_ws(":", t["target"], t["class_name"], t["severity"])), ",")
    return out.select("key", "fault", "global_class", "global_severity", "scope", F.size("targets").alias("targets"), told.alias("affected"))


def _customers(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 3).alias("state"), "c_nationkey")


def balanced_weights(spark, d):
    """Chances of every customer in the three modes; the nations of a segment are its groups, a nation's state follows its number."""
    out = None
    for mode in ("uniform", "state", "hybrid"):
        w = sampling.balanced_weights(_customers(spark, d), mode, "c_mktsegment", "state", "c_nationkey", 0.25).select(F.lit(mode).alias("mode"), "c_custkey", (F.col("weight") * 1e6).alias("per_million"))
        out = w if out is None else out.unionByName(w)
    return _rounded(out)


def balanced_draw(spark, d):
    """A hundred customers drawn by the chances of the hybrid mode."""
    return sampling.draw(sampling.balanced_weights(_customers(spark, d), "hybrid", "c_mktsegment", "state", "c_nationkey", 0.25), "c_custkey", 100, 3).select("c_custkey", "c_mktsegment")


def task_draw(spark, d):
    """Five hundred tasks, 70 in 100 of the chances on targets; lines 1 and 2 of an order are global tasks, others those of a target."""
    li = _t(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("task"), F.when(F.col("l_linenumber") <= 2, "global").otherwise("target").alias("family"), (F.col("l_linenumber") - 2).alias("target"),
        "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 10).alias("grp"),
    )
    w = sampling.task_weights(li, "family", "target", "l_returnflag", "l_linestatus", "grp", 0.7)
    return sampling.draw(w, "task", 500, 9).select("task", "family", "target")


HOUR = 3600.0


def _registry(spark, d) -> DataFrame:
    """Nations as sensors of the five kinds of events and others; some entries are unsound."""
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    n = _t(spark, d, "nation")
    return n.select(
        F.when(F.col("n_nationkey") < 5, F.element_at(kinds, F.col("n_nationkey").cast("int") + 1)).when(F.col("n_nationkey") == 9, F.lit(" ")).otherwise(F.when(F.col("n_nationkey") == 11, F.lit("CHINA")).otherwise(F.col("n_name"))).alias("sensor_id"),
        F.when(F.col("n_nationkey") == 4, " Baseline").when(F.col("n_nationkey") == 13, "other").alias("role"), F.col("n_name").alias("location"), F.element_at(F.array(*map(F.lit, ("X", "1", "norm", "w"))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("axis"),
        F.when(F.col("n_nationkey") % 6 == 5, "-1").otherwise("100").alias("rate"),
    )


def registry_check(spark, d):
    """Which entries of a registry are sound, and what is wrong with the others."""
    return _rounded(requests.registry_faults(_registry(spark, d)))


def window_reads(spark, d):
    """Requests made of orders, read from the events; an hour stands for a second."""
    k = "o_orderkey"
    asked = _t(spark, d, "orders").select(
        F.col(k).alias("request"), F.element_at(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view", "nobody", "CHINA"))), (F.col(k) % 7 + 1).cast("int")).alias("sensor"),
        F.element_at(F.array(*map(F.lit, ("", "Z", "magnitude", "q"))), (F.col(k) % 4 + 1).cast("int")).alias("axis"), F.expr(f"CASE WHEN {k} % 31 = 0 THEN 'soon' WHEN {k} % 29 = 0 THEN '-5' WHEN {k} % 5 > 0 THEN CAST({k} % 700 AS STRING) END").alias("start"),
        F.expr(f"CASE WHEN {k} % 37 = 0 THEN 'NaN' WHEN {k} % 41 = 0 THEN '0' ELSE CAST({k} % 62 AS STRING) || '.5' END").alias("duration"),
    )
    samples = _t(spark, d, "events").select(F.col("event_type").alias("sensor"), ((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200) / HOUR).alias("ts"), "value")
    got = requests.read_windows(requests.normal_requests(asked, requests.registry_faults(_registry(spark, d))), samples, preview=3)
    first = F.array_join(F.transform("preview", lambda v: F.round(v, 2).cast("decimal(12,2)").cast("string")), ",")
    return _rounded(got.withColumn("preview", first), 9)


def validation_export(spark, d):
    """The rows of the exported file as they are read back, with the reports that lie beside it."""
    from oscillar.plans import queries as monitoring

    arrays = windows.window_arrays(windows.sample_windows(_t(spark, d, "events"))).select("sensor", "win", "x").withColumns({"rate": F.lit(monitoring.RATE), "flags": F.when(F.size("x") < 60, "short_window")})
    reports = monitoring.sensor_labels(spark, d).filter("win % 5 <> 2").withColumn("rule_label", F.col("label"))
    folder = shared_dir(spark, "export")
    requests.export_validation(arrays, reports, monitoring.network_labels(spark, d), requests.registry_faults(_registry(spark, d)).filter("sensor_id IN ('click', 'error', 'purchase', 'signup', 'view')"), monitoring.REFERENCE, folder)
    kinds = "window_id long, sensor_id string, location string, role string, axis string, sampling_rate_hz double, time_s double, acceleration_g double, small_agent_label string, small_agent_confidence double, python_rule_label string, network_label string, quality_flags string"
    rows = spark.read.schema(kinds).option("header", True).csv(f"{folder}/validation_windows")
    lines = spark.read.schema("sensor string, win long").json(f"{folder}/agent_reports").select(F.col("sensor").alias("sensor_id"), F.col("win").alias("window_id"), F.lit(True).alias("reported"))
    return _rounded(rows.join(lines, ["sensor_id", "window_id"], "left").withColumns({"reported": F.coalesce("reported", F.lit(False)), "quality_flags": F.coalesce("quality_flags", F.lit("")), "network_label": F.coalesce("network_label", F.lit(""))}), 4)


def timebase_check(spark, d):
    """Times of recordings of 64 samples, one for each vector: sound ones, and ones that stand still, run at another rate or jitter by the vector's numbers."""
    k = F.col("vec_id")
    e = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("seq", "v"))
    shaken = F.when((k % 5 == 1) & (F.col("seq") == 40), -1.0).when(k % 5 == 3, F.col("v").cast("double") * 0.05).otherwise(F.col("v").cast("double") * 1e-4)
    at = (F.col("seq") * F.when(k % 5 == 2, 1.02).otherwise(1.0) + shaken) / 100.0
    rows = e.select("vec_id", "seq", at.alias("at")).filter((k % 5 != 4) | (F.col("seq") < 2))
    return _rounded(audits.timebase_faults(rows, ["vec_id"], F.lit(100.0)), 7)


def frame_concat(spark, d):
    """Lines of orders as frames of three layouts: two that differ in order and spelling, and one that is passed over; some values are no numbers."""
    li = _t(spark, d, "lineitem").selectExpr("IF(l_orderkey % 50 = 0, -1D, CAST(l_orderkey AS DOUBLE)) AS t", "IF(l_partkey % 40 = 7, double('NaN'), CAST(l_quantity AS DOUBLE)) AS x", "CAST(l_discount AS DOUBLE) AS y", "CAST(l_tax AS DOUBLE) AS z", "l_linenumber AS k")
    frames = [
        li.filter("k % 3 = 0").select(F.col("t").alias("Time"), F.col("x").alias("Acc X"), F.col("y").alias("Acc Y"), F.col("z").alias("Acc Z")),
        li.filter("k % 3 = 1").select(F.col("z").alias("acc_z"), F.col("x").alias("ACC-X"), F.col("t").alias("timestamp"), F.col("y").alias("accY")),
        li.filter("k % 3 = 2").select(F.col("t").alias("time"), F.col("x").alias("acc_x")),
    ]
    rows = selection.concatenated(frames)
    values = rows.columns[1:]
    return _rounded(rows.select("at", *(F.col(f"`{c}`").alias(selection.column_key(c)) for c in values), selection.axis_of(values, "norm").alias("norm"), selection.axis_of(values, "y").alias("axis_y"), selection.axis_of(values, "2").alias("axis_2")))


QUERIES = {f.__name__: f for f in (nested_fields, episode_labels, balanced_weights, balanced_draw, task_draw, registry_check, window_reads, validation_export, timebase_check, frame_concat)}

_DOCS = """
o AS (SELECT o_orderkey AS k, o_orderkey AS key, o_custkey, o_orderstatus = 'F' AS healthy, o_orderkey % 37 <> 11 AS ok FROM orders),
f AS (SELECT *, CASE WHEN ok THEN 'd' || k % 3 END AS dataset_id, CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END END AS split, CASE WHEN ok THEN 'g' || o_custkey END AS group_id,
  CASE WHEN ok THEN CASE WHEN k % 11 = 0 THEN 'representation_only' ELSE 'supervised' END END AS training_role, CASE WHEN k % 5 = 1 THEN 'damping_change' WHEN k % 23 = 9 THEN 'odd' END AS class_name,
  CASE WHEN k % 13 <> 0 THEN 'warning' END AS severity, CASE WHEN k % 19 = 5 THEN ['target_x'] WHEN k % 7 IN (1, 2) THEN ['1', 'target_3', (k % 6)::VARCHAR] ELSE [] END AS given, k % 17 = 3 OR k % 29 = 4 AS only_global FROM o)"""
_U = "('0x' || substr(sha256('{seed}' || chr(0) || {key}::VARCHAR), 1, 13))::BIGINT / 4503599627370496::DOUBLE"
_CUSTOMER = """
c AS (SELECT c_custkey, c_mktsegment AS m, c_nationkey % 3 AS s, c_nationkey AS n FROM customer),
d AS (SELECT count(DISTINCT m) AS d FROM c), g AS (SELECT m, count(DISTINCT n) AS g, count(DISTINCT s) AS t FROM c GROUP BY m), gs AS (SELECT m, s, count(DISTINCT n) AS gs FROM c GROUP BY m, s), r AS (SELECT m, s, n, count(*) AS r FROM c GROUP BY m, s, n),
w AS (SELECT c_custkey, m, 1.0::DOUBLE / d / g / r AS u, 1.0::DOUBLE / d / t / gs / r AS b FROM c JOIN g USING (m) JOIN gs USING (m, s) JOIN r USING (m, s, n), d)"""
_REGISTRY = """
n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN ['click', 'error', 'purchase', 'signup', 'view'][n_nationkey + 1] WHEN n_nationkey = 9 THEN NULL WHEN n_nationkey = 11 THEN 'CHINA' ELSE n_name END AS sensor_id, n_name, CASE n_nationkey WHEN 4 THEN 'baseline' WHEN 13 THEN 'other' ELSE 'target' END AS role,
  ['x', 'y', 'norm', NULL][n_nationkey % 4 + 1] AS axis, CASE WHEN n_nationkey % 6 = 5 THEN -1 ELSE 100 END::DOUBLE AS rate FROM nation),
reg AS (SELECT sensor_id, n_name AS location, role, axis, rate, CASE WHEN sensor_id IS NULL THEN 'no_id' WHEN count(*) OVER (PARTITION BY sensor_id) > 1 THEN 'duplicate_id' WHEN role = 'other' THEN 'unknown_role' WHEN axis IS NULL THEN 'unknown_axis' WHEN rate <= 0 THEN 'bad_rate' END AS fault FROM n)"""
ORACLE_SQL = {
    "nested_fields": f"WITH {_DOCS} SELECT key, dataset_id, split, CASE WHEN ok THEN group_id END AS group_id, training_role, CASE WHEN ok THEN CASE WHEN training_role = 'representation_only' THEN training_role WHEN healthy THEN 'healthy' ELSE 'changed::' || coalesce(class_name, 'unknown_anomaly') END END AS stratum, CASE WHEN ok THEN '' ELSE 'dataset_id,split,group_id,training_role' END AS missing FROM f",
    "episode_labels": f"""WITH {_DOCS},
n AS (SELECT *, CASE WHEN NOT list_contains(given, 'target_x') AND NOT list_contains(given, '0') THEN list_sort(list_distinct(list_transform(given, lambda x: replace(x, 'target_', '')::INT))) END AS hit, dataset_id = 'd2' AS unlocated FROM (SELECT *, given = ['target_x'] AS bad FROM f WHERE NOT list_contains(given, 'target_x'))
      UNION ALL BY NAME SELECT *, true AS bad, NULL::INT[] AS hit, dataset_id = 'd2' AS unlocated FROM f WHERE list_contains(given, 'target_x')),
q AS (SELECT *, CASE WHEN NOT ok THEN 'no_object' WHEN training_role = 'representation_only' THEN NULL WHEN coalesce(class_name, 'normal') = 'odd' THEN 'unknown_class' WHEN severity IS NULL AND NOT healthy THEN 'no_severity'
  WHEN hit IS NULL THEN 'unreadable_targets' WHEN only_global AND len(given) > 0 THEN 'targets_of_global_document' WHEN NOT only_global AND NOT healthy AND NOT unlocated AND len(given) = 0 THEN 'no_targets'
  WHEN NOT only_global AND healthy AND unlocated AND len(given) > 0 THEN 'targets_of_healthy_document' END AS fault, NOT only_global AND (healthy AND NOT unlocated OR NOT healthy AND len(given) > 0) AS located FROM n),
s AS (SELECT *, fault IS NULL AND training_role = 'supervised' AS sound FROM q)
SELECT key, fault, CASE WHEN sound THEN CASE WHEN healthy THEN 'normal' ELSE 'unknown_anomaly' END END AS global_class, CASE WHEN sound THEN CASE WHEN healthy THEN 'none' ELSE severity END END AS global_severity, CASE WHEN sound THEN CASE WHEN located THEN 'joint' ELSE 'global_only' END END AS scope,
  CASE WHEN sound THEN CASE WHEN located THEN 5 ELSE 0 END END::INT AS targets, CASE WHEN sound THEN CASE WHEN located AND NOT healthy THEN array_to_string(list_transform(hit, lambda x: x || ':' || coalesce(class_name, 'unknown_anomaly') || ':' || severity), ',') ELSE '' END END AS affected FROM s""",
    "balanced_weights": f"WITH {_CUSTOMER} SELECT mode, c_custkey, round(1e6 * CASE mode WHEN 'uniform' THEN u WHEN 'state' THEN b ELSE 0.25 * b + 0.75 * u END, 6) + 0 AS per_million FROM w, (VALUES ('uniform'), ('state'), ('hybrid')) AS m(mode)",
    "balanced_draw": f"WITH {_CUSTOMER} SELECT c_custkey, m AS c_mktsegment FROM w ORDER BY -ln(1 - {_U.format(seed=3, key='c_custkey')}) / (0.25 * b + 0.75 * u), c_custkey LIMIT 100",
    "task_draw": f"""WITH l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS task, CASE WHEN l_linenumber <= 2 THEN 'global' ELSE 'target' END AS family, l_linenumber - 2 AS target, l_returnflag AS d, l_linestatus AS s, l_suppkey % 10 AS g FROM lineitem),
gl AS (SELECT *, 0.3 / (SELECT count(DISTINCT d) FROM l WHERE family = 'global') / (SELECT count(DISTINCT s) FROM l x WHERE x.family = 'global' AND x.d = l.d) / (SELECT count(DISTINCT g) FROM l x WHERE x.family = 'global' AND x.d = l.d AND x.s = l.s) / count(*) OVER (PARTITION BY d, s, g) AS w FROM l WHERE family = 'global'),
ta AS (SELECT *, 0.7 / (SELECT count(DISTINCT target) FROM l WHERE family = 'target') / (SELECT count(DISTINCT s) FROM l x WHERE x.family = 'target' AND x.target = l.target) / (SELECT count(DISTINCT d) FROM l x WHERE x.family = 'target' AND x.target = l.target AND x.s = l.s)
  / (SELECT count(DISTINCT g) FROM l x WHERE x.family = 'target' AND x.target = l.target AND x.s = l.s AND x.d = l.d) / count(*) OVER (PARTITION BY target, s, d, g) AS w FROM l WHERE family = 'target')
SELECT task, family, target FROM (SELECT * FROM gl UNION ALL SELECT * FROM ta) ORDER BY -ln(1 - {_U.format(seed=9, key='task')}) / w::DOUBLE, task LIMIT 500""",
    "registry_check": f"WITH {_REGISTRY} SELECT sensor_id, location, role, axis, rate, fault FROM reg",
    "window_reads": f"""WITH {_REGISTRY},
a AS (SELECT o_orderkey AS request, ['click', 'error', 'purchase', 'signup', 'view', 'nobody', 'CHINA'][o_orderkey % 7 + 1] AS sensor, ['', 'z', 'norm', NULL][o_orderkey % 4 + 1] AS axis, CASE WHEN o_orderkey % 31 = 0 THEN 'soon' WHEN o_orderkey % 29 = 0 THEN '-5' WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 700)::VARCHAR END AS st,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_orderkey % 62 + 0.5 END::DOUBLE AS dur FROM orders),
r AS (SELECT request, a.sensor, dur, try_cast(st AS DOUBLE) AS s, CASE WHEN dur IS NULL THEN 'duration_not_finite' WHEN st = 'soon' THEN 'start_not_finite' WHEN st = '-5' THEN 'start_negative' WHEN dur <= 0 THEN 'duration_not_positive' WHEN dur > 60 THEN 'duration_over_cap' WHEN reg.axis IS NULL THEN 'unknown_sensor' WHEN a.axis IS NULL THEN 'unknown_axis' END AS fault
      FROM a LEFT JOIN reg ON reg.sensor_id = a.sensor AND reg.fault IS NULL),
e AS (SELECT event_type AS sensor, (epoch_us(ts) / 1e6 - 1704067200) / 3600 AS t, value FROM events), l AS (SELECT sensor, max(t) AS last FROM e GROUP BY sensor),
m AS (SELECT request, value, row_number() OVER (PARTITION BY request ORDER BY t, value) AS turn FROM r JOIN l USING (sensor) JOIN e ON e.sensor = r.sensor AND t >= coalesce(s, last - dur) AND (s IS NULL OR t < s + dur) WHERE fault IS NULL),
g AS (SELECT request, count(*) AS n, avg(value) AS mean, sqrt(avg(value * value)) AS rms, min(value) AS low, max(value) AS high, string_agg(round(value, 2)::DECIMAL(12, 2)::VARCHAR, ',' ORDER BY turn) FILTER (turn <= 3) AS preview FROM m GROUP BY request)
SELECT request, CASE WHEN fault IS NOT NULL THEN 'bad_request' WHEN n > 0 THEN 'ok' ELSE 'no_samples' END AS status, fault, coalesce(n, 0) AS n, round(mean, 9) + 0 AS mean, round(rms, 9) + 0 AS rms, round(low, 9) + 0 AS low, round(high, 9) + 0 AS high, preview, false AS thinned FROM r LEFT JOIN g USING (request)""",
    "timebase_check": """WITH e AS (SELECT vec_id, i, (i * CASE WHEN vec_id % 5 = 2 THEN 1.02 ELSE 1 END::DOUBLE + CASE WHEN vec_id % 5 = 1 AND i = 40 THEN -1 WHEN vec_id % 5 = 3 THEN embedding[i + 1]::DOUBLE * 0.05::DOUBLE ELSE embedding[i + 1]::DOUBLE * 1e-4 END) / 100 AS t FROM embeddings, unnest(range(0, 64)) AS r(i) WHERE vec_id % 5 <> 4 OR i < 2),
s AS (SELECT vec_id, t - lag(t) OVER (PARTITION BY vec_id ORDER BY i) AS step FROM e),
p AS (SELECT vec_id, count(*) AS n, coalesce(bool_and(step > 0), false) AS rising, quantile_cont(step, 0.5) AS m, min(step) AS lo, max(step) AS hi FROM s GROUP BY vec_id),
q AS (SELECT *, 1 / m AS rate, greatest(hi - m, m - lo) AS jitter FROM p)
SELECT vec_id, n, round(CASE WHEN rising THEN rate END, 7) AS rate, round(CASE WHEN rising THEN jitter END, 7) + 0 AS jitter, CASE WHEN n < 3 THEN 'too_few_times' WHEN NOT rising THEN 'not_increasing' WHEN abs(rate - 100) > greatest(0.01 * greatest(abs(rate), 100), 0.1) THEN 'rate_differs' WHEN jitter > greatest(1e-9, 0.01 * m) THEN 'jitter' END AS fault FROM q""",
    "frame_concat": "SELECT l_orderkey::DOUBLE AS at, round(l_quantity::DOUBLE, 6) AS accx, round(l_discount::DOUBLE, 6) AS accy, round(l_tax::DOUBLE, 6) AS accz, round(sqrt(l_quantity::DOUBLE ** 2 + l_discount::DOUBLE ** 2 + l_tax::DOUBLE ** 2), 6) AS norm, round(l_discount::DOUBLE, 6) AS axis_y, round(l_tax::DOUBLE, 6) AS axis_2 FROM lineitem WHERE l_linenumber % 3 < 2 AND l_orderkey % 50 <> 0 AND l_partkey % 40 <> 7",
}
