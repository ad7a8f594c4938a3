"""Queries that write a table of the test data to a file format in the shared folder and read it back, with SQL on the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oscillar.operators import corpus
from oscillar.sources import arrays, catalog, episodes, framed
from oscillar.sources.shared import shared_dir


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _matrix_files(spark, d, kind: str) -> DataFrame:
    """vec_id, place and number of every number of `embeddings`, by way of files of that kind."""
    numbers = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "value"))
    path = shared_dir(spark, f"arrays-{kind}")
    arrays.write_arrays(numbers, path, kind)
    back = arrays.read_arrays(spark, path, {"id": ("signal", 0), "k": ("signal", 1), "value": ("signal", 2)}, most=10_000)
    return back.select(F.col("id").cast("long").alias("id"), F.col("k").cast("int").alias("k"), "value")


def npz_files(spark, d):
    """NPZ matrices, a sample after the other, read in ranges of 10,000."""
    return _matrix_files(spark, d, "npz")


def mat_files(spark, d):
    """MAT matrices, a channel after the other, read in ranges of 10,000."""
    return _matrix_files(spark, d, "mat")


def _store(spark, d) -> str:
    """A store of episodes of 18 vectors each; the last is incomplete, others lack a rate, an id, a mask or sound metadata."""
    e = _t(spark, d, "embeddings").select(F.expr("vec_id DIV 18").alias("n"), "vec_id", "embedding")
    whole = e.groupBy("n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])).alias("values"))
    rows = whole.select(
        F.expr("IF(n % 11 = 5, NULL, concat('e', n))").alias("episode_id"), F.expr("concat('d', n % 3)").alias("dataset"), F.expr("IF(n % 4 = 0, 'validation', 'train')").alias("split"),
        F.expr("IF(n % 7 = 3, 0D, 64D)").alias("sample_rate_hz"), "values", F.expr("array_repeat(true, IF(n % 13 = 2, 17, 18))").alias("axis_mask"),
        F.expr("transform(sequence(1, size(values) DIV 3), i -> i % 50 <> 0)").alias("sample_mask"), F.expr("""IF(n % 17 = 4, '[', concat('{"n": ', n, '}'))""").alias("metadata"),
    )
    path = shared_dir(spark, "episodes")
    episodes.save_episodes(rows, path)
    return path


def episode_report(spark, d):
    """What a store holds and what was skipped, by dataset, split and reason."""
    return episodes.build_report(spark, _store(spark, d))


def stored_episodes(spark, d):
    """Sum and missing samples of each board and axis of the stored episodes."""
    back = episodes.load_episodes(spark, _store(spark, d))
    one = back.select("episode_id", F.get_json_object("metadata", "$.n").cast("long").alias("n"), F.posexplode("values").alias("at", "v"), F.col("sample_mask"))
    one = one.withColumn("board", F.expr("at DIV 192")).withColumn("axis", F.expr("(at % 192) DIV 64")).withColumn("there", F.element_at("sample_mask", (F.col("board") * 64 + F.col("at") % 64 + 1).cast("int")))
    total = one.groupBy("episode_id", "n", "board", "axis").agg(F.sum(F.col("v").cast("double")).alias("total"), F.sum((~F.col("there")).cast("long")).alias("missing"))
    return _rounded(total)


def stored_profile(spark, d):
    """The healthy profile as it is after it was saved and loaded."""
    path = shared_dir(spark, "profile")
    episodes.save_profile(corpus.healthy_profile(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity", "l_suppkey"), path)
    return _rounded(episodes.load_profile(spark, path))


LAYOUT = framed.Layout(samples=4, packet=21, number="<i8")  # ids of any size are among the numbers


def _frames(spark, d) -> DataFrame:
    """Frames of four events each, a file for every kind and ten days; some late, some without a time."""
    e = _t(spark, d, "events").withColumn("file", F.concat("event_type", F.lit("-"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 864_000), F.lit(".dat")))
    n = F.row_number().over(Window.partitionBy("file").orderBy("ts", "event_id")) - 1
    e = e.select("file", F.expr("event_id % 2000 - 1000").alias("x"), F.col("user_id").alias("y"), F.round("value").alias("z"), n.alias("n")).withColumn("frame", F.expr("CAST(n DIV 4 AS LONG)"))
    frames = e.groupBy("file", "frame").agg(F.array_sort(F.collect_list(F.struct("n", F.array(*(F.col(c).cast("long") for c in "xyz")).alias("v")))).alias("s")).filter(F.size("s") == 4)
    time = F.when(F.col("frame") % 11 == 5, float("nan")).otherwise(F.col("frame") + 1 + F.when(F.col("frame") % 7 == 3, 0.4).otherwise(0.0))
    return frames.select("file", "frame", time.cast("double").alias("time"), F.flatten(F.transform("s", lambda v: v["v"])).alias("data"))


def framed_samples(spark, d):
    """Samples of framed files, whose frames run on across packets."""
    path = shared_dir(spark, "framed")
    framed.write_framed(_frames(spark, d), path, LAYOUT).write.format("noop").mode("append").save()
    return _rounded(framed.read_framed(spark, path, 4, number=LAYOUT.number, packet=LAYOUT.packet), 5)


def framed_range(spark, d):
    """The same, of the fifth to tenth second of each file."""
    path = shared_dir(spark, "framed")
    framed.write_framed(_frames(spark, d), path, LAYOUT).write.format("noop").mode("append").save()
    return _rounded(framed.read_framed(spark, path, 4, number=LAYOUT.number, packet=LAYOUT.packet, low=5.0, high=10.5), 5)


def framed_stream(spark, d):
    """The same samples as a stream that is stopped after half of the files and goes on with the others."""
    path, out, marks = (shared_dir(spark, n) for n in ("framed-in", "framed-out", "framed-marks"))
    frames = _frames(spark, d)
    for half in (0, 1):
        framed.write_framed(frames.filter(F.pmod(F.xxhash64("file"), F.lit(2)) == half), path, LAYOUT).write.format("noop").mode("append").save()
        stream = framed.stream_framed(spark, path, 4, number=LAYOUT.number, packet=LAYOUT.packet)
        stream.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    return _rounded(spark.read.parquet(out), 5)


def _devices(spark, d) -> DataFrame:
    """Status documents, one for each supplier; in every third the components lie in a list of devices, some texts are torn."""
    k = "s_suppkey"
    acc = f"named_struct('c_type', 0, 'enable', {k} % 4 <> 1, 'dim', 3, 'odr', 26667D, 'measodr', IF({k} % 2 = 0, 26667D + {k}, 0D), 'samples_per_ts', named_struct('val', 1000 + {k} % 7), 'data_type', 'int16_t', 'sensitivity', 0.000488D, 'unit', 'g')"
    fft = f"named_struct('c_type', 1, 'enable', true, 'fft_length', 512 * ({k} % 3 + 1), 'data_type', 'float')"
    motor = f"named_struct('c_type', 3, 'enable', {k} % 5 = 0, 'dim', 4, 'odr', 10D, 'samples_per_ts', 0, 'data_type', IF({k} % 2 = 0, 'float', 'bits'))"
    each = f"array(to_json(named_struct('iis3dwb_acc', {acc})), to_json(named_struct('iis3dwb_FFT', {fft})), to_json(named_struct('motor_ctrl', {motor})))"
    doc = F.expr(f"concat(IF({k} % 3 = 0, '{{\"devices\": [{{\"components\": [', '{{\"components\": ['), array_join({each}, ', '), IF({k} % 3 = 0, ']}}]}}', ']}}'))")
    return _t(spark, d, "supplier").select(k, F.when(F.col(k) % 11 == 7, F.substring(doc, 1, 40)).otherwise(doc).alias("json"))


def component_catalog(spark, d):
    """All components of the devices, with the size of their frames."""
    return _rounded(catalog.components(_devices(spark, d), ["s_suppkey"]))


def active_sensors(spark, d):
    """The accelerometers that are on, by device."""
    return catalog.listed(catalog.components(_devices(spark, d), ["s_suppkey"]), "sensor", "ACC", True).select("s_suppkey", "component", "frame_bytes")


QUERIES = {f.__name__: f for f in (npz_files, mat_files, episode_report, stored_episodes, stored_profile, framed_samples, framed_range, framed_stream, component_catalog, active_sensors)}

_NUMBERS = "SELECT vec_id AS id, k::INT AS k, embedding[k + 1]::DOUBLE AS value FROM embeddings, unnest(range(0, 64)) AS r(k)"
_WHY = "CASE WHEN n % 11 = 5 THEN 'no_id' WHEN vectors < 18 THEN 'incomplete_boards' WHEN n % 13 = 2 THEN 'masks_do_not_match' WHEN n % 7 = 3 THEN 'no_sample_rate' WHEN n % 17 = 4 THEN 'metadata_no_object' ELSE 'stored' END"
_EPISODES = f"e AS (SELECT *, {_WHY} AS outcome FROM (SELECT vec_id // 18 AS n, count(*) AS vectors FROM embeddings GROUP BY 1))"
_FRAMED = """
e AS (SELECT event_type || '-' || floor(epoch(ts) / 864000)::BIGINT || '.dat' AS file, event_id % 2000 - 1000 AS x, user_id AS y, round(value) AS z, event_id, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) - 1 AS seq, count(*) OVER (PARTITION BY file) AS total FROM e),
f AS (SELECT DISTINCT file, seq // 4 AS frame, CASE WHEN (seq // 4) % 11 <> 5 THEN seq // 4 + 1 + CASE WHEN (seq // 4) % 7 = 3 THEN 0.4::DOUBLE ELSE 0 END END AS t FROM n WHERE seq < total // 4 * 4),
g AS (SELECT *, coalesce(t, lag(t) OVER w + 1) AS fixed FROM f WINDOW w AS (PARTITION BY file ORDER BY frame)),
h AS (SELECT *, coalesce(lag(fixed) OVER w, fixed - 1) AS before FROM g WINDOW w AS (PARTITION BY file ORDER BY frame)),
b AS (SELECT *, CASE WHEN t IS NULL OR fixed - before <= 1.33 THEN before ELSE fixed - 1 END AS begins FROM h),
s AS (SELECT file, seq, begins + (fixed - begins) * (seq % 4 + 1) / 4 AS ts, x * (t IS NOT NULL)::INT * 4.88e-4 AS x, y * (t IS NOT NULL)::INT * 4.88e-4 AS y, z * (t IS NOT NULL)::INT * 4.88e-4 AS z FROM n JOIN b USING (file) WHERE seq // 4 = frame)"""
_SAMPLES = f"WITH {_FRAMED} SELECT file, seq, {', '.join(f'round({c}, 5) + 0 AS {c}' for c in ('ts', 'x', 'y', 'z'))} FROM s"
_COMPONENTS = """c AS (SELECT s_suppkey, 0 AS place, 'iis3dwb_acc' AS component, 'acc' AS subtype, 'sensor' AS kind, s_suppkey % 4 <> 1 AS active, 3 AS dim, CASE WHEN s_suppkey % 2 = 0 THEN 26667 + s_suppkey ELSE 26667 END::DOUBLE AS rate, 1000 + s_suppkey % 7 AS samples_per_stamp, 'int16_t' AS number, (1000 + s_suppkey % 7) * 6 + 8 AS frame_bytes, 0.000488::DOUBLE AS sensitivity, 'g' AS unit FROM supplier
UNION ALL SELECT s_suppkey, 1, 'iis3dwb_FFT', 'fft', 'algorithm', true, 512 * (s_suppkey % 3 + 1), NULL, 0, 'float', 2048 * (s_suppkey % 3 + 1), NULL, NULL FROM supplier
UNION ALL SELECT s_suppkey, 2, 'motor_ctrl', 'ctrl', 'actuator', s_suppkey % 5 = 0, 4, 10, 0, CASE WHEN s_suppkey % 2 = 0 THEN 'float' ELSE 'bits' END, CASE WHEN s_suppkey % 2 = 0 THEN 16 END, NULL, NULL FROM supplier)"""
ORACLE_SQL = {
    "npz_files": _NUMBERS,
    "mat_files": _NUMBERS,
    "episode_report": f"WITH {_EPISODES} SELECT 'd' || n % 3 AS dataset, CASE WHEN n % 4 = 0 THEN 'validation' ELSE 'train' END AS split, outcome, count(*) AS n FROM e GROUP BY ALL",
    "stored_episodes": f"""WITH {_EPISODES}, v AS (SELECT n, (vec_id % 18) // 3 AS board, vec_id % 3 AS axis, k, embedding[k + 1]::DOUBLE AS v FROM embeddings JOIN e ON vec_id // 18 = n AND outcome = 'stored', unnest(range(0, 64)) AS r(k))
SELECT 'e' || n AS episode_id, n, board, axis, round(sum(v), 6) + 0 AS total, count(*) FILTER ((board * 64 + k + 1) % 50 = 0) AS missing FROM v GROUP BY n, board, axis""",
    "framed_samples": _SAMPLES,
    "framed_range": f"{_SAMPLES} WHERE s.ts >= 5.0 AND s.ts < 10.5",
    "framed_stream": _SAMPLES,
    "component_catalog": f"WITH {_COMPONENTS} SELECT s_suppkey, place, component, subtype, kind, active, dim::INT AS dim, rate, samples_per_stamp::INT AS samples_per_stamp, number, frame_bytes::INT AS frame_bytes, sensitivity, unit FROM c WHERE s_suppkey % 11 <> 7",
    "active_sensors": f"WITH {_COMPONENTS} SELECT s_suppkey, component, frame_bytes::INT AS frame_bytes FROM c WHERE s_suppkey % 11 <> 7 AND kind = 'sensor' AND active",
}
