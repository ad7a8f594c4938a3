"""Queries on recordings of several boards and on modal figures, each with the SQL that gives the same rows.

Vectors of `embeddings` stand for the samples of boards: 18 in a row are a recording of six boards with three axes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscillar.functions.wideband import Grid
from oscillar.operators import clocks, modal, spectra, transients, wideband


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: 64 samples in a second; a grid that meets neither the bins nor the frames of the spectra.
GRID = Grid(fs=64.0, seconds=1.0, max_hz=40.0, bins=9, times=4)


def _recordings(spark, d):
    """Recordings in which one or two samples of a board are missing."""
    e = _t(spark, d, "embeddings").select(F.expr("vec_id DIV 18").alias("recording"), F.expr("(vec_id % 18) DIV 3").alias("board"), (F.col("vec_id") % 3).alias("axis"), "embedding")
    gone = "transform(embedding, (v, k) -> IF((7 * k + 5 * board + recording) % 61 = 0, CAST(NULL AS DOUBLE), CAST(v AS DOUBLE)))"
    return e.select("recording", "board", "axis", F.expr(gone).alias("x"))


def complex_grid(spark, d):
    """Real and imaginary part of every cell of the common grid."""
    g = wideband.complex_grids(_recordings(spark, d), GRID)
    cells = g.select("recording", "board", "axis", F.posexplode(F.arrays_zip("re", "im")).alias("at", "c"))
    return _rounded(cells.select("recording", "board", "axis", F.expr(f"CAST(at DIV {GRID.times} AS INT)").alias("bin"), F.expr(f"CAST(at % {GRID.times} AS INT)").alias("moment"), "c.re", "c.im"))


def wideband_features(spark, d):
    """All channels of every cell; every third recording isn't in step, board 5 measures up to 20 Hz."""
    rows = _recordings(spark, d)
    boards = rows.select("recording", "board").distinct().withColumn("synchronized", F.col("recording") % 3 != 0).withColumn("usable_hz", F.when(F.col("board") == 5, 20.0))
    return _rounded(wideband.feature_cells(wideband.wideband_features(rows, boards, GRID), GRID), 5)


def smoothed_grid(spark, d):
    """Vectors as grids of 8 x 8 cells, averaged over boxes, and as rows of 64, averaged over five with zeros beyond the ends."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    boxed = wideband.smoothed_grids(e, ["id"], 8, (3, 5)).select("id", F.posexplode("x").alias("at", "boxed"))
    moving = wideband.smoothed_grids(e, ["id"], 64, (1, 5), "zero").select("id", F.posexplode("x").alias("at", "moving"))
    return _rounded(boxed.join(moving, ["id", "at"]))


#: six hours from sample to sample, ten days to a window.
CLOCK_RATE, CLOCK_SECONDS = 1 / 21_600, 864_000.0


def clock_windows(spark, d):
    """Events as samples of five sensors each of ten groups: the last ten days that all of a group's sensors have, on one grid."""
    e = _t(spark, d, "events").select((F.col("user_id") % 10).alias("group"), F.col("event_type").alias("sensor"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "value")
    w = clocks.latest_windows(e, CLOCK_RATE, CLOCK_SECONDS, 5, most_missing=0.4, most_skew_ms=2e8)
    rows = w.select(F.col("group").alias("grp"), "sensor", "skew_ms", "valid", F.array_join("notes", ",").alias("notes"), F.posexplode("x").alias("k", "value"))
    return _rounded(rows, 3)


def capture_alignment(spark, d):
    """Six vectors in a row are a capture; ends differ by some samples, some are unknown or of an unsound clock."""
    e = _t(spark, d, "embeddings").select(
        F.expr("vec_id DIV 6").alias("capture"), (F.col("vec_id") % 6).alias("slot"), F.lit(64.0).alias("rate"), F.col("embedding").cast("array<double>").alias("x"), (F.expr("2000D + vec_id DIV 6")).alias("completed"),
        F.expr("IF(vec_id % 53 = 7, CAST(NULL AS DOUBLE), 1000D + vec_id DIV 6 + (vec_id * 37 % 18) / 64D + 0.003D)").alias("ends"), (F.col("vec_id") % 31 != 4).alias("monotonic"),
        F.element_at(F.array(*map(F.lit, clocks.ALIGNED_MODES)), (F.col("vec_id") % 2 + 1).cast("int")).alias("mode"),
    )
    c = clocks.finalized_captures(e, 0.75)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return _rounded(c.select("capture", "slot", F.element_at("x", 1).alias("head"), F.element_at("x", -1).alias("tail"), total.alias("total"), F.size("x").alias("n"), "short", "start", "finish", "trim_s", "skew_ms", "alignment", "sound"))


def board_clock(spark, d):
    """Three vectors in a row are the axes of a board whose clock runs at 64 samples while that of the reference runs at 50."""
    e = _t(spark, d, "embeddings").select(F.expr("vec_id DIV 3").alias("board"), (F.col("vec_id") % 3).alias("axis"), F.col("embedding").cast("array<double>").alias("v"))
    axis = lambda k: F.max(F.when(F.col("axis") == k, F.col("v")))
    b = e.groupBy("board").agg(axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z")).withColumns({"rate": F.lit(64.0), "reference_rate": F.lit(50.0)})
    b = b.withColumn("x", F.expr("transform(x, (v, k) -> IF(board % 2 = 0 AND k = board % 60, CAST(NULL AS DOUBLE), v))"))
    c = clocks.reference_clock(b.filter("z IS NOT NULL"), ["board"], ["x", "y", "z"], 1.0)
    return _rounded(c.select("board", F.posexplode(F.arrays_zip("x", "y", "z")).alias("k", "s")).select("board", "k", "s.x", "s.y", "s.z"))


def resampled_windows(spark, d):
    """Vectors at 25 instead of 64 samples a second, in which every fifth lacks samples."""
    e = _t(spark, d, "embeddings").select("vec_id", F.expr("transform(embedding, (v, k) -> IF(vec_id % 5 = 0 AND (k + vec_id) % 40 = 7, CAST(NULL AS DOUBLE), CAST(v AS DOUBLE)))").alias("x"))
    return _rounded(transients.resampled_windows(e, "vec_id", "x", 64.0, 25.0, 28).select("id", F.posexplode("x").alias("k", "value")))


MODAL_RATE, MODAL_BANDS = 32.0, ((0.5, 2.0), (2.0, 5.0), (5.0, 10.0), (10.0, 16.0), (10.0, 10.4))


def _densities(spark, d):
    """Two vectors in a row are the samples of an axis, six of a board, 36 of a recording; some samples are missing."""
    e = _t(spark, d, "embeddings").select(F.expr("vec_id DIV 36").alias("recording"), F.expr("(vec_id DIV 6) % 6").alias("board"), F.expr("(vec_id % 6) DIV 2").alias("axis"), "vec_id", "embedding")
    x = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]))
    rows = e.groupBy("recording", "board", "axis").agg(x.cast("array<double>").alias("x"))
    rows = rows.withColumn("x", F.expr("transform(x, (v, k) -> IF((k + recording) % 50 = 9, CAST(NULL AS DOUBLE), v))"))
    boards = rows.select("recording", "board").distinct().withColumn("usable_hz", F.when(F.col("board") == 4, 10.0)).withColumn("calibrated", F.col("board") != 3)
    return modal.axis_densities(rows, MODAL_RATE), boards


def modal_peaks(spark, d):
    """Frequency, damping and prominence of the modes of every board."""
    return _rounded(modal.modal_peaks(*_densities(spark, d), MODAL_RATE, low=1.0, high=14.0), 5)


def physics_features(spark, d):
    """Figures of every axis, band energies and relations to the reference board."""
    return _rounded(modal.physics_features(*_densities(spark, d), MODAL_RATE, MODAL_BANDS), 4)


def complex_assurance(spark, d):
    """Vectors as complex shapes of 32 channels; even ones are measured, odd ones modelled, pairs lie within 0.75 Hz."""
    e = _t(spark, d, "embeddings").select(
        F.expr("vec_id DIV 100").alias("grp"), F.col("vec_id").alias("id"), F.expr("(vec_id * 17 % 101) * 0.25D").alias("frequency"),
        F.expr("transform(filter(embedding, (v, k) -> k % 2 = 0), v -> CAST(v AS DOUBLE))").alias("re"), F.expr("transform(filter(embedding, (v, k) -> k % 2 = 1), v -> CAST(v AS DOUBLE))").alias("im"),
    )
    return _rounded(modal.complex_assurance(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), 0.75))


def distinct_peaks(spark, d):
    """Peaks of every vector's averaged density, refined between bins, with the rms of their band and their phase."""
    return _rounded(spectra.peaks_of(_t(spark, d, "embeddings"), "vec_id", "embedding", 64.0, resolution=4.0), 4)


def spectrum_report(spark, d):
    """How far density and samples agree, whether two peaks compete and which one counts, for every vector."""
    return _rounded(spectra.spectrum_reports(_t(spark, d, "embeddings"), "vec_id", "embedding", 64.0, resolution=4.0), 5)


def filtered_windows(spark, d):
    """Vectors at 128 samples a second through filters of seven kinds, named in several ways; some can't be made."""
    names = ["low pass", "HP", "bandpass", "notch", "50Hz", "mains-60", "raw", "comb", "lowpass"]
    e = _t(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.element_at(F.array(*map(F.lit, names)), (F.col("vec_id") % 9 + 1).cast("int")).alias("filter"), F.lit(5.0).alias("low_hz"),
        F.when(F.col("vec_id") % 9 == 8, 64.0).otherwise(20.0).alias("high_hz"), F.lit(30.0).alias("notch_hz"), F.lit(None).cast("double").alias("width_hz"), F.when(F.col("vec_id") % 2 == 0, 2.0).alias("filter_order"),
    )
    out = spectra.filtered_windows(e, ["id"], 128.0)
    return _rounded(out.select("id", "kind", "fault", F.explode_outer(F.transform("x", lambda v, k: F.struct(k.alias("k"), v.alias("v")))).alias("s")).select("id", "kind", "fault", F.col("s.k").alias("k"), F.col("s.v").alias("value")))


QUERIES = {f.__name__: f for f in (complex_grid, wideband_features, smoothed_grid, clock_windows, capture_alignment, board_clock, resampled_windows, modal_peaks, physics_features, complex_assurance, distinct_peaks, spectrum_report, filtered_windows)}


def _polyphase(name: str, source: str, up: int, down: int, n: int, ends: str) -> str:
    """CTEs with name(id, m, y): the rows of source(id, i, x), i from 0 to n - 1, at up / down of the rate."""
    slow = max(up, down)
    half = 10 * slow
    pad = half // up + 1
    beyond = "CASE WHEN i < 0 THEN x0 + (x1 - x0) / {w} * i ELSE x1 + (x1 - x0) / {w} * (i - {w}) END".format(w=n - 1) if ends == "line" else "0"
    return f"""
{name}_h0 AS (SELECT j, CASE WHEN j = 0 THEN 1 ELSE sin(pi() * j / {slow}) / (pi() * j / {slow}) END * sum(pow(pow(2.5 * sqrt(1 - (j / {half}::DOUBLE) ** 2), k) / factorial(k::INT), 2)) AS h FROM range(-{half}, {half} + 1) AS a(j), range(0, 30) AS b(k) GROUP BY j),
{name}_h AS (SELECT j, h / (SELECT sum(h) FROM {name}_h0) * {up} AS h FROM {name}_h0),
{name}_e AS (SELECT id, max(x) FILTER (i = 0) AS x0, max(x) FILTER (i = {n - 1}) AS x1 FROM {source} GROUP BY id),
{name}_w AS (SELECT id, i, x FROM {source} UNION ALL SELECT id, i, {beyond} FROM {name}_e, range(-{pad}, {n + pad}) AS a(i) WHERE i < 0 OR i >= {n}),
{name} AS (SELECT id, m, sum(x * h) AS y FROM {name}_w, range(0, {-(-n * up // down)}) AS b(m) JOIN {name}_h ON j = m * {down} - i * {up} GROUP BY id, m)"""


def _bridged(source: str, name: str) -> str:
    """CTEs with name(id, i, x): source(id, i, v) with lines over null samples."""
    return f"""
{name}_n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni
  FROM {source} WINDOW b AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT id, i, coalesce(v, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END) AS x FROM {name}_n)"""


_GRID = """
s0 AS (SELECT vec_id, vec_id // 18 AS recording, (vec_id % 18) // 3 AS board, vec_id % 3 AS axis, i, CASE WHEN (7 * i + 5 * ((vec_id % 18) // 3) + vec_id // 18) % 61 <> 0 THEN embedding[i + 1]::DOUBLE END AS v FROM embeddings, unnest(range(0, 64)) AS r(i)),
s1 AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni
       FROM s0 WINDOW b AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s2 AS (SELECT vec_id, i, coalesce(v, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END) AS x FROM s1),
valid AS (SELECT vec_id, recording, board, axis, avg((v IS NOT NULL)::INT) AS share FROM s0 GROUP BY ALL),
dft AS (SELECT vec_id, t, k, sum(x * w * cos(2 * pi() * k * j / 32)) / 16 AS re, -sum(x * w * sin(2 * pi() * k * j / 32)) / 16 AS im
        FROM (SELECT vec_id, t, i - 8 * t AS j, x, 0.5 - 0.5 * cos(2 * pi() * (i - 8 * t) / 32) AS w FROM s2, range(0, 5) AS q(t) WHERE i >= 8 * t AND i < 8 * t + 32), range(0, 17) AS p(k) GROUP BY ALL),
byf AS (SELECT lo.vec_id, f, lo.t, CASE WHEN f = 0 OR f > 6 THEN 0 ELSE lo.re * (1 - part) + hi.re * part END AS re, CASE WHEN f = 0 OR f > 6 THEN 0 ELSE lo.im * (1 - part) + hi.im * part END AS im
        FROM (SELECT f, least(floor(f * 2.5::DOUBLE), 15)::INT AS k, f * 2.5::DOUBLE - floor(f * 2.5::DOUBLE) AS part FROM range(0, 9) AS g(f)) JOIN dft lo USING (k) JOIN dft hi ON hi.vec_id = lo.vec_id AND hi.t = lo.t AND hi.k = lo.k + 1),
cell AS (SELECT lo.vec_id, lo.f, m, lo.re * (1 - part) + hi.re * part AS re, lo.im * (1 - part) + hi.im * part AS im
         FROM (SELECT m, least(floor(p), 3)::INT AS t, p - least(floor(p), 3) AS part FROM (SELECT m, (least(greatest(m / 3::DOUBLE, 0.25), 0.75) - 0.25) / 0.125 AS p FROM range(0, 4) AS h(m)))
         JOIN byf lo USING (t) JOIN byf hi ON hi.vec_id = lo.vec_id AND hi.f = lo.f AND hi.t = lo.t + 1)"""
_DENSITY = f"""
s0 AS (SELECT vec_id // 2 AS id, (vec_id % 2) * 64 + i AS i, CASE WHEN ((vec_id % 2) * 64 + i + vec_id // 36) % 50 <> 9 THEN embedding[i + 1]::DOUBLE END AS v FROM embeddings, unnest(range(0, 64)) AS r(i)),
ax AS (SELECT id, id // 18 AS recording, (id // 3) % 6 AS board, id % 3 AS axis, count(v) AS n, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak, avg(v) AS mean, max(i) + 1 AS len FROM s0 GROUP BY id),
mom AS (SELECT id, avg((v - mean) ** 2) AS m2, avg((v - mean) ** 4) AS m4 FROM s0 JOIN ax USING (id) GROUP BY id),
{_bridged("s0", "src")},
seg AS (SELECT id, s, i - 32 * s AS j, x FROM src JOIN ax USING (id), range(0, 3) AS q(s) WHERE i >= 32 * s AND i < 32 * s + 64 AND 32 * s + 64 <= len),
lin AS (SELECT id, s, avg(x) AS m, sum((j - 31.5) * x) / sum((j - 31.5) ** 2) AS b FROM seg GROUP BY id, s),
res AS (SELECT id, s, j, (x - m - b * (j - 31.5)) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS v FROM seg JOIN lin USING (id, s)),
den0 AS (SELECT id, s, k, (sum(v * cos(2 * pi() * k * j / 64)) ** 2 + sum(v * sin(2 * pi() * k * j / 64)) ** 2) / (32 * 24) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM res, range(0, 33) AS q(k) GROUP BY id, s, k),
den AS (SELECT id, recording, board, axis, k, k * 0.5::DOUBLE AS hz, avg(p) AS p FROM den0 JOIN ax USING (id) GROUP BY ALL)"""
_PEAKS = """
x0 AS (SELECT vec_id AS id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, unnest(range(0, 64)) AS r(i)),
sg AS (SELECT id, s, i - 8 * s AS j, (x - avg(x) OVER (PARTITION BY id, s)) * (0.5 - 0.5 * cos(2 * pi() * (i - 8 * s) / 16)) AS v FROM x0, range(0, 7) AS q(s) WHERE i >= 8 * s AND i < 8 * s + 16),
dn AS (SELECT id, s, k, (sum(v * cos(2 * pi() * k * j / 16)) ** 2 + sum(v * sin(2 * pi() * k * j / 16)) ** 2) / (64 * 6) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS p FROM sg, range(0, 9) AS q(k) GROUP BY id, s, k),
ps AS (SELECT id, k, 4.0::DOUBLE * k AS hz, avg(p) AS p FROM dn GROUP BY id, k),
nb AS (SELECT *, lag(p) OVER w AS b, lead(p) OVER w AS a, max(p) FILTER (k > 0) OVER (PARTITION BY id) AS high FROM ps WINDOW w AS (PARTITION BY id ORDER BY k)),
lo AS (SELECT * FROM nb WHERE p > b AND p >= a AND k > 0 AND p >= high * 1e-5),
cd AS (SELECT * FROM lo UNION ALL SELECT * FROM nb WHERE k > 0 AND p = high AND id NOT IN (SELECT id FROM lo)),
t1 AS (SELECT *, 1 AS turn FROM cd QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, k) = 1),
t2 AS (SELECT c.*, 2 AS turn FROM cd c JOIN t1 USING (id) WHERE abs(c.k - t1.k) >= 4 QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY c.p DESC, c.k) = 1),
pk AS (SELECT *, CASE WHEN b IS NULL OR a IS NULL OR abs(ln(b) - 2 * ln(p) + ln(a)) <= 1e-15 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (ln(b) - ln(a)) / (ln(b) - 2 * ln(p) + ln(a)))) END AS moved FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)),
rf AS (SELECT *, hz + 4 * moved AS f, CASE WHEN moved = 0 THEN p ELSE exp(ln(p) - 0.25 * (ln(b) - ln(a)) * moved) END AS power FROM pk),
ar AS (SELECT r.id, r.k, median(n.p) AS around FROM rf r JOIN ps n ON n.id = r.id AND n.p > 0 AND (n.k <= r.k - 3 OR n.k >= r.k + 3) GROUP BY r.id, r.k),
bd AS (SELECT r.id, r.k, CASE WHEN count(*) > 1 THEN sqrt(sum(n.p) * 4) ELSE 0 END AS band FROM rf r JOIN ps n ON n.id = r.id AND abs(n.hz - r.f) <= 8 GROUP BY r.id, r.k),
hw AS (SELECT id, i, (x - avg(x) OVER (PARTITION BY id)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM x0),
ph AS (SELECT r.id, r.k, atan2(-sum(v * sin(2 * pi() * ceil(f - 0.5) * i / 64)), sum(v * cos(2 * pi() * ceil(f - 0.5) * i / 64))) * 180 / pi() AS phase FROM rf r JOIN hw USING (id) GROUP BY r.id, r.k),
fin AS (SELECT id, turn, f, hz, power, 10 * log10(power / around) AS prominence, band, phase FROM rf JOIN ar USING (id, k) JOIN bd USING (id, k) JOIN ph USING (id, k) WHERE 10 * log10(power / around) >= 3)"""
ORACLE_SQL = {
    "complex_grid": f"WITH {_GRID} SELECT recording, board, axis, f::INT AS bin, m::INT AS moment, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im FROM cell JOIN valid USING (vec_id)",
    "wideband_features": f"""WITH {_GRID},
own AS (SELECT c.*, recording, board, axis, share, re * re + im * im AS p FROM cell c JOIN valid USING (vec_id)),
met AS (SELECT o.*, b.share AS share0, b.p AS p0, o.re * b.re + o.im * b.im AS xr, o.im * b.re - o.re * b.im AS xi FROM own o LEFT JOIN own b ON b.board = 0 AND b.recording = o.recording AND b.axis = o.axis AND b.f = o.f AND b.m = o.m),
box AS (SELECT o.vec_id, o.f, o.m, avg(n.xr) AS xr, avg(n.xi) AS xi, avg(n.p) AS p, avg(n.p0) AS p0 FROM met o, range(-1, 2) AS a(df), range(-2, 3) AS b(dm), met n
        WHERE n.vec_id = o.vec_id AND n.f = least(greatest(o.f + df, 0), 8) AND n.m = least(greatest(o.m + dm, 0), 3) GROUP BY ALL),
every AS (SELECT o.*, b.xr AS sr, b.xi AS si, sqrt(b.xr * b.xr + b.xi * b.xi) AS size, b.p AS sp, b.p0 AS sp0, sqrt(o.p + 1e-12) AS mag,
            coalesce(recording % 3 <> 0 AND share >= 0.98 AND share0 >= 0.98, false) AS cross_valid, 5 * f <= CASE WHEN board = 5 THEN 20 ELSE 32 END AS frequency_valid FROM met o JOIN box b USING (vec_id, f, m))
SELECT recording, board, axis, f::INT AS bin, m::INT AS moment, cross_valid, frequency_valid,
  {", ".join(f"round(CASE WHEN frequency_valid THEN {e} ELSE 0 END, 5) + 0 AS {n}" for n, e in (("log_power", "ln(1 + p)"), ("phase_cos", "re / mag"), ("phase_sin", "im / mag")))},
  {", ".join(f"round(CASE WHEN frequency_valid AND cross_valid THEN {e} ELSE 0 END, 5) + 0 AS {n}" for n, e in (("cross_log", "ln(1 + size)"), ("cross_cos", "sr / (size + 1e-12)"), ("cross_sin", "si / (size + 1e-12)"), ("coherence", "least(size * size / (sp * sp0 + 1e-12), 1)")))}
FROM every""",
    "smoothed_grid": """WITH c AS (SELECT vec_id AS id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, unnest(range(0, 64)) AS r(i)),
boxed AS (SELECT o.id, o.i, avg(n.v) AS boxed FROM c o, range(-1, 2) AS a(dr), range(-2, 3) AS b(dc), c n
          WHERE n.id = o.id AND n.i = 8 * least(greatest(o.i // 8 + dr, 0), 7) + least(greatest(o.i % 8 + dc, 0), 7) GROUP BY ALL),
moving AS (SELECT id, i, sum(v) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS moving FROM c)
SELECT id, i::INT AS at, round(boxed, 6) + 0 AS boxed, round(moving, 6) + 0 AS moving FROM boxed JOIN moving USING (id, i)""",
    "clock_windows": f"""WITH e AS (SELECT user_id % 10 AS grp, event_type AS sensor, epoch_us(ts) / 1e6 AS t, value FROM events),
spans AS (SELECT grp, sensor, min(t) AS earliest, max(t) AS latest FROM e GROUP BY ALL),
ends AS (SELECT grp, min(latest) AS finish FROM spans GROUP BY grp HAVING count(*) >= 5 AND min(latest) - max(earliest) >= {CLOCK_SECONDS}),
placed AS (SELECT grp, sensor, round_even((t - (finish - {CLOCK_SECONDS})) * {CLOCK_RATE!r}::DOUBLE, 0)::BIGINT AS k, t, value FROM e JOIN ends USING (grp) WHERE t >= finish - {CLOCK_SECONDS} AND t < finish),
one AS (SELECT grp, sensor, k, value FROM placed WHERE k < 40 QUALIFY row_number() OVER (PARTITION BY grp, sensor, k ORDER BY t DESC, value DESC) = 1),
cells AS (SELECT s.grp, s.sensor, (latest - finish) * 1000 AS skew_ms, r.k, value, avg((value IS NOT NULL)::INT) OVER (PARTITION BY s.grp, s.sensor) AS valid
          FROM spans s JOIN ends USING (grp) CROSS JOIN range(0, 40) AS r(k) LEFT JOIN one o ON o.grp = s.grp AND o.sensor = s.sensor AND o.k = r.k)
SELECT grp, sensor, round(skew_ms, 3) + 0 AS skew_ms, round(valid, 3) + 0 AS valid, concat_ws(',', CASE WHEN 1 - valid > 0.4 THEN 'excessive_missing_samples' END, CASE WHEN abs(skew_ms) > 2e8 THEN 'excessive_clock_skew' END) AS notes, k::INT AS k, round(value, 3) + 0 AS value FROM cells""",
    "capture_alignment": """WITH e AS (SELECT vec_id, vec_id // 6 AS capture, vec_id % 6 AS slot, list_transform(embedding, lambda v: v::DOUBLE) AS x, CASE WHEN vec_id % 53 <> 7 THEN 1000 + vec_id // 6 + (vec_id * 37 % 18) / 64::DOUBLE + 0.003::DOUBLE END AS ends, vec_id % 31 <> 4 AS monotonic FROM embeddings),
k AS (SELECT *, bool_and(ends IS NOT NULL AND monotonic) OVER c AS known, min(ends) OVER c AS common FROM e WINDOW c AS (PARTITION BY capture)),
s AS (SELECT *, CASE WHEN known THEN greatest(0, ends - common) ELSE 0 END AS shift FROM k),
a AS (SELECT *, known AND bool_and(len(x) - round_even(shift * 64, 0) >= 48) OVER (PARTITION BY capture) AS aligned FROM s),
c AS (SELECT *, CASE WHEN aligned THEN round_even(shift * 64, 0)::INT ELSE 0 END AS cut FROM a), w AS (SELECT *, x[64 - cut - 48 + 1:64 - cut] AS y, CASE WHEN aligned THEN common ELSE 2000 + capture END AS finish FROM c)
SELECT capture, slot::INT AS slot, round(y[1], 6) + 0 AS head, round(y[48], 6) + 0 AS tail, round(list_sum(y), 6) + 0 AS total, len(y)::INT AS n, false AS short, round(finish - 0.75, 6) AS start, round(finish, 6) AS finish, round(CASE WHEN aligned THEN shift END, 6) + 0 AS trim_s,
  round(CASE WHEN aligned THEN (shift - cut / 64::DOUBLE) * 1000 END, 6) + 0 AS skew_ms, CASE WHEN aligned THEN 'common_end' ELSE 'own_tail' END AS alignment, aligned AND monotonic AS sound FROM w""",
    "board_clock": f"""WITH s0 AS (SELECT vec_id // 3 AS board, vec_id % 3 AS axis, vec_id AS id, i, CASE WHEN vec_id % 3 = 0 AND vec_id // 3 % 2 = 0 AND i = vec_id // 3 % 60 THEN NULL ELSE embedding[i + 1]::DOUBLE END AS v FROM embeddings, unnest(range(0, 64)) AS r(i)),
src AS (SELECT id, 63 - i AS i, coalesce(v, 0) AS x FROM s0), {_polyphase("y", "src", 25, 32, 64, "line")},
bad AS (SELECT board, 63 - i AS i FROM s0 WHERE v IS NULL), lost AS (SELECT DISTINCT board, m FROM bad, range(0, 50) AS r(m) WHERE abs(i - least(63, round_even(m * 32 / 25::DOUBLE, 0))) <= 13),
o AS (SELECT id // 3 AS board, id % 3 AS axis, 49 - y.m AS k, CASE WHEN l.m IS NULL THEN round(y, 6) + 0 END AS y FROM y LEFT JOIN lost l ON l.board = id // 3 AND l.m = y.m)
SELECT board, k::INT AS k, max(y) FILTER (axis = 0) AS x, max(y) FILTER (axis = 1) AS y, max(y) FILTER (axis = 2) AS z FROM o GROUP BY board, k HAVING count(*) = 3""",
    "resampled_windows": f"""WITH s0 AS (SELECT vec_id AS id, i, CASE WHEN vec_id % 5 = 0 AND (i + vec_id) % 40 = 7 THEN NULL ELSE embedding[i + 1]::DOUBLE END AS v FROM embeddings, unnest(range(0, 64)) AS r(i)),
{_bridged("s0", "src")}, {_polyphase("y", "src", 25, 64, 64, "line")}, mask AS (SELECT id, i, (v IS NOT NULL)::INT::DOUBLE AS x FROM s0), {_polyphase("met", "mask", 25, 64, 64, "zero")},
whole AS (SELECT id, bool_and(v IS NOT NULL) AS whole FROM s0 GROUP BY id),
got AS (SELECT id, y.m, CASE WHEN whole OR met.y >= 0.999 THEN y.y END AS v FROM y JOIN met USING (id, m) JOIN whole USING (id))
SELECT id, k::INT AS k, round(v, 6) + 0 AS value FROM whole, range(0, 28) AS r(k) LEFT JOIN got ON got.id = whole.id AND got.m = k""".replace("SELECT id, k::INT", "SELECT whole.id AS id, k::INT"),
    "modal_peaks": f"""WITH {_DENSITY},
c AS (SELECT recording, board, k, hz, avg(p) AS p FROM den WHERE hz >= 1 AND hz <= CASE WHEN board = 4 THEN 10 ELSE 14 END GROUP BY ALL HAVING avg(p) > 0),
q AS (SELECT *, 10 * log10(p + 1e-24) AS db, lag(p) OVER w AS before, lead(p) OVER w AS after FROM c WINDOW w AS (PARTITION BY recording, board ORDER BY k)),
pk AS (SELECT * FROM q WHERE p > before AND p >= after),
hi AS (SELECT a.recording, a.board, a.k, max(b.k) FILTER (b.k < a.k) AS l, min(b.k) FILTER (b.k > a.k) AS r FROM pk a LEFT JOIN q b ON b.recording = a.recording AND b.board = a.board AND b.p > a.p GROUP BY ALL),
pr AS (SELECT a.recording, a.board, a.k, any_value(a.db) - greatest(min(b.db) FILTER (b.k <= a.k AND b.k >= coalesce(l, 0)), min(b.db) FILTER (b.k >= a.k AND b.k <= coalesce(r, 99))) AS prominence
       FROM pk a JOIN hi USING (recording, board, k) JOIN q b ON b.recording = a.recording AND b.board = a.board GROUP BY ALL),
ok AS (SELECT recording, board, k, prominence FROM pr WHERE prominence >= 3),
every AS (SELECT * FROM ok UNION ALL SELECT recording, board, arg_max(k, db), 0 FROM q WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.recording = q.recording AND ok.board = q.board) GROUP BY recording, board),
top AS (SELECT e.recording, e.board, e.k, prominence, q.p, q.hz, row_number() OVER (PARTITION BY e.recording, e.board ORDER BY prominence + q.db * 1e-3 DESC) AS rank FROM every e JOIN q USING (recording, board, k) QUALIFY rank <= 3),
walk AS (SELECT t.recording, t.board, t.k, coalesce(max(q.hz) FILTER (q.k < t.k AND q.p <= t.p / 2), min(q.hz)) AS l, coalesce(min(q.hz) FILTER (q.k > t.k AND q.p <= t.p / 2), max(q.hz)) AS r FROM top t JOIN q ON q.recording = t.recording AND q.board = t.board GROUP BY ALL)
SELECT recording, board, rank::INT AS rank, hz AS frequency, round(least(1, (r - l) / (2 * hz)), 5) + 0 AS damping, round(prominence, 5) + 0 AS prominence_db FROM top JOIN walk USING (recording, board, k)""",
    "physics_features": f"""WITH {_DENSITY},
u AS (SELECT *, CASE WHEN board = 4 THEN 10 ELSE 16 END AS usable FROM ax),
tot AS (SELECT id, sum(p) AS total, count(*) AS bins FROM den JOIN u USING (id) WHERE hz <= usable GROUP BY id),
ent AS (SELECT id, greatest(0, least(1, -sum(p / total * ln(p / total + 1e-18)) / ln(any_value(bins)))) AS entropy FROM den JOIN u USING (id) JOIN tot USING (id) WHERE hz <= usable GROUP BY id),
bands AS (SELECT * FROM (VALUES {", ".join(f"('{lo:g}-{hi:g}', {lo}, {hi})" for lo, hi in MODAL_BANDS)}) AS b(band, lo, hi)),
en AS (SELECT id, any_value(u.recording) AS recording, any_value(u.board) AS board, any_value(u.axis) AS axis, band, CASE WHEN count(*) = 1 THEN sum(p) ELSE sum(p) - (arg_min(p, hz) + arg_max(p, hz)) / 2 END * 0.5::DOUBLE AS energy FROM den JOIN u USING (id), bands WHERE hi <= usable + 1e-9 AND hz >= lo AND hz < hi GROUP BY id, band),
f AS (SELECT recording, board, axis, 'rms' AS feature, rms AS value FROM u WHERE board <> 3 UNION ALL SELECT recording, board, axis, 'peak', peak FROM u WHERE board <> 3 UNION ALL SELECT recording, board, axis, 'crest', peak / rms FROM u
  UNION ALL SELECT recording, board, axis, 'kurtosis', ((n * n - 1) * m4 / m2 ** 2 - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3)) + 3 FROM u JOIN mom USING (id) UNION ALL SELECT recording, board, axis, 'spectral_entropy', entropy FROM u JOIN ent USING (id)
  UNION ALL SELECT recording, board, axis, 'band_energy:' || band, energy FROM en WHERE board <> 3
  UNION ALL SELECT e.recording, e.board, e.axis, 'transmissibility_db:' || e.band, 10 * log10((e.energy + 1e-24) / (b.energy + 1e-24)) FROM en e JOIN en b ON b.board = 0 AND b.recording = e.recording AND b.axis = e.axis AND b.band = e.band WHERE b.energy > 0)
SELECT recording, board, axis, feature, round(value, 4) + 0 AS value FROM f""",
    "complex_assurance": """WITH e AS (SELECT vec_id // 100 AS grp, vec_id AS id, (vec_id * 17 % 101) * 0.25::DOUBLE AS f, k, embedding[2 * k + 1]::DOUBLE AS re, embedding[2 * k + 2]::DOUBLE AS im FROM embeddings, unnest(range(0, 32)) AS r(k)),
p AS (SELECT a.grp, a.id AS a, b.id AS b, sum(a.re * b.re + a.im * b.im) AS x, sum(a.re * b.im - a.im * b.re) AS y, sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im) AS w FROM e a JOIN e b ON a.grp = b.grp AND a.k = b.k AND a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.f - b.f) <= 0.75 GROUP BY ALL)
SELECT grp, a, b, round(CASE WHEN w > 0 THEN least(1, (x * x + y * y) / w) ELSE 0 END, 6) + 0 AS mac FROM p""",
    "distinct_peaks": f"""WITH {_PEAKS} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY turn))::INT AS rank, round(f, 4) AS frequency, hz AS bin_frequency, round(power, 4) + 0 AS power, round(prominence, 4) + 0 AS prominence_db, round(band, 4) + 0 AS band_rms, round(phase, 4) + 0 AS phase_degrees FROM fin""",
    "spectrum_report": f"""WITH {_PEAKS}, a AS (SELECT id, stddev_pop(x) AS rms FROM x0 GROUP BY id), d AS (SELECT id, sqrt(sum(p) * 4) AS psd FROM ps GROUP BY id),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS r FROM fin), s AS (SELECT id, count(*) AS n, max(f) FILTER (r = 1) AS f1, max(f) FILTER (r = 2) AS f2, max(power) FILTER (r = 1) AS p1, max(power) FILTER (r = 2) AS p2 FROM o GROUP BY id)
SELECT id, 64 AS n, 1.0::DOUBLE AS seconds, round(rms, 5) AS centred_rms, round(psd, 5) AS psd_rms, round(psd / rms, 5) AS consistency, round(psd * psd / (rms * rms), 5) AS variance_consistency, coalesce(s.n, 0)::INT AS peaks, round(abs(10 * log10(p1 / p2)), 5) AS lead_db, round(f2, 5) AS rival_hz,
  coalesce(abs(10 * log10(p1 / p2)) < 3, false) AS rival, round(f1, 5) AS effective_hz, CASE WHEN s.n > 0 THEN 'averaged_psd' END AS effective_kind, coalesce(s.n > 0, false) AS reliable FROM a JOIN d USING (id) LEFT JOIN s USING (id)""",
    "filtered_windows": """WITH a AS (SELECT vec_id AS id, ['lowpass', 'highpass', 'bandpass', 'notch', 'notch_50', 'notch_60', 'none', NULL, 'lowpass'][vec_id % 9 + 1] AS kind, CASE vec_id % 9 WHEN 7 THEN 'unknown filter' WHEN 8 THEN 'cutoffs must be inside (0, fs / 2)' END AS fault, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 4 END AS o,
  CASE vec_id % 9 WHEN 3 THEN 30 WHEN 4 THEN 50 ELSE 60 END AS c, embedding FROM embeddings),
x0 AS (SELECT id, kind, o, c, i, embedding[i + 1]::DOUBLE - avg(embedding[i + 1]::DOUBLE) OVER (PARTITION BY id) AS x FROM a, unnest(range(0, 64)) AS r(i) WHERE fault IS NULL),
w AS (SELECT id, kind, o, c, t, x FROM (SELECT t, CASE WHEN abs(t - 64) % 126 > 63 THEN 126 - abs(t - 64) % 126 ELSE abs(t - 64) % 126 END AS i FROM range(0, 192) AS q(t)) JOIN x0 USING (i) WHERE kind <> 'none'),
s AS (SELECT id, kind, o, c, k, sum(x * cos(2 * pi() * k * t / 192)) AS re, -sum(x * sin(2 * pi() * k * t / 192)) AS im FROM w, range(0, 97) AS q(k) GROUP BY ALL),
g AS (SELECT id, k, re, im, CASE WHEN k IN (0, 96) THEN 1 ELSE 2 END / 192::DOUBLE * CASE WHEN kind LIKE 'notch%' THEN sqrt(1 - pow(2, -pow(abs(k * 2 / 3::DOUBLE - c), 2 * o)))
  ELSE CASE WHEN kind = 'lowpass' THEN 1 WHEN k = 0 THEN 0 ELSE 1 / sqrt(1 + pow(5 / (k * 2 / 3::DOUBLE), 2 * o)) END * CASE WHEN kind = 'highpass' THEN 1 ELSE 1 / sqrt(1 + pow(k * 2 / 3::DOUBLE / 20, 2 * o)) END END AS g FROM s),
y0 AS (SELECT id, i, sum(g * (re * cos(2 * pi() * k * (i + 64) / 192) - im * sin(2 * pi() * k * (i + 64) / 192))) AS y FROM g, range(0, 64) AS q(i) GROUP BY id, i UNION ALL SELECT id, i, x FROM x0 WHERE kind = 'none'),
y AS (SELECT id, i, y - avg(y) OVER (PARTITION BY id) AS y FROM y0)
SELECT a.id, kind, fault, i::INT AS k, round(y, 6) + 0 AS value FROM a LEFT JOIN y ON y.id = a.id""",
}
