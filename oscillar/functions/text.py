"""Names, labels, numbers and times in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of filters, by what they are also called.
FILTER_NAMES = {
    "none": ("none", "off", "raw", "unfiltered"),
    "highpass": ("highpass", "high_pass", "hp"),
    "lowpass": ("lowpass", "low_pass", "lp"),
    "bandpass": ("bandpass", "band_pass", "bp"),
    "notch": ("notch", "bandstop", "band_stop"),
    "notch_50": ("notch_50", "notch50", "mains_50", "50hz"),
    "notch_60": ("notch_60", "notch60", "mains_60", "60hz"),
}


def token(name: Column) -> Column:
    """Lower-case letters and digits of a name."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "")


def filter_name(name: Column) -> Column:
    """The canonical name of a filter; an empty or missing one is none, an unknown one null."""
    n = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[\s-]+", "_")
    out = F.when(n == "", "none")
    for canonical, others in FILTER_NAMES.items():
        out = out.when(n.isin(*others), canonical)
    return out


def alias_of(name: Column, known: list[str], aliases: dict[str, str], default: str | None = None) -> Column:
    """The known name that equals it, that an alias means, or that it holds (the first of the list), in this order."""
    n = F.lower(F.trim(name))
    out = F.when(n.isin(*known), n)
    for a, to in aliases.items():
        out = out.when(n == a, to)
    for k in known:
        out = out.when(F.contains(n, F.lit(k)), k)
    return out.otherwise(F.lit(default))


def number(text: Column, default: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """A finite number within bounds, or the default."""
    v = text.try_cast("double")
    v = F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), F.lit(default).cast("double"))
    v = v if low is None else F.when(v < low, float(low)).otherwise(v)
    return v if high is None else F.when(v > high, float(high)).otherwise(v)


def truth(text: Column, default: bool = False) -> Column:
    n = F.lower(F.trim(text))
    return F.when(n.isin("1", "true", "yes", "y", "on"), True).when(n.isin("0", "false", "no", "n", "off"), False).otherwise(default)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds between two ISO-8601 times; null if either is not one, 0 at least."""
    at = lambda c: F.unix_micros(F.try_to_timestamp(c))
    gone = (at(end) - at(start)) / 1e6
    return F.when(gone < 0, 0.0).otherwise(gone)


def estimated_samples(file_bytes: Column, frame_samples: int, channels: int, sample_bytes: int = 2, stamp_bytes: int = 8) -> Column:
    """Samples in the whole frames of a file of so many bytes."""
    return F.floor(file_bytes / (frame_samples * channels * sample_bytes + stamp_bytes)) * frame_samples


def holds_term(text: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the phrases, case and the signs _ and - aside."""
    t = F.lower(F.translate(text, "_-", "  "))
    return F.exists(F.array(*map(F.lit, terms)), lambda p: F.contains(t, p))


def redacted(text: Column, terms: list[str], put: str = "[redacted]") -> Column:
    """put in place of a text that holds one of the phrases."""
    return F.when(holds_term(text, terms), F.lit(put)).otherwise(text)


def rotation_valid(m: Column, tolerance: float = 2e-3) -> Column:
    """Whether nine numbers, row by row, are a rotation: orthonormal rows and determinant one, within the tolerance."""
    g = lambda i, j: F.get(m, 3 * i + j)
    ok = F.size(m) == 9
    for i in range(3):
        for j in range(i, 3):
            dot = sum((g(i, k) * g(j, k) for k in (1, 2)), g(i, 0) * g(j, 0))
            ok = ok & (F.abs(dot - (1.0 if i == j else 0.0)) <= tolerance)
    det = g(0, 0) * (g(1, 1) * g(2, 2) - g(1, 2) * g(2, 1)) - g(0, 1) * (g(1, 0) * g(2, 2) - g(1, 2) * g(2, 0)) + g(0, 2) * (g(1, 0) * g(2, 1) - g(1, 1) * g(2, 0))
    return F.coalesce(ok & (F.abs(det - 1) <= tolerance), F.lit(False))


def target_numbers(given: Column) -> Column:
    """Numbers of targets named as 3, '3' or 'target_3', each once in ascending order; null if one is none of these."""
    found = F.transform(given, lambda g: F.regexp_extract(F.lower(F.trim(g)), r"^(?:target_)?([1-9]\d*)$", 1).try_cast("int"))
    return F.when(~F.exists(found, lambda n: n.isNull()), F.array_sort(F.array_distinct(found)))


def natural_key(name: Column) -> Column:
    """A text that sorts as the name does when runs of digits are numbers: lower case, digits padded to 12 places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def spread(values: Column, k: int) -> Column:
    """k values spread evenly over an array, both ends included; all of them if there are no more."""
    n = F.size(values)
    if k < 2:
        return F.slice(values, 1, k)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / (k - 1)).cast("int"))
    return F.when(n <= k, values).otherwise(F.transform(at, lambda i: F.get(values, i)))


def first_json(text: Column) -> Column:
    """The text from the first opening to the last closing brace, fences around it left out; null without them."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def verdict_faults(reply: Column, sensors: list[str], labels: tuple[str, ...]) -> Column:
    """What is wrong with a reply {"verdicts": [{"sensor", "label"}]}: not JSON, unknown labels or sensors, missing or repeated sensors; empty if nothing."""
    v = F.from_json(first_json(reply), "verdicts array<struct<sensor:string,label:string>>")["verdicts"]
    named, known = F.transform(v, lambda x: x["sensor"]), F.array(*map(F.lit, sensors))
    faults = [
        (v.isNull(), "not_json"), (F.exists(v, lambda x: x["label"].isNull() | ~x["label"].isin(*labels)), "unknown_label"), (F.size(F.array_except(named, known)) > 0, "unknown_sensor"),
        (F.size(F.array_except(known, named)) > 0, "missing_sensor"), (F.size(F.array_distinct(named)) < F.size(named), "repeated_sensor"),
    ]
    return F.array_join(F.array_compact(F.array(*(F.when(c, name) for c, name in faults))), ",")


def asked_seconds(text: Column) -> Column:
    """The duration that a request asks for ('last 10 seconds', '2 min'), in seconds; null if none."""
    n = F.regexp_extract(F.lower(text), r"(\d+(?:\.\d+)?)\s*(?:s|sec|secs|seconds?|m|min|mins|minutes?|h|hours?)\b", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(text), r"\d+(?:\.\d+)?\s*(s|m|h)", 1)
    return n * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)


def code_strings(prompt: Column) -> Column:
    """The code strings between <codes> marks of a prompt."""
    return F.regexp_extract_all(prompt, F.lit(r"<codes>([^<]*)</codes>"), F.lit(1))


def encoded(codes: Column, alphabet: str) -> Column:
    """A list of code numbers as symbols of an alphabet."""
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(alphabet), c + 1, F.lit(1))), "")


def decoded(text: Column, alphabet: str) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


def logistic(x: Column, middle: float, slope: float) -> Column:
    """A soft threshold between 0 and 1."""
    return 1 / (1 + F.exp(-(x - middle) * slope))


#: How named features are scaled. Pattern of the name, curve, unit, least and largest value; of several that match, the first holds.
SCALES = (
    ("frequency_hz|width_hz", "share", "top_hz", 0.0, 2.0),
    ("prominence_db", "share", 60.0, 0.0, 2.0),
    ("^band_energy_g2::", "size_in_decades", 1e-14, 0.0, 16.0),
    ("^coherence::", "share", 1.0, 0.0, 1.0),
    ("^crest_factor::", "logarithm", 3.0, 0.0, 4.0),
    ("^cross_axis_covariance_g2::", "decades", 1e-14, -16.0, 16.0),
    ("^cross_power_g2::", "size_in_decades", 1e-14, 0.0, 16.0),
    ("^kurtosis::", "logarithm", 4.0, -4.0, 4.0),
    ("^modal_damping_ratio::", "share", 0.2, 0.0, 5.0),
    ("^normal_change_z::", "share", 6.0, -2.0, 2.0),
    ("^peak_abs_g::", "size_in_decades", 1e-7, 0.0, 12.0),
    ("^rms_g::", "size_in_decades", 1e-7, 0.0, 12.0),
    ("^spectral_entropy::", "share", 1.0, 0.0, 1.0),
    ("^transmissibility_db::", "share", 40.0, -3.0, 3.0),
    ("", "share", 1.0, -20.0, 20.0),
)


def scaled_feature(name: Column, value: Column, top_hz: float = 500.0) -> Column:
    """A named feature on the scale that SCALES has for it; 0 for what is no finite number."""

    def scaled(curve: str, unit: float) -> Column:
        size = F.abs(value)
        curves = {"share": value / unit, "logarithm": F.signum(value) * F.log1p(size) / unit, "size_in_decades": F.log10(1 + size / unit), "decades": F.signum(value) * F.log10(1 + size / unit)}
        return curves[curve]

    def bounded(pattern: str, curve: str, unit: float | str, low: float, high: float) -> Column:
        within = F.greatest(F.lit(low), F.least(F.lit(high), scaled(curve, max(top_hz, 1.0) if unit == "top_hz" else unit)))
        return F.when(F.rlike(name, F.lit(pattern)), within)

    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.coalesce(*(bounded(*row) for row in SCALES))).otherwise(0.0)
