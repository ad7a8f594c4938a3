"""The components of devices out of their status documents: sensors, algorithms and actuators with what a reader needs to know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kinds of components by the number that documents have for them.
KINDS = {0: "sensor", 1: "algorithm", 2: "other", 3: "actuator"}
#: bytes of a number by the name that documents have for its type.
NUMBER_BYTES = {"int8_t": 1, "uint8_t": 1, "int16_t": 2, "uint16_t": 2, "int32_t": 4, "uint32_t": 4, "float": 4, "double": 8}
STAMP_BYTES = 8


def components(documents: DataFrame, keys: list[str], column: str = "json", kinds: dict[int, str] = KINDS) -> DataFrame:
    """keys, place, component, subtype, kind, active, dim, rate, samples_per_stamp, number, frame_bytes, sensitivity, unit of every component of JSON documents.

    A component is an object with one name; the components lie in the document or in its devices. The rate is the measured one
    where it is known. A frame holds samples_per_stamp samples of dim numbers (fft_length for spectra) and a time, or one
    sample and no time. Documents that are no JSON have no components.
    """
    parts = "components array<map<string, variant>>"
    d = documents.withColumn("doc_", F.from_json(F.col(column), f"{parts}, devices array<struct<{parts}>>"))
    own = F.coalesce("doc_.components", F.flatten(F.transform("doc_.devices", lambda x: F.coalesce(x["components"], F.array().cast("array<map<string, variant>>")))))
    each = d.select(*keys, F.posexplode(own).alias("place", "c_")).select(*keys, "place", F.explode("c_").alias("component", "v_"))
    get = lambda path, kind: F.try_variant_get("v_", F.lit(f"$.{path}"), kind)
    known = lambda table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    measured = get("measodr", "double")
    stamp = F.coalesce(get("samples_per_ts", "int"), get("samples_per_ts.val", "int"), F.lit(0))
    dim = F.coalesce(get("fft_length", "int"), get("dim", "int"), F.lit(1))
    size = dim * F.try_element_at(known(NUMBER_BYTES), get("data_type", "string"))
    return each.select(
        *keys, "place", "component", F.element_at(F.split(F.lower("component"), "_"), -1).alias("subtype"), F.coalesce(F.try_element_at(known(kinds), get("c_type", "int")), F.lit("other")).alias("kind"),
        F.coalesce(get("enable", "boolean"), F.lit(False)).alias("active"), dim.alias("dim"), F.when(measured > 0, measured).otherwise(get("odr", "double")).alias("rate"), stamp.alias("samples_per_stamp"),
        get("data_type", "string").alias("number"), F.when(stamp > 0, stamp * size + STAMP_BYTES).otherwise(size).alias("frame_bytes"), get("sensitivity", "double").alias("sensitivity"), get("unit", "string").alias("unit"),
    )


def listed(catalog: DataFrame, kind: str, subtype: str | None = None, only_active: bool = False) -> DataFrame:
    """The components of a kind, and of a subtype (the last part of their name) if one is given."""
    out = catalog.filter(F.col("kind") == kind)
    out = out if subtype is None else out.filter(F.col("subtype") == subtype.lower())
    return out.filter("active") if only_active else out
