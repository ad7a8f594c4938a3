"""Index fields and labels out of nested documents: ordered paths of a VARIANT, supervision decided target by target.

Documents are texts with a JSON object each; what a document lacks or has wrong is told in a column and stops nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscillar.functions import text

TARGETS = 5
# The vocabulary of labels.
CLASSES = ("normal", "impact_transient", "periodic_excitation", "broadband_increase", "modal_frequency_shift", "damping_change", "mounting_or_sensor_fault", "unknown_anomaly", "data_invalid")
SEVERITIES = ("none", "advisory", "warning", "critical")
SPLITS = ("train", "validation", "test")
# Where a field is looked for, in this order.
PATHS = {
    "dataset_id": ("dataset_id", "provenance.dataset_id", "metadata.dataset_id", "episode.provenance.dataset_id"),
    "split": ("split", "provenance.split"),
    "group_id": ("split_group", "group", "provenance.split_group", "provenance.session_id", "session_id", "episode_id"),
    "training_role": ("training_role", "provenance.training_role", "metadata.training_role"),
}


def nested(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path a.b of a VARIANT; null where any step is missing or of another kind."""
    return F.try_variant_get(v, F.lit(f"$.{path}"), kind)


def first_of(v: Column, paths: tuple[str, ...]) -> Column:
    """The first value of the paths that is neither missing nor empty."""
    return F.coalesce(*(F.nullif(nested(v, p), F.lit("")) for p in paths))


def split_in_path(path: Column) -> Column:
    """The first of SPLITS that is a folder or name in a path."""
    parts = F.split(path, "/")
    return F.coalesce(*(F.when(F.array_contains(parts, s), s) for s in SPLITS))


def index_fields(documents: DataFrame, column: str = "json") -> DataFrame:
    """documents with v (the VARIANT), dataset_id, split, group_id, training_role, stratum and missing (names of what no path has).

    A split may come from a path of the arrays or metadata; a document without any group is one of its own, named by a hash of
    its content with sorted keys. Texts that are no JSON object have no fields.
    """
    v = F.try_parse_json(F.col(column))
    d = documents.withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    v = F.col("v")
    d = d.withColumns({name: first_of(v, paths) for name, paths in PATHS.items()})
    d = d.withColumn("split", F.coalesce("split", split_in_path(nested(v, "array_path")), split_in_path(nested(v, "metadata_path"))))
    d = d.withColumn("group_id", F.coalesce("group_id", F.substring(F.sha2(F.to_json(v), 256), 1, 20)))
    d = d.withColumn("training_role", F.when(v.isNotNull(), F.coalesce("training_role", F.lit("supervised"))))
    named = F.nullif(F.trim(nested(v, "split_stratum")), F.lit(""))
    healthy = F.coalesce(nested(v, "healthy", "boolean"), F.lit(False))
    changed = F.concat(F.lit("changed::"), F.coalesce(nested(v, "class_name"), F.lit("unknown_anomaly")))
    stratum = F.when(F.col("training_role") == "representation_only", "representation_only").otherwise(F.coalesce(named, F.when(healthy, "healthy").otherwise(changed)))
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in PATHS)))
    return d.withColumn("stratum", F.when(v.isNotNull(), stratum)).withColumn("missing", missing)


def episode_labels(fields: DataFrame, mode: Column) -> DataFrame:
    """fields (of index_fields) with fault, global_class, global_severity, scope, targets (target, affected, class_name, severity).

    mode: how the dataset locates changes; "global_unknown" datasets say nothing of targets unless a document names them.
    A healthy document of another dataset has five normal targets; a changed one names its affected targets, and the others are
    normal. Documents that declare global supervision only, or whose dataset can't locate, have no targets: what isn't
    known is left out and never taken for normal. Documents that are for representation only have no label. A document with
    a fault (the first in the order below) has none either.
    """
    v = F.col("v")
    healthy = F.coalesce(nested(v, "healthy", "boolean"), F.lit(False))
    given = F.coalesce(nested(v, "affected_targets", "array<string>"), F.array().cast("array<string>"))
    affected, supervised = text.target_numbers(given), nested(v, "target_supervision_available", "boolean")
    scope = F.lower(F.trim(F.coalesce(nested(v, "supervision_scope"), F.lit(""))))
    name = F.coalesce(nested(v, "class_name"), F.when(healthy, "normal").otherwise("unknown_anomaly"))
    severity = F.coalesce(nested(v, "severity"), F.when(healthy, "none").otherwise(""))
    only_global = F.coalesce((scope == "global_only") | ~supervised, scope == "global_only")
    unlocated = mode == "global_unknown"
    d = fields.withColumns({"healthy_": healthy, "affected_": affected, "named_": F.size(given) > 0, "class_": F.when(healthy, "normal").otherwise(name), "severity_": F.when(healthy, "none").otherwise(severity), "global_": only_global, "unlocated_": unlocated})
    raw = F.try_variant_get(v, F.lit("$.target_supervision_available"), "variant")
    unreadable = raw.isNotNull() & ~F.is_variant_null(raw) & (F.schema_of_variant(raw) != "BOOLEAN")
    joint = F.col("healthy_") & ~F.col("unlocated_") & ~F.col("global_")
    changed = ~F.col("global_") & ~F.col("healthy_")
    faults = {
        "unknown_class": ~name.isin(*CLASSES),
        "no_severity": ~severity.isin(*SEVERITIES),
        "unreadable_targets": F.col("affected_").isNull(),
        "unreadable_supervision": unreadable,
        "contradictory_supervision": (scope == "global_only") & F.coalesce(supervised, F.lit(False)),
        "targets_of_global_document": F.col("global_") & F.col("named_"),
        "no_targets": changed & ~F.col("unlocated_") & ~F.col("named_"),
        "targets_of_healthy_document": ~F.col("global_") & F.col("healthy_") & F.col("unlocated_") & F.col("named_"),
        "unknown_target": changed & F.exists("affected_", lambda t: t > TARGETS),
    }
    labelled = F.col("training_role") != "representation_only"
    d = d.withColumn("fault", F.when(v.isNull(), "no_object").when(labelled, F.coalesce(*(F.when(c, n) for n, c in faults.items()))))
    sound = labelled & F.col("fault").isNull()
    every = F.sequence(F.lit(1), F.lit(TARGETS))
    hit = lambda t: F.array_contains("affected_", t) & ~F.col("healthy_")
    one = lambda t: F.struct(t.alias("target"), hit(t).alias("affected"), F.when(hit(t), F.col("class_")).otherwise("normal").alias("class_name"), F.when(hit(t), F.col("severity_")).otherwise("none").alias("severity"))
    located = joint | (~F.col("global_") & ~F.col("healthy_") & F.col("named_"))
    none = F.filter(F.transform(every, one), lambda _: F.lit(False))
    out = d.withColumns(
        {
            "global_class": F.when(sound, F.when(F.col("healthy_"), "normal").otherwise("unknown_anomaly")), "global_severity": F.when(sound, F.col("severity_")),
            "scope": F.when(sound, F.when(located, "joint").otherwise("global_only")), "targets": F.when(sound, F.when(located, F.transform(every, one)).otherwise(none)),
        }
    )
    return out.drop("healthy_", "affected_", "named_", "class_", "severity_", "global_", "unlocated_")
