import json
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oscillar.operators import labels, sampling


def fields(spark, docs):
    rows = [(k, d if d is None or isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)]
    return labels.index_fields(spark.createDataFrame(rows, "key int, json string"))


def test_fields_by_ordered_paths(spark):
    docs = [
        {"dataset_id": "", "provenance": {"dataset_id": "p", "split": "test"}, "metadata": {"dataset_id": "m"}, "episode_id": 7},
        {"dataset_id": {"a": 1}, "episode": {"provenance": {"dataset_id": "e"}}, "metadata_path": "x/validation/y", "array_path": "trains/a", "healthy": True, "split_stratum": "  "},
        {"b": 1, "a": [2]}, {"a": [2], "b": 1}, "[]", "nonsense", None, "{}", {"split_stratum": " s ", "training_role": "representation_only", "class_name": "x"},
    ]
    got = {r.key: r for r in fields(spark, docs).drop("v").collect()}
    assert (got[0].dataset_id, got[0].split, got[0].group_id, got[0].training_role, got[0].stratum) == ("p", "test", "7", "supervised", "changed::unknown_anomaly")
    assert (got[1].split, got[1].stratum) == ("validation", "healthy")
    assert got[2].group_id == got[3].group_id and len(got[2].group_id) == 20 and got[7].group_id != got[2].group_id and got[2].missing == ["dataset_id", "split"]
    assert all(got[k].group_id is None and got[k].missing == list(labels.PATHS) for k in (4, 5, 6)) and got[8].stratum == "representation_only"


def test_labels_leave_out_what_is_not_known(spark):
    base = {"class_name": "damping_change", "severity": "critical"}
    docs = [
        {"healthy": True, "severity": "warning"}, base | {"affected_targets": [3, "1", "target_3"]}, base, base | {"supervision_scope": " GLOBAL_ONLY "}, base | {"target_supervision_available": False, "affected_targets": [1]},
        base | {"supervision_scope": "global_only", "target_supervision_available": True}, base | {"target_supervision_available": "yes"}, {"severity": "none", "class_name": "odd"}, {"class_name": "damping_change"},
        base | {"affected_targets": [6]}, base | {"affected_targets": ["x"]}, {"healthy": True, "target_supervision_available": None}, "3", {"training_role": "representation_only", "class_name": "odd"},
    ]
    told = lambda mode: {r.key: r for r in labels.episode_labels(fields(spark, docs), F.lit(mode)).drop("v").collect()}
    got = told("target")
    assert [t.affected for t in got[1].targets] == [True, False, True, False, False] and got[1].targets[2].class_name == "damping_change" and got[1].targets[1].severity == "none" and got[1].scope == "joint"
    assert len(got[0].targets) == 5 and not any(t.affected for t in got[0].targets) and got[0].global_severity == "none" and len(got[11].targets) == 5
    assert got[3].scope == "global_only" and got[3].targets == [] and got[3].global_severity == "critical"
    faults = {2: "no_targets", 4: "targets_of_global_document", 5: "contradictory_supervision", 6: "unreadable_supervision", 7: "unknown_class", 8: "no_severity", 9: "unknown_target", 10: "unreadable_targets", 12: "no_object"}
    assert {k: r.fault for k, r in got.items() if r.fault} == faults and all(got[k].targets is None for k in faults) and got[13].scope is None and got[13].fault is None
    unknown = told("global_unknown")
    assert unknown[0].scope == "global_only" and unknown[2].scope == "global_only" and unknown[2].targets == [] and unknown[1].scope == "joint"


ROWS = [(k, "ab"[k % 2], "xyz"[k % 3] if k % 2 else "x", f"g{k % 7}", "global" if k % 5 < 2 else "target", k % 5 - 1) for k in range(400)] + [(900, None, "x", "g", "global", 0), (901, "a", None, "g", "other", 0)]
KIND = "id int, dataset string, state string, grp string, family string, target int"


def chances(rows, levels):
    children = defaultdict(set)
    for r in rows:
        for d in range(len(levels)):
            children[tuple(r[c] for c in levels[:d])].add(r[levels[d]])
    leaves = Counter(tuple(r[c] for c in levels) for r in rows)
    return {r["id"]: math.prod(1 / len(children[tuple(r[c] for c in levels[:d])]) for d in range(len(levels))) / leaves[tuple(r[c] for c in levels)] for r in rows}


def test_weights_of_all_modes(spark):
    df = spark.createDataFrame(ROWS, KIND)
    names = [c for c, _ in df.dtypes]
    rows = [dict(zip(names, r, strict=True)) for r in ROWS[:400]]
    got = {m: {r.id: r.weight for r in sampling.balanced_weights(df, m, "dataset", "state", "grp", 0.3).collect()} for m in ("uniform", "state", "hybrid")}
    uniform, state = chances(rows, ["dataset", "grp"]), chances(rows, ["dataset", "state", "grp"])
    for k in uniform:
        assert got["uniform"][k] == pytest.approx(uniform[k]) and got["state"][k] == pytest.approx(state[k]) and got["hybrid"][k] == pytest.approx(0.3 * state[k] + 0.7 * uniform[k])
    assert all(sum(w.values()) == pytest.approx(1) and len(w) == 400 for w in got.values())
    with pytest.raises(ValueError, match="mode"):
        sampling.balanced_weights(df, "odd", "dataset", "state", "grp")
    tasks = {r.id: r.weight for r in sampling.task_weights(df, "family", "target", "dataset", "state", "grp", 0.7).filter("id < 900").collect()}
    shares = defaultdict(float)
    for r in rows:
        shares[r["family"], r["target"] if r["family"] == "target" else None] += tasks[r["id"]]
    assert shares["global", None] == pytest.approx(0.3, abs=0.05) and all(shares["target", t] == pytest.approx(0.7 / 3) for t in (1, 2, 3))
    only = sampling.task_weights(df.filter("family = 'global' AND id < 900"), "family", "target", "dataset", "state", "grp")
    assert only.agg(F.sum("weight")).first()[0] == pytest.approx(1) and sampling.task_weights(df.limit(0), "family", "target", "dataset", "state", "grp").count() == 0
    assert {tuple(r) for r in sampling.mixed_groups(df, "dataset", "state", "grp").collect()} == {("b", f"g{k}") for k in range(7)}


def test_shares_of_the_first_level(spark):
    df = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(9)], "id int, level string")
    got = {r.level: r.weight for r in sampling.group_weights(df, ["level"], {"a": 0.2, "b": 0.2, "gone": 0.6}).collect()}
    assert got["a"] == pytest.approx(0.5 / 3) and got["b"] == pytest.approx(0.5 / 3) and got["c"] == 0


def test_draws_are_the_smallest_exponential_keys(spark):
    """Reruns agree, any number is drawn exactly, heavy rows are drawn as often as their weight says."""
    df = spark.range(4000).withColumn("weight", F.when(F.col("id") % 4 == 0, 3.0).when(F.col("id") == 1, 0.0).otherwise(1.0))
    for n in (1, 399, 2000):
        one = {r.id for r in sampling.draw(df, "id", n, 5).collect()}
        assert len(one) == n and one == {r.id for r in sampling.draw(df.repartition(7), "id", n, 5).collect()} and 1 not in one
    heavy = sum(k % 4 == 0 for k in {r.id for r in sampling.draw(df, "id", 400, 5).collect()})
    assert abs(heavy - 200) < 45  # about half of the mass is heavy
    assert sampling.draw(df, "id", 9999).count() == 3999 and sampling.draw(df.limit(0), "id", 3).count() == 0
