import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscillar.sources import episodes


def row(key, n=4, **other):
    values = (np.arange(18 * n) + hash(key) % 7).astype(np.float32).tolist()
    return {"episode_id": key, "dataset": "d", "split": "train", "sample_rate_hz": 100.0, "values": values, "axis_mask": [True] * 18, "sample_mask": [True] * (6 * n), "metadata": '{"b": 1, "a": [2]}', **other}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in episodes.COLUMNS) for r in rows], episodes.SCHEMA)


def test_round_trip_and_ledger(spark, tmp_path, monkeypatch):
    good = [row(f"e{k}", n=3 + k % 4) for k in range(12)] + [row("none", metadata=None)]
    bad = [
        row(None), row("", dataset=None), row("cut", values=[1.0] * 17), row("void", values=None), row("masks", axis_mask=[True]), row("short", n=1), row("rate", sample_rate_hz=-1.0),
        row("nan", sample_rate_hz=float("nan")), row("text", metadata="{"), row("list", metadata="[1]"),
    ]
    path = f"file://{tmp_path}/store"
    episodes.save_episodes(frame(spark, good + bad).repartition(4), path, least=2)
    got = {r.episode_id: r for r in episodes.load_episodes(spark, path).collect()}
    assert set(got) == {r["episode_id"] for r in good}
    for r in good:
        assert [got[r["episode_id"]][c] for c in episodes.COLUMNS[:-1]] == [r[c] for c in episodes.COLUMNS[:-1]]
        assert json.loads(got[r["episode_id"]].metadata) == json.loads(r["metadata"] or "{}")
    reasons = sorted((r.episode_id or "", r.reason) for r in episodes.skipped(spark, path).collect())
    want = [("", "no_id"), ("", "no_id"), ("cut", "incomplete_boards"), ("void", "incomplete_boards"), ("masks", "masks_do_not_match"), ("short", "too_short"), ("rate", "no_sample_rate"), ("nan", "no_sample_rate"), ("text", "metadata_no_object"), ("list", "metadata_no_object")]
    assert reasons == sorted(want)
    report = {(r.dataset, r.outcome): r.n for r in episodes.build_report(spark, path).collect()}
    assert report["d", "stored"] == 13 and report[None, "no_id"] == 1 and sum(report.values()) == 23


def test_small_bundles_and_a_second_save(spark, tmp_path):
    """A writer cuts bundles by size; a later save adds to the store."""
    writer = episodes.EpisodeWriter(f"file://{tmp_path}/s", 1)
    batches = frame(spark, [row(f"e{k}") for k in range(6)]).toArrow().to_batches()
    before, episodes.BUNDLE = episodes.BUNDLE, 2 * 4 * 18 * 4
    try:
        told = writer.write(iter(batches))
    finally:
        episodes.BUNDLE = before
    assert told.kept == 6 and len(told.files) == 6 and not list((tmp_path / "s" / "episodes").glob("part*"))
    writer.commit([told, None])
    assert episodes.load_episodes(spark, f"file://{tmp_path}/s").count() == 6
    episodes.save_episodes(frame(spark, [row("more")]), f"file://{tmp_path}/s")
    assert episodes.documents(spark, f"file://{tmp_path}/s").count() == 7


def test_a_failed_job_shows_nothing(spark, tmp_path):
    rows = frame(spark, [row(f"e{k}") for k in range(8)]).repartition(4).selectExpr("*", "1 AS extra")
    broken = rows.withColumn("dataset", F.expr("IF(episode_id = 'e5', raise_error('broken'), dataset)"))
    with pytest.raises(Exception, match="broken"):
        episodes.save_episodes(broken, f"file://{tmp_path}/s")
    assert not list(tmp_path.glob("s/*/part*"))


def test_profile_files(spark, tmp_path):
    profile = spark.createDataFrame([("a", 3, 1.0, 0.5)], "key string, n long, mean double, std double")
    episodes.save_profile(profile, f"{tmp_path}/p")
    assert episodes.load_profile(spark, f"{tmp_path}/p").collect() == profile.collect()
    profile.write.parquet(f"{tmp_path}/q")
    with pytest.raises(ValueError, match="format_version"):
        episodes.load_profile(spark, f"{tmp_path}/q")
    profile.selectExpr("*", "'1.0' AS format_version").write.parquet(f"{tmp_path}/r")
    with pytest.raises(ValueError, match="another format"):
        episodes.load_profile(spark, f"{tmp_path}/r")
