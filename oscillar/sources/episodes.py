"""Episode store: arrays of episodes in NPZ bundles, their documents in JSON lines beside them, and a ledger of what was skipped.

One pass writes all three. A task puts episodes into bundles of BUNDLE bytes; files have hidden names until every task is through,
so a job that fails leaves no episode, no document and no line of the ledger to see. The driver is told counts alone.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from oscillar.sources.shared import data_files, store_of

FORMAT = "2.0"
BOARDS, AXES = 6, 3
#: bytes of the arrays of a bundle; an episode that is larger has a bundle of its own.
BUNDLE = 64 << 20
COLUMNS = ["episode_id", "dataset", "split", "sample_rate_hz", "values", "axis_mask", "sample_mask", "metadata"]
SCHEMA = "episode_id string, dataset string, split string, sample_rate_hz double, values array<float>, axis_mask array<boolean>, sample_mask array<boolean>, metadata string"


def fault(row: dict, least: int) -> str | None:
    """Why an episode can't be stored; null if it can."""
    if not row["episode_id"]:
        return "no_id"
    values, axes, samples = row["values"], row["axis_mask"], row["sample_mask"]
    if values is None or len(values) == 0 or len(values) % (BOARDS * AXES):
        return "incomplete_boards"
    if axes is None or samples is None or len(axes) != BOARDS * AXES or len(samples) * AXES != len(values):
        return "masks_do_not_match"
    if len(values) < least * BOARDS * AXES:
        return "too_short"
    if not row["sample_rate_hz"] or not np.isfinite(row["sample_rate_hz"]) or row["sample_rate_hz"] <= 0:
        return "no_sample_rate"
    try:
        ok = isinstance(json.loads(row["metadata"] or "{}"), dict)
    except ValueError:
        ok = False
    return None if ok else "metadata_no_object"


@dataclass
class Stored(WriterCommitMessage):
    files: list[str]
    kept: int = 0
    skipped: Counter = field(default_factory=Counter)


class EpisodeWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, least: int):
        self.folder, self.least = folder.rstrip("/"), least

    def write(self, iterator):
        store, folder = store_of(self.folder)
        for sub in ("episodes", "ledger"):
            store.create_dir(f"{folder}/{sub}")
        told = Stored([])
        bundle, documents, size = None, [], 0

        def put(name: str, content: bytes):
            sub, _, leaf = name.rpartition("/")
            with store.open_output_stream(f"{folder}/{sub}/.{leaf}") as f:
                f.write(content)
            told.files.append(name)

        def flush():
            nonlocal bundle, documents, size
            if documents:
                name = f"part-{uuid.uuid4().hex}"
                bundle[1].close()
                put(f"episodes/{name}.npz", bundle[0].getvalue())
                lines = [json.dumps({**d, "array_file": f"{name}.npz"}) for d in documents]
                put(f"episodes/{name}.json", "\n".join(lines).encode() + b"\n")
            bundle, documents, size = None, [], 0

        skipped: list[str] = []
        for batch in iterator:
            held = {c: batch.column(k) for k, c in enumerate(COLUMNS)}
            for i in range(batch.num_rows):
                array = lambda c: None if not held[c][i].is_valid else held[c][i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                row = {c: array(c) if c in ("values", "axis_mask", "sample_mask") else held[c][i].as_py() for c in COLUMNS}
                reason = fault(row, self.least)
                if reason:
                    told.skipped[reason] += 1
                    skipped.append(json.dumps({"episode_id": row["episode_id"], "dataset": row["dataset"], "split": row["split"], "reason": reason}))
                    if len(skipped) >= 100_000:
                        put(f"ledger/part-{uuid.uuid4().hex}.json", "\n".join(skipped).encode() + b"\n")
                        skipped.clear()
                    continue
                if bundle is None:
                    raw = io.BytesIO()
                    bundle = raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                parts = {"values": row["values"].astype(np.float32).reshape(BOARDS, AXES, -1), "axis_mask": row["axis_mask"].astype(bool).reshape(BOARDS, AXES), "sample_mask": row["sample_mask"].astype(bool).reshape(BOARDS, -1)}
                for name, m in parts.items():
                    out = io.BytesIO()
                    np.save(out, m)
                    bundle[1].writestr(f"{len(documents)}/{name}.npy", out.getvalue())
                    size += m.nbytes
                told.kept += 1
                documents.append({"format_version": FORMAT, "member": len(documents), **{c: row[c] for c in ("episode_id", "dataset", "split", "sample_rate_hz")}, "metadata": json.loads(row["metadata"] or "{}")})
                if size >= BUNDLE:
                    flush()
        flush()
        if skipped:
            put(f"ledger/part-{uuid.uuid4().hex}.json", "\n".join(skipped).encode() + b"\n")
        return told

    def commit(self, messages):
        store, folder = store_of(self.folder)
        for name in (n for m in messages if m for n in m.files):
            sub, _, leaf = name.rpartition("/")
            store.move(f"{folder}/{sub}/.{leaf}", f"{folder}/{name}")

    def abort(self, messages):
        store, folder = store_of(self.folder)
        for name in (n for m in messages if m for n in m.files):
            sub, _, leaf = name.rpartition("/")
            store.delete_file(f"{folder}/{sub}/.{leaf}")


@dataclass
class Bundle(InputPartition):
    path: str


class EpisodeReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def partitions(self):
        return [Bundle(p) for p in data_files(f"{self.folder}/episodes", (".npz",))]

    def read(self, partition):
        if partition is None:
            return
        store, path = store_of(partition.path)
        with store.open_input_stream(path[:-4] + ".json") as f:
            documents = [json.loads(line) for line in f.read().decode().splitlines()]
        schema = pa.schema([("episode_id", pa.string()), ("dataset", pa.string()), ("split", pa.string()), ("sample_rate_hz", pa.float64()), ("values", pa.list_(pa.float32())), ("axis_mask", pa.list_(pa.bool_())), ("sample_mask", pa.list_(pa.bool_())), ("metadata", pa.string())])
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for d in documents:
                if d.get("format_version") != FORMAT:
                    raise ValueError(f"{partition.path}: format {d.get('format_version')!r}, not {FORMAT}")
                m = {name: np.lib.format.read_array(io.BytesIO(z.read(f"{d['member']}/{name}.npy"))) for name in ("values", "axis_mask", "sample_mask")}
                if m["values"].shape[:2] != (BOARDS, AXES) or m["axis_mask"].shape != (BOARDS, AXES) or m["sample_mask"].shape != (BOARDS, m["values"].shape[-1]):
                    raise ValueError(f"{partition.path}: arrays of {d['episode_id']} don't match")
                row = [d["episode_id"], d["dataset"], d["split"], d["sample_rate_hz"], *(a.ravel() for a in m.values()), json.dumps(d["metadata"], sort_keys=True)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)


class EpisodeSource(DataSource):
    """Format "episodes": a folder with episodes/ (bundles and documents) and ledger/ (skipped rows with their reasons).

    Option least: samples that an episode needs (1).
    """

    @classmethod
    def name(cls):
        return "episodes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return EpisodeReader(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("episodes are added to a store, not overwritten")
        return EpisodeWriter(self.options["path"], int(self.options.get("least", 1)))


def save_episodes(episodes: DataFrame, path: str, least: int = 1) -> None:
    """Adds episodes (COLUMNS; values by board, axis and sample) to a store. Rows that can't be stored go to the ledger with the first reason."""
    spark = episodes.sparkSession
    spark.dataSource.register(EpisodeSource)
    kinds = dict(part.strip().split() for part in SCHEMA.split(","))
    episodes.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS)).write.format("episodes").mode("append").option("least", least).save(path)


def load_episodes(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(EpisodeSource)
    return spark.read.format("episodes").load(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """episode_id, dataset, split, sample_rate_hz, array_file of a store; arrays are not read."""
    return spark.read.schema("episode_id string, dataset string, split string, sample_rate_hz double, array_file string").json(f"{path}/episodes/*.json")


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """episode_id, dataset, split, reason of every row that was skipped."""
    return spark.read.schema("episode_id string, dataset string, split string, reason string").option("pathGlobFilter", "*.json").json(f"{path}/ledger")


def build_report(spark: SparkSession, path: str) -> DataFrame:
    """dataset, split, outcome (stored, or why not), n."""
    both = documents(spark, path).select("dataset", "split", F.lit("stored").alias("outcome")).unionByName(skipped(spark, path).select("dataset", "split", F.col("reason").alias("outcome")))
    return both.groupBy("dataset", "split", "outcome").agg(F.count(F.lit(1)).alias("n"))


def save_profile(profile: DataFrame, path: str) -> None:
    """A healthy profile (see corpus.healthy_profile) with its format."""
    profile.withColumn("format_version", F.lit(FORMAT)).write.parquet(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile of a folder; one of another format, or without counts, means and deviations, is an error."""
    held = spark.read.parquet(path)
    lacking = {"format_version", "n", "mean", "std"} - set(held.columns)
    if lacking:
        raise ValueError(f"{path}: no profile, it lacks {sorted(lacking)}")
    if not held.filter(F.col("format_version") != FORMAT).isEmpty():
        raise ValueError(f"{path}: a profile of another format than {FORMAT}")
    return held.drop("format_version")
