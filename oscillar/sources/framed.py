"""Framed acquisition files: a frame is samples x axes numbers, optionally after a 4-byte counter, and a float64 time.

The stream of frames may be cut into packets, each with a 4-byte counter before it; frames then run on across packets. Tasks read
ranges of frames. What a range needs of the frames before it, the time of the last one, comes from a first pass over the
frames' times alone, so that ranges give what one pass over the file would give.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from oscillar.sources.shared import data_files, store_of

SENSITIVITY_G = 4.88e-4
#: bytes of a file that a task decodes.
RANGE_BYTES = 32 << 20
PACKET_COUNTER = 4


def frame_type(samples: int, axes: int, counter: bool = False, number: str = "<i2") -> np.dtype:
    parts = [("counter", "<u4")] if counter else []
    return np.dtype([*parts, ("data", number, (samples, axes)), ("time", "<f8")])


@dataclass(frozen=True)
class Layout:
    """What a file of a component looks like. packet: bytes of the stream between two packet counters (0: there are none)."""

    samples: int
    axes: int = 3
    counter: bool = False
    number: str = "<i2"
    packet: int = 0
    sensitivity: float = SENSITIVITY_G
    period: float = 1.0

    @property
    def kind(self) -> np.dtype:
        return frame_type(self.samples, self.axes, self.counter, self.number)

    @property
    def per_range(self) -> int:
        return max(1, RANGE_BYTES // self.kind.itemsize)

    @property
    def names(self) -> list[str]:
        return list("xyz")[: self.axes] if self.axes <= 3 else [f"a{k}" for k in range(self.axes)]

    @property
    def schema(self) -> str:
        return "file string, seq long, ts double, " + ", ".join(f"{c} double" for c in self.names)

    def whole_frames(self, length: int) -> int:
        """Frames of a file of so many bytes; a last packet or frame that is not whole doesn't count."""
        stream = length // (self.packet + PACKET_COUNTER) * self.packet if self.packet else length
        return stream // self.kind.itemsize

    def frames(self, f, first: int, end: int) -> np.ndarray:
        """Frames first to end of an open file."""
        at, n = first * self.kind.itemsize, (end - first) * self.kind.itemsize
        if not self.packet:
            f.seek(at)
            return np.frombuffer(f.read(n), self.kind)
        low, high = at // self.packet, -(-(at + n) // self.packet)
        f.seek(low * (self.packet + PACKET_COUNTER))
        packets = np.frombuffer(f.read((high - low) * (self.packet + PACKET_COUNTER)), np.uint8).reshape(-1, self.packet + PACKET_COUNTER)
        skip = at - low * self.packet
        return np.frombuffer(packets[:, PACKET_COUNTER:].tobytes()[skip : skip + n], self.kind)

    def times(self, f, first: int, end: int) -> np.ndarray:
        """The times of frames first to end; of large frames without packets nothing else is read."""
        size = self.kind.itemsize
        if self.packet or size < 1 << 14:
            return self.frames(f, first, end)["time"]
        out = np.empty(end - first)
        for k in range(first, end):
            f.seek((k + 1) * size - 8)
            out[k - first] = np.frombuffer(f.read(8), "<f8")[0]
        return out

    def samples_of(self, f, name: str, first: int, end: int, before: float | None):
        """Record batches of the samples of frames first to end; before: the time of the frame before them."""
        step = max(1, 100_000 // self.samples)
        for lo in range(first, end, step):
            hi = min(lo + step, end)
            frames = self.frames(f, lo, hi)
            ts, sound, fixed = sample_times(frames["time"], self.samples, self.period, before)
            before = float(fixed[-1])
            data = (frames["data"].astype(np.float64) * self.sensitivity * sound[:, None, None]).reshape(-1, self.axes)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ts)), pa.array(lo * self.samples + np.arange(len(ts))), pa.array(ts), *(pa.array(np.ascontiguousarray(data[:, a])) for a in range(self.axes))], names=["file", "seq", "ts", *self.names])


def frame_times(ends: np.ndarray, period: float, before: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, corrected times, whether each frame is sound) from the frames' own times.

    A frame begins at the one before it; a frame later than 1.33 periods is timed back from its own time by one period. A
    frame whose time is no number, or less than 0.1 or more than 10 periods after the one before, is not sound and gets the
    time that was due.
    """
    begins, fixed, sound = np.empty(len(ends)), np.empty(len(ends)), np.ones(len(ends), bool)
    last = before
    for k, t in enumerate(ends.tolist()):
        if last is None:
            last = t - period if np.isfinite(t) else 0.0
        gap = t - last
        if not np.isfinite(gap) or gap < 0.1 * period or gap > 10 * period:
            sound[k], t = False, last + period
            gap = period
        begins[k] = last if gap <= 1.33 * period else t - period
        fixed[k] = last = t
    return begins, fixed, sound


def sample_times(ends: np.ndarray, samples: int, period: float, before: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times of all samples, whether each frame is sound, corrected frame times): samples run evenly over their frame."""
    begins, fixed, sound = frame_times(ends, period, before)
    return (begins[:, None] + (fixed - begins)[:, None] * (np.arange(1, samples + 1) / samples)).ravel(), sound, fixed


def _ranges(spark: SparkSession, path: str, layout: Layout, glob: str) -> DataFrame:
    """path, first, end: the ranges of frames of every file, from its length alone."""
    stream = f"(length DIV {layout.packet + PACKET_COUNTER}) * {layout.packet}" if layout.packet else "length"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.expr(f"({stream}) DIV {layout.kind.itemsize}").alias("frames")).filter("frames > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(layout.per_range).cast("long")))
    return files.select("path", "frames", first.alias("first")).select("path", "first", F.least(F.col("first") + layout.per_range, F.col("frames")).alias("end"))


def _opened(uri: str):
    store, at = store_of(uri)
    return store.open_input_file(at), at.rpartition("/")[2]


def timed_ranges(ranges: DataFrame, layout: Layout) -> DataFrame:
    """path, first, end, before (time of the frame before), opens, closes: ranges of _ranges() with their times.

    Times are read range by range; the chain of a file then runs over its times in order, some bytes for each frame.
    """

    def read(batches):
        for b in batches:
            for uri, first, end in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                f, _ = _opened(uri)
                with f:
                    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([first]), pa.array([end]), pa.array([layout.times(f, first, end)], pa.list_(pa.float64()))], names=["path", "first", "end", "times"])

    def chain(batches):
        path, last = None, None
        for b in batches:
            for k in range(b.num_rows):
                if b.column(0)[k].as_py() != path:
                    path, last = b.column(0)[k].as_py(), None
                begins, fixed, _ = frame_times(b.column(3)[k].values.to_numpy(), layout.period, last)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in range(3)), pa.array([last], pa.float64()), pa.array(begins[:1]), pa.array(fixed[-1:])], names=["path", "first", "end", "before", "opens", "closes"])
                last = float(fixed[-1])

    times = ranges.repartition(F.col("path"), F.col("first")).mapInArrow(read, "path string, first long, end long, times array<double>")
    ordered = times.repartition(F.col("path")).sortWithinPartitions("path", "first")
    return ordered.mapInArrow(chain, "path string, first long, end long, before double, opens double, closes double")


def read_framed(
    spark: SparkSession, path: str, samples: int, axes: int = 3, counter: bool = False, sensitivity: float = SENSITIVITY_G, glob: str = "*.dat", period: float = 1.0, low: float | None = None, high: float | None = None,
    number: str = "<i2", packet: int = 0,
) -> DataFrame:
    """file, seq, ts (seconds), x, y, z ... in g for every sample of frames that are `period` seconds apart, within [low, high) if given.

    Bounds select ranges of frames before any sample is read. Frames that are not sound (see frame_times) are zero. Trailing
    bytes that are no whole frame are left out; an empty file gives no rows.
    """
    layout = Layout(samples, axes, counter, number, packet, sensitivity, period)
    ranges = timed_ranges(_ranges(spark, path, layout, glob), layout)
    ranges = ranges if low is None else ranges.filter(F.col("closes") >= low)
    ranges = ranges if high is None else ranges.filter(F.col("opens") < high)

    def run(batches):
        for b in batches:
            for uri, first, end, before in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                f, name = _opened(uri)
                with f:
                    yield from layout.samples_of(f, name, first, end, before)

    rows = ranges.select("path", "first", "end", "before").repartition(F.col("path"), F.col("first")).mapInArrow(run, layout.schema)
    rows = rows if low is None else rows.filter(F.col("ts") >= low)
    return rows if high is None else rows.filter(F.col("ts") < high)


def converted(spark: SparkSession, path: str, out: str, **layout) -> DataFrame:
    """The samples of framed files as a Parquet table at `out`; a table that is complete is read and not made again."""
    store, at = store_of(out)
    if not store.get_file_info(f"{at}/_SUCCESS").is_file:
        read_framed(spark, path, **layout).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def lost_packets(spark: SparkSession, path: str, samples: int, axes: int = 3, glob: str = "*.dat") -> DataFrame:
    """file, frames, lost: counters that are missing between the frames of files with counters."""
    layout = Layout(samples, axes, True)

    def run(batches):
        for b in batches:
            for uri, first, end in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                f, name = _opened(uri)
                with f:
                    c = layout.frames(f, max(first - 1, 0), end)["counter"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([end - first]), pa.array([int(np.maximum(np.diff(c) - 1, 0).sum())])], names=["file", "frames", "lost"])

    found = _ranges(spark, path, layout, glob).repartition(F.col("path"), F.col("first")).mapInArrow(run, "file string, frames long, lost long")
    return found.groupBy("file").agg(F.sum("frames").alias("frames"), F.sum("lost").alias("lost"))


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    end: int
    before: float | None


class FramedStreamReader(DataSourceStreamReader):
    """Frames as they are added to the files of a folder. The offset holds, for each file, its whole frames and the time of the last one.

    Bytes that are no whole frame yet stay for a later batch. The driver reads the times of new frames and nothing else; tasks
    read the samples. After a restart the times of a file are read once more from its start.
    """

    def __init__(self, path: str, ending: str, layout: Layout):
        self.path, self.ending, self.layout = path, ending, layout
        self.known: dict[str, list] = {}

    def initialOffset(self):
        return {}

    def advanced(self, uri: str, first: int, before: float | None, end: int) -> float | None:
        """The corrected time of frame end - 1, given that of frame first - 1."""
        f, _ = _opened(uri)
        with f:
            for lo in range(first, end, self.layout.per_range):
                before = float(frame_times(self.layout.times(f, lo, min(lo + self.layout.per_range, end)), self.layout.period, before)[1][-1])
        return before

    def latestOffset(self):
        for uri in data_files(self.path, (self.ending,)):
            store, at = store_of(uri)
            frames = self.layout.whole_frames(store.get_file_info(at).size)
            held, last = self.known.get(uri, [0, None])
            if frames > held:
                self.known[uri] = [frames, self.advanced(uri, held, last, frames)]
        return dict(self.known)

    def partitions(self, start, end):
        out = []
        for uri, (frames, last) in sorted(end.items()):
            self.known[uri] = max(self.known.get(uri, [0, None]), [frames, last], key=lambda x: x[0])
            first, before = start.get(uri, [0, None])
            while first < frames:
                to = min(first + self.layout.per_range, frames)
                out.append(FrameRange(uri, first, to, before))
                if to < frames:
                    before = self.advanced(uri, first, before, to)
                first = to
        return out

    def read(self, partition):
        if partition is None:
            return
        f, name = _opened(partition.path)
        with f:
            yield from self.layout.samples_of(f, name, partition.first, partition.end, partition.before)


class FramedSource(DataSource):
    """Format "framed" for readStream. Options: samples, axes, counter, number, packet, sensitivity, period (see Layout), ending (.dat)."""

    @classmethod
    def name(cls):
        return "framed"

    def layout(self) -> Layout:
        o = self.options
        return Layout(
            int(o["samples"]), int(o.get("axes", 3)), str(o.get("counter", "false")).lower() == "true", o.get("number", "<i2"), int(o.get("packet", 0)), float(o.get("sensitivity", SENSITIVITY_G)), float(o.get("period", 1.0))
        )

    def schema(self):
        return self.layout().schema

    def streamReader(self, schema):
        return FramedStreamReader(self.options["path"], self.options.get("ending", ".dat"), self.layout())


def stream_framed(spark: SparkSession, path: str, samples: int, **options) -> DataFrame:
    """The samples of framed files as a stream, with the columns of read_framed()."""
    spark.dataSource.register(FramedSource)
    return spark.readStream.format("framed").options(samples=samples, **options).load(path)


def write_framed(samples: DataFrame, path: str, layout: Layout) -> DataFrame:
    """file, frames: writes frames (file, frame, time, data: array of samples x axes numbers) as framed files, a file by one task.

    Frames lie in their order. A file has a hidden name until it is whole, so what a lost task has left is never read.
    Numbers that the layout's number type can't hold are an error.
    """
    kind = layout.kind
    whole = np.dtype(layout.number)
    bounds = np.iinfo(whole) if whole.kind in "iu" else None
    if layout.packet >= kind.itemsize:
        raise ValueError("the rest of a last packet would read as a frame; packets must be smaller than a frame")

    def run(batches):
        store, folder = store_of(path)
        store.create_dir(folder)
        name, out, hidden, frames = None, None, None, 0
        rest = b""
        packets = 0

        def close():
            nonlocal rest, packets
            if layout.packet and rest:
                out.write(np.uint32(packets).tobytes() + rest.ljust(layout.packet, b"\0"))
            out.close()
            rest, packets = b"", 0
            store.move(f"{folder}/{hidden}", f"{folder}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([frames])], names=["file", "frames"])

        for b in batches:
            files = b.column(0).to_pylist()
            data = b.column(3)
            flat, at = data.values.to_numpy(), np.asarray(data.offsets)
            numbers, times = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(files):
                hi = lo + 1
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                if files[lo] != name:
                    if out:
                        yield close()
                    name, hidden, frames = files[lo], f".{files[lo]}-{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(f"{folder}/{hidden}")
                block = np.zeros(hi - lo, kind)
                values = flat[at[lo] : at[hi]]
                if bounds and len(values) and not (bounds.min <= values.min() and values.max() <= bounds.max):
                    raise ValueError(f"{files[lo]}: numbers from {values.min()} to {values.max()} don't fit {layout.number}")
                block["data"] = values.reshape(hi - lo, layout.samples, layout.axes)
                block["time"] = times[lo:hi]
                if layout.counter:
                    block["counter"] = numbers[lo:hi]
                content = block.tobytes()
                if layout.packet:
                    rest += content
                    while len(rest) >= layout.packet:
                        out.write(np.uint32(packets).tobytes() + rest[: layout.packet])
                        rest, packets = rest[layout.packet :], packets + 1
                else:
                    out.write(content)
                frames += hi - lo
                lo = hi
        if out:
            yield close()

    rows = samples.select("file", "frame", "time", "data").repartition(F.col("file")).sortWithinPartitions("file", "frame")
    return rows.mapInArrow(run, "file string, frames long")


def framed_bytes(values: np.ndarray, times: np.ndarray, samples: int, counter: bool = False) -> bytes:
    """Bytes of whole frames of int16 rows (n x axes) with a time for each frame."""
    kind = frame_type(samples, values.shape[1], counter)
    out = np.zeros(len(values) // samples, kind)
    out["data"] = values[: len(out) * samples].reshape(len(out), samples, -1)
    out["time"] = times[: len(out)]
    if counter:
        out["counter"] = np.arange(len(out))
    return out.tobytes()


def export_long_csv(windows: DataFrame, reports: DataFrame, path: str) -> None:
    """Validation export: one CSV row per sample of arrays x (sensor, win), with the sensor's report (label, confidence) or its defaults; header included."""
    told = windows.join(reports.select("sensor", "win", "label", "confidence"), ["sensor", "win"], "left")
    told = told.select("sensor", "win", F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.posexplode("x").alias("sample", "value"))
    told.write.mode("errorifexists").option("header", True).csv(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, modified of every file; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_signals(spark: SparkSession, path: str, columns: dict[str, str], separator: str = ",", decimal: str = ".") -> DataFrame:
    """Text signals with a header: columns names each output and its header; numbers by the given decimal sign, rows without any number left out."""
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    sound = {out: F.replace(F.trim(F.col(f"`{name}`")), F.lit(decimal), F.lit(".")).try_cast("double") for out, name in columns.items()}
    return raw.select(*(c.alias(out) for out, c in sound.items())).dropna("all")


def read_replay_csv(spark: SparkSession, path: str) -> DataFrame:
    """time_s, acceleration_g of replay files, with the file's name."""
    rows = spark.read.schema("time_s double, acceleration_g double").option("header", True).csv(path)
    return rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Window history in JSON lines, one row per sensor: ts, label, q, sensor, rms, peak, ppv, spec."""
    schema = "ts string, label string, q int, sensors map<string, map<string, double>>"
    rows = spark.read.schema(schema).json(path)
    at = rows.select("ts", "label", "q", F.explode("sensors").alias("sensor", "m"))
    return at.select("ts", "label", "q", "sensor", *(F.element_at("m", F.lit(c)).alias(c) for c in ("rms", "peak", "ppv", "spec")))

