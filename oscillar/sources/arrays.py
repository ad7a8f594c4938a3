"""Numeric arrays in NPY, NPZ, MAT (version 5) and, where h5py can be imported, HDF5 files as a Spark data source.

    spark.dataSource.register(ArraySource)
    spark.read.format("arrays").option("axes", '{"x": ["signal", 0], "y": ["signal", 1]}').load(folder)

A partition is a range of samples: a task seeks to its part of each array and reads no more. Arrays that are compressed can't be
entered in the middle; such a file is one partition, read as a stream. Headers alone are read when the query is planned.
"""

from __future__ import annotations

import io
import json
import math
import struct
import uuid
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from oscillar.sources.shared import data_files, store_of

ENDINGS = (".npy", ".npz", ".mat", ".h5", ".hdf5", ".he5")
#: samples of a partition, of a batch, and of a file that is written.
RANGE, BATCH, PER_FILE = 1 << 22, 1 << 16, 1 << 20
#: fixed values of the MAT format: data types by number, and the numbers of its element and class kinds.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_STRUCT, MAT_NUMERIC = 14, 15, 2, range(6, 16)


@dataclass(frozen=True)
class Node:
    """Where the numbers of an array lie: at an offset of the file, in a zip member or in a compressed element that begins at `inside`."""

    kind: str
    dtype: str
    shape: tuple[int, ...]
    fortran: bool
    offset: int
    inside: str | int | None = None

    @property
    def seekable(self) -> bool:
        return self.inside is None or self.kind == "hdf5"

    @property
    def dims(self) -> tuple[int, ...]:
        """The shape without axes of length one; an array of one number is a signal of one sample only if it has an axis."""
        if not self.shape:
            raise ValueError("a scalar is no signal")
        return tuple(n for n in self.shape if n != 1) or (1,)


class Inflated(io.RawIOBase):
    """A zlib stream of a file, from a place on; it can be read and skipped forward."""

    def __init__(self, raw, at: int):
        raw.seek(at)
        self.raw, self.engine, self.held, self.at = raw, zlib.decompressobj(), b"", 0

    def read(self, n: int = -1) -> bytes:
        while len(self.held) < n and not self.engine.eof:
            more = self.engine.unconsumed_tail or self.raw.read(1 << 16)
            if not more:
                break
            self.held += self.engine.decompress(more, 1 << 20)
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def seek(self, to: int, whence: int = 0) -> int:
        if to < self.at:
            raise ValueError("a compressed element is read forward only")
        while self.at < to and self.read(min(to - self.at, 1 << 20)):
            pass
        return self.at

    def tell(self) -> int:
        return self.at


def npy_header(f) -> tuple[str, tuple[int, ...], bool]:
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    return dtype.str, shape, fortran


def zip_nodes(f) -> dict[str, Node]:
    out = {}
    with zipfile.ZipFile(f) as z:
        for info in z.infolist():
            if info.filename.endswith(".npy"):
                with z.open(info) as m:
                    dtype, shape, fortran = npy_header(m)
                    header = m.tell()
                if info.compress_type == zipfile.ZIP_STORED:
                    f.seek(info.header_offset + 26)
                    names = sum(struct.unpack("<HH", f.read(4)))
                    out[info.filename[:-4]] = Node("npz", dtype, shape, fortran, info.header_offset + 30 + names + header)
                else:
                    out[info.filename[:-4]] = Node("npz", dtype, shape, fortran, header, info.filename)
    return out


def mat_element(f) -> bytes:
    """The content of the element at hand, which is small; f then stands at the next one."""
    kind, size = struct.unpack("<II", f.read(8))
    if kind >> 16:  # up to four bytes lie in the tag itself
        return struct.pack("<I", size)[: kind >> 16]
    content = f.read(size)
    f.seek(f.tell() + -size % 8)
    return content


def mat_matrix(f, name_before: str, inside: int | None, out: dict[str, Node]) -> None:
    """Adds the numeric arrays of the matrix element whose tag has just been read, those in fields of structs as a/b."""
    flags = struct.unpack("<II", mat_element(f))[0]
    shape = tuple(np.frombuffer(mat_element(f), "<i4").tolist())
    name = mat_element(f).decode()
    name = f"{name_before}/{name}" if name_before and name else name_before or name
    if flags & 0xFF == MAT_STRUCT and math.prod(shape) == 1:
        width = int(np.frombuffer(mat_element(f), "<i4")[0])
        fields = mat_element(f)
        for k in range(0, len(fields), width):
            kind, size = struct.unpack("<II", f.read(8))
            following = f.tell() + size
            if kind == MAT_MATRIX and size:
                mat_matrix(f, f"{name}/{fields[k : k + width].rstrip(bytes(1)).decode()}", inside, out)
            f.seek(following)
    elif flags & 0xFF in MAT_NUMERIC and not flags & 0x800:
        kind = struct.unpack("<II", f.read(8))[0]
        small = bool(kind >> 16)
        out[name] = Node("mat", "<" + MAT_TYPES[kind & 0xFFFF], shape, True, f.tell() - 4 * small, inside)


def mat_nodes(f, size: int) -> dict[str, Node]:
    out: dict[str, Node] = {}
    f.seek(126)
    if f.read(2) != b"IM":
        raise ValueError("no little-endian MAT file of version 5")
    at = 128
    while at + 8 <= size:
        f.seek(at)
        kind, n = struct.unpack("<II", f.read(8))
        if kind == MAT_COMPRESSED:
            stream = Inflated(f, at + 8)
            if struct.unpack("<II", stream.read(8))[0] == MAT_MATRIX:
                mat_matrix(stream, "", at + 8, out)
        elif kind == MAT_MATRIX:
            mat_matrix(f, "", None, out)
        at += 8 + n
    return out


def hdf5_nodes(f) -> dict[str, Node]:
    import h5py  # only where it is installed

    out = {}
    with h5py.File(f, "r") as h:
        h.visititems(lambda name, x: out.__setitem__(name, Node("hdf5", x.dtype.str, x.shape, False, 0, name)) if isinstance(x, h5py.Dataset) else None)
    return out


def nodes_of(f, size: int, name: str) -> dict[str, Node]:
    """The arrays of an open file by their path in it; a NPY file has one, `data`."""
    f.seek(0)
    lead = f.read(8)
    f.seek(0)
    if lead.startswith(b"\x93NUMPY"):
        dtype, shape, fortran = npy_header(f)
        return {"data": Node("npy", dtype, shape, fortran, f.tell())}
    if lead.startswith(b"PK"):
        return zip_nodes(f)
    if lead.startswith(b"\x89HDF"):
        return hdf5_nodes(f)
    if name.lower().endswith(".mat"):
        return mat_nodes(f, size)
    raise ValueError("not a file of numeric arrays")


def signal_length(node: Node, channel: int, sample_axis: int) -> int:
    """Samples of a channel; raises if there is no such channel."""
    if np.dtype(node.dtype).kind not in "iufb":
        raise ValueError("not numeric")
    dims = node.dims
    if len(dims) > 2:
        raise ValueError(f"a signal has one or two dimensions, not {dims}")
    channels = dims[1 - sample_axis] if len(dims) == 2 else 1
    if not 0 <= channel < channels:
        raise ValueError(f"channel {channel} is outside of the shape {dims}")
    return dims[sample_axis if len(dims) == 2 else 0]


def entered(f, node: Node):
    """A file to read the numbers of the node from, at node.offset and beyond."""
    if node.inside is None:
        return f
    return zipfile.ZipFile(f).open(node.inside) if node.kind == "npz" else Inflated(f, node.inside)


def blocks(reopen, node: Node, channels: list[int], sample_axis: int, first: int, end: int):
    """Samples first to end of the channels, BATCH at a time, as matrices of doubles [samples, channels].

    Samples that lie side by side are read once for all channels; channels that lie one after the other are read each where
    it lies, so other channels are not read.
    """
    if node.kind == "hdf5":
        import h5py

        held = h5py.File(reopen(), "r")[node.inside]
        for lo in range(first, end, BATCH):
            hi = min(lo + BATCH, end)
            part = np.squeeze(held[(slice(lo, hi),) if sample_axis == 0 or held.ndim == 1 else (slice(None), slice(lo, hi))])
            part = part.reshape(hi - lo, -1) if sample_axis == 0 or held.ndim == 1 else part.reshape(-1, hi - lo).T
            yield part[:, channels].astype(np.float64)
        return
    dims, kind = node.dims, np.dtype(node.dtype)
    together = len(dims) == 1 or (sample_axis == 0) != node.fortran
    if together:
        width = dims[1 - sample_axis] if len(dims) == 2 else 1
        files, starts, width = [entered(reopen(), node)], [first * width], width
    else:
        files, starts, width = [entered(reopen(), node) for _ in channels], [c * dims[sample_axis] + first for c in channels], 1
    for f, at in zip(files, starts, strict=True):
        f.seek(node.offset + at * kind.itemsize)
    for lo in range(first, end, BATCH):
        n = min(BATCH, end - lo)
        parts = [np.frombuffer(f.read(n * width * kind.itemsize), kind).reshape(n, width) for f in files]
        yield (parts[0][:, channels] if together else np.hstack(parts)).astype(np.float64)


@dataclass
class ArrayRange(InputPartition):
    path: str
    first: int
    end: int
    nodes: dict[str, Node]


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, axes: dict[str, tuple[str, int]], sample_axis: int, most: int):
        self.path, self.axes, self.sample_axis, self.most = path, axes, sample_axis, most
        self.low, self.high = 0, None

    def ranges(self, uri: str) -> list[ArrayRange]:
        store, path = store_of(uri)
        with store.open_input_file(path) as f:
            found = nodes_of(f, f.size(), path)
        lengths = {}
        for axis, (name, channel) in self.axes.items():
            if name not in found:
                raise ValueError(f"{uri}: no array {name!r}, only {sorted(found)}")
            try:
                lengths[axis] = signal_length(found[name], channel, self.sample_axis)
            except ValueError as e:
                raise ValueError(f"{uri}: {name}: {e}") from None
        if len(set(lengths.values())) > 1:
            raise ValueError(f"{uri}: axes differ in length: {lengths}")
        n = next(iter(lengths.values()), 0)
        nodes = {name: found[name] for name, _ in self.axes.values()}
        low, high = min(self.low, n), n if self.high is None else max(min(self.high, n), 0)
        step = self.most if all(x.seekable for x in nodes.values()) else max(n, 1)
        return [ArrayRange(uri, k, min(k + step, high), nodes) for k in range(low, high, step)]

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:
            return [r for part in pool.map(self.ranges, data_files(self.path, ENDINGS)) for r in part]

    def read(self, partition):
        if partition is None:  # Spark asks so where there are no ranges
            return
        store, path = store_of(partition.path)
        by_node: dict[str, list[str]] = {}
        for axis, (name, _) in self.axes.items():
            by_node.setdefault(name, []).append(axis)
        streams = [(held, blocks(lambda: store.open_input_file(path), partition.nodes[name], [self.axes[a][1] for a in held], self.sample_axis, partition.first, partition.end)) for name, held in by_node.items()]
        name = path.rpartition("/")[2]
        for lo in range(partition.first, partition.end, BATCH):
            values = {a: m[:, k] for held, stream in streams for m in [next(stream)] for k, a in enumerate(held)}
            n = min(BATCH, partition.end - lo)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(lo, lo + n)), *(pa.array(np.ascontiguousarray(values[a])) for a in self.axes)], names=["file", "seq", *self.axes])


class BoundedArrayReader(ArrayReader):
    def pushFilters(self, filters):
        """Bounds on seq become ranges of samples; what is not of that kind is left to Spark."""
        for f in filters:
            known = getattr(f, "attribute", None) == ("seq",) and isinstance(getattr(f, "value", None), int)
            if known and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if known and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                end = f.value + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)
            if not (known and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual))):
                yield f


def mat_bytes(name: str, m: np.ndarray) -> bytes:
    """A MAT file with a matrix of doubles."""

    def element(kind: int, content: bytes) -> bytes:
        return struct.pack("<II", kind, len(content)) + content + bytes(-len(content) % 8)

    parts = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *m.shape)) + element(1, name.encode()) + element(9, m.astype("<f8").tobytes("F"))
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x100) + b"IM" + element(MAT_MATRIX, parts)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class ArrayWriter(DataSourceArrowWriter):
    """Each task writes hidden files of PER_FILE rows at most; they get their names when all tasks are through."""

    def __init__(self, folder: str, kind: str, node: str):
        self.folder, self.kind, self.node = folder.rstrip("/"), kind, node

    def write(self, iterator):
        store, folder = store_of(self.folder)
        store.create_dir(folder)
        held, size, files, rows = [], 0, [], 0

        def flush():
            m = np.concatenate(held)
            if self.kind == "mat":
                content = mat_bytes(self.node, m)
            else:
                out = io.BytesIO()
                np.savez(out, **{self.node: m})
                content = out.getvalue()
            name = f"part-{uuid.uuid4().hex}.{self.kind}"
            with store.open_output_stream(f"{folder}/.{name}") as f:
                f.write(content)
            files.append(name)
            held.clear()

        for batch in iterator:
            m = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(batch.num_columns)])
            while len(m):
                part, m = m[: PER_FILE - size], m[PER_FILE - size :]
                held.append(part)
                size += len(part)
                rows += len(part)
                if size == PER_FILE:
                    flush()
                    size = 0
        if size:
            flush()
        return Written(files, rows)

    def commit(self, messages):
        store, folder = store_of(self.folder)
        for name in (n for m in messages if m for n in m.files):
            store.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages):
        store, folder = store_of(self.folder)
        for name in (n for m in messages if m for n in m.files):
            store.delete_file(f"{folder}/.{name}")


class ArraySource(DataSource):
    """Format "arrays". Reading: axes (JSON: column → [array, channel]), sample_axis (0 or 1), range (samples of a partition),
    pushdown (true: bounds on seq select ranges; the session must set spark.sql.python.filterPushdown.enabled).

    Rows are file, seq (sample number, from 0) and a double for each axis. An array that is missing, scalar, not numeric or of
    another length than the file's other axes is an error when the query is planned. Writing: kind (npz or mat), node (the
    name of the matrix that holds the columns); save mode append.
    """

    @classmethod
    def name(cls):
        return "arrays"

    def axes(self) -> dict[str, tuple[str, int]]:
        return {k: (str(v[0]).strip("/"), int(v[1])) for k, v in json.loads(self.options.get("axes", "{}")).items()}

    def schema(self):
        return "file string, seq long" + "".join(f", `{a}` double" for a in self.axes())

    def reader(self, schema):
        kind = BoundedArrayReader if str(self.options.get("pushdown", "")).lower() == "true" else ArrayReader
        return kind(self.options["path"], self.axes(), int(self.options.get("sample_axis", 0)), int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("array files are added to a folder, not overwritten")
        return ArrayWriter(self.options["path"], self.options.get("kind", "npz"), self.options.get("node", "signal"))


def read_arrays(spark: SparkSession, path: str, axes: dict[str, tuple[str, int]], sample_axis: int = 0, most: int = RANGE) -> DataFrame:
    """file, seq and a column for each axis (name → array and channel) of the array files of a folder.

    Bounds on seq are pushed into the source where the session sets spark.sql.python.filterPushdown.enabled.
    """
    spark.dataSource.register(ArraySource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("arrays").option("pushdown", pushdown).option("axes", json.dumps(axes)).option("sample_axis", sample_axis).option("range", most).load(path)


def write_arrays(df: DataFrame, path: str, kind: str = "npz", node: str = "signal") -> None:
    """The columns of df as matrices of doubles, a file or more for each partition."""
    df.sparkSession.dataSource.register(ArraySource)
    df.write.format("arrays").mode("append").option("kind", kind).option("node", node).save(path)


def read_text_arrays(spark: SparkSession, path: str, axes: dict[str, str], separator: str | None = None) -> DataFrame:
    """A column for each axis (name → header) of text files; the separator is that which the first line holds most often.

    Where the comma doesn't separate, it may be the decimal sign. Blank rows are left out; anything else that is no number is an error.
    """
    if separator is None:
        line = spark.read.text(path).filter("trim(value) <> ''").first()
        separator = max(",;\t|", key=lambda c: line.value.count(c)) if line else ","
    raw = spark.read.option("header", True).option("sep", separator).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path).dropna("all")

    def number(name: str):
        text = F.trim(F.col(f"`{name}`"))
        if separator != ",":
            text = F.when(F.contains(text, F.lit(",")) & ~F.contains(text, F.lit(".")), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
        value = text.try_cast("double")
        return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"no number in column {name}: "), F.coalesce(text, F.lit("null"))))).otherwise(value)

    return raw.select(*(number(name).cast("double").alias(out) for out, name in axes.items()))
