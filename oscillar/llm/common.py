"""What the corpus operators share: the shared folder, word hashing in numpy, file access by URI."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: names of so many files (some 20 MB) are broadcast; more of them are joined.
MOST_FILES = 100_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session may lack the setting; it gets a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written() tables that nothing reads any more."""
    for t in tables:
        fs, path = filesystem(t.written_to)
        fs.delete_dir(path)


def join_counted(rows: DataFrame, live: DataFrame, on: list[str], share: int = 1000) -> DataFrame:
    """rows joined with live, which has a row for each key and the number n of rows that hold it.

    Keys of more than one in `share` rows (fewer than `share` keys, so they may be broadcast) leave their rows where they lie;
    all others meet by a shuffle. Neither side may be expensive to read twice.
    """
    from pyspark.sql import functions as F

    most = live.agg(F.sum("n")).first()[0] or 0
    hot = [live.filter(F.col("n") * share > most), live.filter(F.col("n") * share <= most)]
    if hot[0].isEmpty():
        return rows.join(live.drop("n"), on)
    few = F.broadcast(hot[0].drop("n"))
    return rows.join(few, on).unionByName(rows.join(F.broadcast(hot[0].select(*on)), on, "left_anti").join(hot[1].drop("n"), on))


#: so many row numbers (8 MB) are broadcast; more of them meet their rows by a shuffle.
MOST_NUMBERS = 1_000_000
#: bits of a filter of row numbers: eight for each number, and no more than these (16 MB).
MOST_BITS = 1 << 27


def joined_numbers(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """rows (with row) left_semi or left_anti joined with numbers (row): rows with texts stay where they lie if the numbers are few."""
    from pyspark.sql import functions as F

    numbers = written(numbers.select("row"), "numbers")
    return rows.join(F.broadcast(numbers) if numbers.count() <= MOST_NUMBERS else numbers, "row", how)


class RowFilter:
    """Which rows may be among some: a bit for each hash of a row number, so that others don't cross a shuffle. Bounded by MOST_BITS."""

    def __init__(self, numbers: DataFrame, most: int = MOST_BITS):
        from pyspark.sql import functions as F

        self.bits = min(most, 1 << max(6, (8 * numbers.count()).bit_length()))
        slot = F.xxhash64("row").bitwiseAND(F.lit(self.bits - 1))
        words = numbers.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, CAST(xxhash64(row) & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held"))
        found = words.toArrow()  # a row for 64 bits at most
        held = np.zeros(self.bits >> 6, np.int64)
        held[found.column("word").to_numpy()] = found.column("held").to_numpy()
        self.held = numbers.sparkSession.sparkContext.broadcast(held)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & (self.bits - 1)
        return (self.held.value[slot >> 6] >> (slot & 63)) & 1 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of the batches that cross to Python workers where small_batches() is asked for.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts cross to Python workers of this session in batches of BATCH_BYTES or less: both sides hold whole batches beside what they work on, the JVM outside of its heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).lower().rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row: a number of its own for each row, which grows in the order of the files.

    It is the place of the row in its file, so it stays the same however often the files are read. What is no plain reading
    of files is written first.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() not in ("LogicalRelation", "Relation") and not plan.nodeName().startswith("LogicalRelation"):
        docs = written(docs, "keyed")
    place = docs.metadataColumn("_metadata")  # a column of the table may have that name, too
    path, number, at = (n + "_" * (1 + max(map(len, docs.columns), default=0)) for n in ("path", "file", "at"))  # names that no column has
    files = written(docs.select(place.getField("file_path").alias(path)).distinct(), "files")
    files = files.select(path, (F.row_number().over(Window.orderBy(F.length(path), path)) - 1).cast("long").alias(number))
    rows = docs.select("*", place.getField("file_path").alias(path), place.getField("row_index").alias(at))
    few = files.count() <= MOST_FILES
    rows = rows.join(F.broadcast(files) if few else files, path)
    out = rows.select(*(f"`{c}`" for c in docs.columns), (F.shiftleft(number, 40) + F.col(at)).alias("row"))
    out.is_keyed = True  # operators that are given this very table use its numbers
    return out


def filesystem(uri: str):
    """(file system, path) of a URI, for tasks that write or read whole files."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64's constants)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of ordered pairs; a and b are hashes already."""
    return mix(a * U64(0x9E3779B97F4A7C15) + (b ^ U64(0xD6E8FEB86659FD93 + salt)))


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Each byte of every text mapped by a table of 256 bytes; the lengths stay."""
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return type(texts).from_buffers(len(texts), offsets, pa.py_buffer(data.to_pybytes().translate(table)), None, 0, texts.offset)


class WordHashes:
    """Words of a batch of texts as 64-bit hashes, with each text's first word.

    A word is a run of bytes that are no ASCII space, after the byte table if one is given.
    """

    def __init__(self, texts: pa.Array, table: bytes | None = None, keep_words: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks != 1 else texts.chunk(0)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if table is not None:
            texts = translated(texts, table)
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        flat = lists.flatten()
        starts = np.asarray(lists.offsets).astype(np.int64)
        starts = starts - starts[0]
        if len(flat):
            coded = flat.dictionary_encode()
            ids = np.asarray(coded.indices)
            words = coded.dictionary.to_pylist()
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U64, len(words))
            if "" in words:  # a text without words splits into one empty string
                real = ids != words.index("")
                starts = np.concatenate([[0], np.cumsum(real)])[starts]
                ids = ids[real]
                flat = flat.filter(pa.array(real)) if keep_words else flat
            self.hashes = hashes[ids]
        else:
            self.hashes = np.zeros(0, U64)
        self.starts = starts
        self.words = flat if keep_words else None


_memos: dict[str, dict] = {}


def worker_memo(name: str) -> dict:
    """What a Python worker remembers from task to task under a name; that of another name is dropped, as stages reuse workers."""
    if name not in _memos:
        _memos.clear()
        _memos[name] = {}
    return _memos[name]


def sliced(batches, column: str | int = "content", most_bytes: int = 2 << 20):
    """Record batches cut so that a slice holds a few MB, or one row; bounds what a task holds.

    column: the texts, or the bytes of each row as numbers. At the end memory that is free goes back to the system.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch.column(column)
        sizes = held if pa.types.is_integer(held.type) else pc.binary_length(held)
        ends = np.cumsum(np.asarray(pc.fill_null(sizes, 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release_memory()


def release_memory() -> None:
    """Give what a task has freed back to the system: workers stay alive between stages, beside those of the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def unpacked(frames: pa.Array) -> list[bytes]:
    import zstandard

    loose = zstandard.ZstdDecompressor()
    return [loose.decompress(f) for f in frames.to_pylist()]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, content (null: empty) and row, a number of its own for each row, whatever its id and text."""
    from pyspark.sql import functions as F

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [F.col(id_col).cast("long").alias("doc_id"), text.alias("content")]
    return docs.select(*columns, "row") if getattr(docs, "is_keyed", False) else keyed(docs.select(*columns))


def packed_texts(rows: DataFrame, among: RowFilter | None = None) -> DataFrame:
    """row, doc_id, frame, size: the texts of identified() rows as Zstandard frames, for a shuffle; size: bytes of the text.

    among: leaves out rows that it can't hold (some others may stay, too).
    """
    from pyspark.sql import functions as F

    def squeeze(batches):
        import zstandard

        squeezer = zstandard.ZstdCompressor(level=3)
        for b in sliced(batches):
            if among is not None:
                b = b.filter(pa.array(among.may_hold(b.column("hash").to_numpy())))
            texts = [t.encode() for t in b.column("content").to_pylist()]
            frames = pa.array([squeezer.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), frames, pa.array([len(t) for t in texts], pa.int64())], names=["row", "doc_id", "frame", "size"])

    columns = ["row", "doc_id", "content"] if among is None else ["row", "doc_id", "content", F.xxhash64("row").alias("hash")]
    return rows.select(*columns).mapInArrow(squeeze, "row long, doc_id long, frame binary, size long")
