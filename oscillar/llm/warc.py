"""WARC archives as seekable Zstandard bundles.

Each task writes one archive: groups of records are independent frames, and a footer in a skippable frame holds the seek
table (compressed and decompressed size of every frame). An index row maps a record's identifier to its archive, its frame
and its offset within the frame, so a record is read by one seek and the decompression of one frame. Archives are named
anew by every attempt of a task; the index names those of the attempts that counted, so a lost executor leaves nothing
behind but unreferenced files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import filesystem, join_counted, keyed, shared_dir, table, written

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 1 << 20
#: payloads below this size are always stored.
LEAST_REVISIT = 1000


class BundleWriter:
    """Appends records to frames; finish() adds the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.squeeze = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int]] = []
        self.open = bytearray()

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within it) of the record."""
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.table), len(self.open)
        self.open += record
        return place

    def flush(self) -> None:
        if self.open:
            frame = self.squeeze.compress(bytes(self.open))
            self.sink.write(frame)
            self.table.append((len(frame), len(self.open)))
            self.open.clear()

    def finish(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class BundleReader:
    """Reads frames by number through the seek table."""

    def __init__(self, source):
        self.source, self.loose = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the archive")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - 9 - entry * frames)
        raw = source.read(entry * frames)
        self.at, self.sizes = [0], []
        for i in range(frames):
            packed, full = struct.unpack_from("<II", raw, entry * i)
            self.at.append(self.at[-1] + packed)
            self.sizes.append(full)
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            self.source.seek(self.at[k])
            self.held = k, self.loose.decompress(self.source.read(self.at[k + 1] - self.at[k]), max_output_size=self.sizes[k])
        return self.held[1]

    def record(self, k: int, offset: int) -> tuple[dict[str, str], bytes]:
        """Headers and block of a record."""
        data = self.frame(k)
        end = data.index(b"\r\n\r\n", offset)
        lines = data[offset:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at offset {offset}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        return head, data[end + 4 : end + 4 + int(head["Content-Length"])]


def record_id(page_id: int | None, row: int) -> str:
    """Rows may repeat a page_id or have none; their row tells the records apart."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def make_record(page_id, row: int, url, html: bytes, digest: str, n_bytes: int, kind: str, refers_to) -> bytes:
    """A response holds an HTTP head and the payload; a revisit only the head, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + html if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, row)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to['page_id'], refers_to['row'])}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(head: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload bytes, digest, type, refers_to, payload (None for revisits); a payload that fails its digest raises."""
    number = lambda x: None if x is None or x.startswith("<urn:page:none:") else int(x[len("<urn:page:") : -1].split(":")[0])
    end = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:end].decode().split("\r\n")[1:])
    digest = base64.b32decode(head["WARC-Payload-Digest"][len("sha1:") :]).hex()
    payload = None
    if head["WARC-Type"] == "response":
        payload = block[end + 4 :]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
    return number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(http["Content-Length"]), digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), payload


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, digest=F.sha1) -> DataFrame:
    """page_id, row, url, digest, n_bytes, kind, refers_to (page_id and row), html (null for revisits).

    Payloads are equal when their length, their SHA-1 and their SHA-256 are: pages made to share a SHA-1 keep both payloads.

    Copies are counted on narrow rows; then the payloads of least bytes and more cross a shuffle, except for those of large
    groups and of small pages, which stay where they lie.
    """
    rows = keyed(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")))
    rows = rows.withColumns({"digest": digest("html"), "n_bytes": F.octet_length("html").cast("long")})
    rows = rows.withColumn("sha", F.when(F.col("n_bytes") >= least, F.unhex(F.sha2("html", 256))))
    large = rows.filter(F.col("n_bytes") >= least)
    same = ["digest", "n_bytes", "sha"]
    groups = large.groupBy(*same).agg(F.max(F.struct("page_id", "row")).alias("kept"), F.count(F.lit(1)).alias("n"))
    met = join_counted(large, written(groups, "warc-groups"), same)
    met = met.unionByName(rows.filter(F.col("n_bytes") < least).withColumn("kept", F.struct("page_id", "row")))
    own = F.col("row") == F.col("kept.row")
    return met.select("page_id", "row", "url", "digest", "n_bytes", F.when(own, "response").otherwise("revisit").alias("kind"), F.when(~own, F.col("kept")).alias("refers_to"), F.when(own, F.col("html")).alias("html"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records of plan_records(), an archive for each partition that has any, and returns the written index: page_id, archive, frame, offset."""

    def run(batches):
        fs = root = out = sink = path = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, root = filesystem(folder)
                fs.create_dir(root, recursive=True)
                path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                sink = fs.open_output_stream(path, compression=None)
                out = BundleWriter(sink)
            ids, places = [], []
            columns = ("page_id", "row", "url", "html", "digest", "n_bytes", "kind", "refers_to")
            for page_id, row, url, html, *rest in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                ids.append(page_id)
                places.append(out.add(make_record(page_id, row, url, (html or "").encode(), *rest)))
            name = path.rpartition("/")[2]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array([f for f, _ in places], pa.int32()), pa.array([o for _, o in places], pa.int64())], names=["page_id", "archive", "frame", "offset"])
        if out is not None:
            out.finish()
            sink.close()

    index = records.select("page_id", "row", "url", "digest", "n_bytes", "kind", "refers_to", "html").mapInArrow(run, "page_id long, archive string, frame int, offset long")
    return written(index, "warc-index")


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload), read from the archives by the index."""

    def run(batches):
        fs, root = filesystem(folder)
        held = name = None
        for b in batches:
            out = []
            for archive, frame, offset, page_id in sorted(zip(b.column("archive").to_pylist(), b.column("frame").to_pylist(), b.column("offset").to_pylist(), b.column("page_id").to_pylist(), strict=True), key=lambda x: x[:3]):
                if archive != name:
                    held, name = BundleReader(fs.open_input_file(f"{root}/{archive}")), archive
                got = parse_record(*held.record(frame, offset))
                if got[0] != page_id:
                    raise ValueError(f"the index names page {page_id}, the record {got[0]}")
                out.append(got if payloads else got[:-1])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds)], names=names[: len(out[0])])

    extra = ", payload binary" if payloads else ""
    return index.mapInArrow(run, f"page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long{extra}")


def warc_round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False, **columns) -> DataFrame:
    """Writes a record per row and reads all of them back.

    A null html is an empty payload, a null url has no target header, and a null page_id gets the identifier none and loses to
    any other as the one to keep. Of rows that repeat page_id and payload one is the response and the others revisit it.
    An empty table writes no archive and gives an empty result. Other columns are ignored, whatever their names.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, **columns), folder), folder, payloads)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS kept FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM q
"""
