"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint has a vector phi(i) of r + 1 bits; the mask of a vector v (not zero) holds the bits whose phi has an odd
product with v. Any r bits leave some v orthogonal to all their vectors, so two fingerprints that differ in r bits at most
agree on some mask: of 2^(r + 1) - 1 tables one at least brings them together, whatever the bits. No pair within r is missed.

Fingerprints are compared once each, however many rows share them. A bucket of few is compared within itself. In a large one
each fingerprint visits the values that one flip outside of the mask leads to (r = 2: fingerprints that link are two flips
apart at most and meet half way), and joins the smallest visitor of a value; so rows grow with its size and not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import identified, join_counted, sliced, table, written
from oscillar.llm.components import components

BITS, RADIUS, WORDS, SEED = 64, 2, 3, 42
#: fingerprints of a bucket that are compared with each other; larger buckets go the other way.
BUCKET = 32
#: shingles that are counted at a time.
STEP = 1 << 15
#: A-Z in lower case, all other bytes unchanged.
LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius + 1) - 1 masks (as unsigned numbers): any `radius` bits lie outside of one of them."""
    vectors = (1 << (radius + 1)) - 1
    phi = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i, p in enumerate(phi) if (p & v).bit_count() & 1) for v in range(1, vectors + 1)]


def as_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a text: a bit is 1 if more than half of the hashes of its shingles, repeats included, have it."""
    found = text.translate(LOWERED).split()
    if not found:
        return 0
    width = min(words, len(found))
    n = len(found) - width + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, STEP):
        part = found[lo : min(lo + STEP, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(part) - width + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """row, doc_id, fp (64 bits as a signed number) of identified() rows."""

    def run(batches):
        for b in sliced(batches):
            fps = np.array([fingerprint(t, words) for t in b.column("content").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fps)], names=["row", "doc_id", "fp"])

    return rows.select("row", "doc_id", "content").mapInArrow(run, "row long, doc_id long, fp long")


def near_pairs(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links (a < b) of distinct fingerprints fp that connect just what links within the radius (1 or 2) connect."""
    if radius not in (1, 2):
        raise ValueError("large buckets are resolved for a radius of 1 or 2")
    masks = [as_signed(m) for m in covering_masks(radius)]
    places = F.array(*(F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks))
    probes = fps.select("fp", F.inline(places))
    sizes = written(probes.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-buckets")
    small = probes.join(sizes.filter(F.col("n") <= bucket).drop("n"), ["mask", "key"]).groupBy("mask", "key").agg(F.array_sort(F.collect_list("fp")).alias("held"))
    inside = f"transform(filter(held, y -> y > x AND bit_count(x ^ y) <= {radius}), y -> struct(x AS a, y AS b))"
    pairs = small.select(F.inline(F.expr(f"flatten(transform(held, x -> {inside}))")))
    large = join_counted(probes, sizes.filter(F.col("n") > bucket), ["mask", "key"])
    free = F.filter(F.array(*(F.lit(as_signed(1 << k)) for k in range(BITS))), lambda bit: bit.bitwiseAND(F.col("mask")) == 0)
    if radius == 2:
        same = F.struct(F.col("fp").alias("value"), F.lit(0).cast("long").alias("bit"))
        visits = F.concat(F.array(same), F.transform(free, lambda bit: F.struct(F.col("fp").bitwiseXOR(bit).alias("value"), F.lit(0).cast("long").alias("bit"))))
    else:  # what links differs in one bit, and is equal without it
        visits = F.transform(free, lambda bit: F.struct(F.col("fp").bitwiseAND(F.bitwise_not(bit)).alias("value"), bit.alias("bit")))
    met = large.select("fp", F.inline(visits))
    hubs = met.groupBy("value", "bit").agg(F.collect_set("fp").alias("held")).filter(F.size("held") > 1)  # a value has no more visitors than flips
    stars = hubs.select(F.array_min("held").alias("a"), F.explode("held").alias("b")).filter("a <> b")
    return pairs.unionAll(stars).distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row.

    A null text counts as empty; texts without words have the fingerprint zero and are linked like any other. component_id is
    the smallest id of the component (null ids are passed over unless there is no other). Repeated rows have one fingerprint
    and are linked. A text is hashed a few thousand words at a time. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    marks = written(fingerprints(identified(docs, id_col, text_col), words).select("doc_id", "fp"), "simhash-marks")
    fps = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = components(near_pairs(fps.select("fp"), radius, bucket), "bigint").withColumnRenamed("node", "fp")
    known = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = written(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-least")
    classes = written(join_counted(known.select("fp", "root", F.col("n").alias("rows")), least, ["root"]).select("fp", "component_id", F.col("rows").alias("n")), "simhash-classes")
    return join_counted(marks, classes, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
