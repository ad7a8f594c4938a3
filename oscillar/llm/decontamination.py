"""Benchmark decontamination as a prefix-filtered set join.

Benchmark windows are sets of word shingles. Shingles are ordered by their rarity in the documents; as a window must be
contained whole, its necessary prefix is its one rarest shingle, and documents join on it. A candidate has to lie inside a
region of benchmark shingles at the place that the prefix shingle's position gives (length and positional bounds) and is then
verified word by word over the window. Documents are read once, through a bitmap of the benchmark's shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import WordHashes, identified, join_counted, pair_hash, sliced, table, written

WIDTH = 10
SHINGLE = 3
#: least and most bits of the broadcast bitmap, a power of two from 16 bits a shingle; a fuller bitmap passes more regions
#: on, and the join decides.
BITMAP_BITS = 1 << 23, 1 << 27
#: bytes: A-Z in lower case; digits, a-z and all bytes beyond ASCII are word bytes, the rest is space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: Column) -> Column:
    """The same words by built-in functions, for the benchmark."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of so many words, by width 1 to SHINGLE."""
    out = h
    for k in range(1, width):
        out = pair_hash(out[:-1], h[k:], width)
    return out


def shingled(words: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the array of 64-bit shingle hashes of an array of words (fewer words than a shingle: one shingle of all)."""
    import xxhash

    def run(batches):
        for b in batches:
            out = []
            for ws in b.column(column).to_pylist():
                h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), np.uint64, len(ws))
                out.append(shingles(h, min(SHINGLE, len(ws))).view(np.int64) if len(ws) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], schema=pa.schema([*b.schema, pa.field(name, pa.list_(pa.int64()))]))

    fields = ", ".join(f"`{c}` {t}" for c, t in words.dtypes)
    return words.mapInArrow(run, f"{fields}, {name} array<bigint>")


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """item (string), words: every window of every item; an item of fewer words, but not none, is one window."""
    ws = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (width - 1), F.lit(1)))
    return ws.withColumn("s", F.explode(starts)).select("item", F.slice("ws", F.col("s"), F.lit(width)).alias("words"))


def regions(rows: DataFrame, bitmap: bytes, widths: list[int], least: int) -> DataFrame:
    """row, doc_id, n_words, start, words, grams, gram_width: the stretches of a text whose shingles may all be benchmark shingles.

    Every row gives one output row of its own with its number of words and no start, too. Widths: the shingle widths that
    occur; least: the words of the shortest window. Stretches of different widths are rows of their own.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP_BITS / 8 bytes at most

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in sliced(batches):
            w = WordHashes(b.column("content"), WORD_BYTES, keep_words=True)
            n = np.diff(w.starts)
            doc = np.repeat(np.arange(b.num_rows), n)
            found = []
            for width in widths:
                grams = shingles(w.hashes, width)
                if not len(grams):
                    continue
                slot = grams & np.uint64(8 * len(bits) - 1)
                hit = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                hit &= doc[: len(grams)] == doc[width - 1 :]
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc[at]) != 0)) + 1
                first, last = at[np.append(0, breaks)], at[np.append(breaks, len(at)) - 1]
                long_enough = (last - first + width >= least) if width == SHINGLE else (n[doc[first]] > 0)
                found += [(doc[f], f - w.starts[doc[f]], w.words[int(f) : int(l) + width], grams[f : l + 1].view(np.int64), width) for f, l in zip(first[long_enough], last[long_enough], strict=True)]
            take = pa.array([*range(b.num_rows), *(int(x[0]) for x in found)], pa.int64())
            none = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row").take(take),
                    b.column("doc_id").take(take),
                    pa.array(n, pa.int64()).take(take),
                    pa.array(none + [int(x[1]) for x in found], pa.int32()),
                    pa.array(none + [x[2].to_pylist() for x in found], pa.list_(pa.string())),
                    pa.array(none + [x[3] for x in found], pa.list_(pa.int64())),
                    pa.array(none + [x[4] for x in found], pa.int32()),
                ],
                names=["row", "doc_id", "n_words", "start", "words", "grams", "gram_width"],
            )

    return rows.select("row", "doc_id", "content").mapInArrow(run, "row long, doc_id long, n_words long, start int, words array<string>, grams array<bigint>, gram_width int")


def bitmap_of(grams: DataFrame) -> bytes:
    """One bit for each hash of the column gram, by its lowest bits."""
    least, most = BITMAP_BITS
    bits = min(max(least, 1 << (16 * grams.count()).bit_length()), most)
    bitmap = np.zeros(bits // 8, np.uint8)
    slots = grams.select(F.col("gram").bitwiseAND(F.lit(bits - 1)).alias("slot")).distinct()
    for b in slots.toArrow().to_batches():  # a row for each bit at most
        at = np.asarray(b.column(0))
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bitmap.tobytes()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document row.

    Null and empty texts have no words; a null item id is left out of the list of items, but its windows are hit. Items of
    the same text count each. Rows that repeat a document are judged each by itself and come out alike. Documents or a
    benchmark without rows give no hits. Other columns are ignored, whatever their names.
    """
    rows = identified(docs, id_col, text_col)
    windows = written(benchmark_windows(items, item_col, "text", width).withColumn("wid", F.md5(F.array_join("words", " "))), "bench-owners")
    kinds = written(shingled(windows.select("wid", "words").distinct(), "words", "grams"), "bench-windows")
    span = kinds.agg(F.min(F.size("words")).alias("least"), F.collect_set(F.least(F.size("words"), F.lit(SHINGLE))).alias("widths")).first()
    bitmap = bitmap_of(kinds.select(F.explode("grams").alias("gram")).distinct())
    found = written(regions(rows, bitmap, sorted(span["widths"] or []), span["least"] or 1), "bench-regions")
    # every place of a region with the words that a window over it may hold
    places = found.filter("start IS NOT NULL").select("row", "start", "words", F.posexplode("grams").alias("at", "gram"))
    low = F.greatest(F.col("at") - (width - 1), F.lit(0))
    places = places.select("row", "gram", "at", low.alias("low"), (F.col("start") + low).alias("from_low"), F.slice("words", low + 1, 2 * width).alias("words"))
    # rarity of the benchmark's shingles in the documents
    rarity = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts = kinds.select("wid", "words", F.posexplode("grams").alias("offset", "gram"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram"))
    prefix = parts.join(rarity, "gram", "left").groupBy("wid", "words").agg(rarest.alias("rarest")).filter("rarest.n > 0")
    prefix = written(prefix.select("wid", F.col("words").alias("w_words"), "rarest.offset", "rarest.gram", "rarest.n"), "bench-prefixes")
    met = join_counted(places, prefix, ["gram"])
    first, size = F.col("at") - F.col("offset") - F.col("low"), F.size("w_words")
    met = met.filter((first >= 0) & (first + size <= F.size("words"))).filter(F.slice("words", first + 1, size) == F.col("w_words"))
    hits = written(met.select("row", "wid", (F.col("from_low") + first).alias("from"), (F.col("from_low") + first + size).alias("to")), "bench-hits")
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["to"]).alias("upto"), (a["n"] + F.greatest(s["to"] - F.greatest(a["upto"], s["from"]), F.lit(0))).cast("long").alias("n")),
        lambda a: a["n"],
    )
    spans = spans.select("row", covered.alias("n_hit"))
    met_kinds = written(hits.select("row", "wid").distinct(), "bench-met")
    owners = windows.filter("item IS NOT NULL").select("item", "wid").distinct().join(met_kinds.groupBy("wid").agg(F.count(F.lit(1)).alias("n")), "wid")
    named = join_counted(met_kinds, written(owners, "bench-named"), ["wid"]).select("row", "item").distinct()
    named = named.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    sizes = found.filter("start IS NULL").select("row", "doc_id", "n_words")
    out = sizes.join(spans, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 10) AS w, array_to_string(ws[s:s + 9], ' ') AS k
         FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(s) WHERE len(ws) > 0),
widths AS (SELECT DISTINCT w FROM wins),
places AS (SELECT doc_id, s, w, array_to_string(ws[s:s + w - 1], ' ') AS k FROM texts, widths, unnest(range(1, len(ws) - w + 2)) AS r(s)),
hits AS (SELECT doc_id, s, w, item_id FROM places JOIN wins USING (w, k)),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT DISTINCT doc_id, s, w FROM hits), unnest(range(s, s + w)) AS r(i) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id LEFT JOIN named n ON t.doc_id = n.doc_id
"""
