"""Substring dedup by recompression.

Rounds name runs of a word and then pairs of neighbouring symbols (the left one of a class L, the right one of a class R).
Names are hashes of what they stand for, so all tasks give one name to one thing without a dictionary or a shuffle between
the rounds, and a symbol depends only on the words of a short range around it: equal substrings get equal symbols in their
interior. Every window of words takes as its anchor the symbol of lowest name among those whose range lies inside the window;
equal windows take the same anchor. Places are joined by their anchors' symbols (and the words next to them); those that
share one are verified, first by all the words that the windows of an anchor cover, and at the borders of repeats window by
window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import U64, WordHashes, discard, identified, join_counted, mix, packed_texts, pair_hash, sliced, table, unpacked, written

WIDTH = 35
#: words on both sides of a symbol's range that its windows contain too: makes anchors rarer than common phrases.
MARGIN = 4
ROUNDS = 3
BASE = U64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i in 0..n, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class Spans:
    """Hashes of any span of a sequence in constant time."""

    def __init__(self, h: np.ndarray):
        up, self.down = powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def recompress(h: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """name, left, right of the top symbols: a name depends on the words [left, right) and on nothing else.

    starts: the first word of each text, and the end. A range that leaves its text means a dependence on the text's border;
    it is cut to one word beyond.
    """
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    opens, closes = starts[:-1], starts[1:]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(h))
    length = ends - at
    name, doc = h[at], doc[at]
    name = np.where(length > 1, pair_hash(name, length.astype(U64), 7), name)
    left, right = at - 1, ends + 1
    for k in range(rounds):
        if not len(name):
            break
        is_left = (mix(name ^ U64(0xA24BAED4963EE407 * (k + 1) % (1 << 64))) >> U64(63)) == 1
        same = np.append(doc[1:] == doc[:-1], False)  # the next symbol is of the same text
        after = np.append(is_left[1:], True)
        starts_pair = is_left & ~after & same
        ends_pair = np.append(False, starts_pair[:-1])
        next_right = np.where(same, np.append(right[1:], 0), closes[doc] + 1)
        last_left = np.where(np.append(False, same[:-1]), np.append(0, left[:-1]), opens[doc] - 1)
        new_name = np.where(starts_pair, pair_hash(name, np.append(name[1:], U64(0)), 11 + k), name)
        new_right = np.where(is_left, next_right, right)  # a pair ends where its right part does; L alone has seen that no R follows
        new_left = np.where(is_left | ends_pair, left, last_left)
        keep = ~ends_pair
        name, left, right, doc = new_name[keep], new_left[keep], new_right[keep], doc[keep]
    return name, np.maximum(left, opens[doc] - 1) if len(doc) else left, np.minimum(right, closes[doc] + 1) if len(doc) else right


def anchors(h: np.ndarray, starts: np.ndarray, width: int = WIDTH, margin: int = MARGIN):
    """text, first window, last window, key, context of each anchor: all windows of the texts, each in one anchor's interval."""
    sizes = np.diff(starts)
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    w = np.flatnonzero(np.arange(len(h)) + width <= starts[1:][doc_of]) if len(h) else np.zeros(0, np.int64)
    if not len(w):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    name, left, right = recompress(h, starts)
    low, high = left - margin, right + margin
    # ranges cut to one word beyond their text keep both bounds in ascending order
    doc = np.searchsorted(starts, np.clip((left + right) // 2, 0, len(h) - 1), side="right") - 1
    low, high = np.maximum(low, starts[doc] - 1), np.minimum(high, starts[doc + 1] + 1)
    a = np.searchsorted(low, w, side="left")
    b = np.searchsorted(high, w + width, side="right")
    bits = max(1, int(len(name)).bit_length())
    place = U64((1 << bits) - 1)
    ranked = (mix(name) & ~place) | np.arange(len(name)).astype(U64)
    count = b - a
    best = np.zeros(len(w), np.int64)
    level, size = ranked, 1
    while True:  # the lowest of a range of symbols: two overlapping ranges of a power of two
        pick = np.flatnonzero((count >= size) & (count < 2 * size))
        if len(pick):
            best[pick] = (np.minimum(level[a[pick]], level[b[pick] - size]) & place).astype(np.int64)
        if not (count >= 2 * size).any():
            break
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    alone = count <= 0
    best[alone] = len(name) + w[alone]  # no symbol inside: the window is an anchor of its own
    first = np.ones(len(w), bool)
    first[1:] = best[1:] != best[:-1]
    at = np.flatnonzero(first)
    lo, hi = w[at], w[np.append(at[1:], len(w)) - 1]
    own = alone[at]
    i = np.where(own, 0, best[at])
    l, r = np.where(own, lo, low[i]), np.where(own, lo + width, high[i])
    spans = Spans(h)
    symbol = pair_hash(name[i], pair_hash(spans.of(l, np.where(own, l, left[i])), spans.of(np.where(own, r, right[i]), r)))
    key = np.where(own, spans.of(l, r), symbol)
    context = pair_hash(spans.of(lo, hi + width), mix((l - lo).astype(U64) * U64(1 << 20) + (r - l).astype(U64)))
    return doc_of[lo], lo, hi, key, context


def anchor_rows(rows: DataFrame) -> DataFrame:
    """key, ctx, row, pos of every anchor; pos packs the first window and the number of further windows (6 bits)."""

    def run(batches):
        for b in sliced(batches):
            words = WordHashes(b.column("content"))
            doc, lo, hi, key, ctx = anchors(words.hashes, words.starts)
            pos = ((lo - words.starts[doc]) << 6) | (hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), b.column("row").take(pa.array(doc)), pa.array(pos)], names=["key", "ctx", "row", "pos"])

    return rows.select("row", "content").mapInArrow(run, "key long, ctx long, row long, pos long")


def window_rows(texts: DataFrame) -> DataFrame:
    """From row, frame, size and needs (key, pos, settled): the hash of every window asked for, with its key and place."""

    def run(batches):
        for b in sliced(batches, "size"):
            words = WordHashes(pa.array([t.decode() for t in unpacked(b.column("frame"))], pa.large_string()))
            needs = b.column("needs")
            of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(needs.offsets)))
            flat = needs.flatten()
            key, pos, settled = (np.asarray(flat.field(i)) for i in range(3))
            n = (pos & 63) + 1
            each = np.repeat(np.arange(len(pos)), n)
            at = (pos >> 6)[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            start = words.starts[of[each]] + at
            wh = Spans(words.hashes).of(start, start + WIDTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wh.view(np.int64)), pa.array(key[each]), b.column("row").take(pa.array(of[each])), pa.array(at << 6), pa.array(settled[each])], names=["wh", "key", "row", "pos", "settled"]
            )

    return texts.select("row", "frame", "size", "needs").mapInArrow(run, "wh long, key long, row long, pos long, settled boolean")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """row, pos: intervals of windows that start elsewhere too. Keys of very many places are counted before they are joined."""
    found = written(anchor_rows(rows), "substring-anchors")
    shared = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "substring-shared")
    hits = written(join_counted(found, shared, ["key"]), "substring-hits")
    contexts = hits.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "pos")).alias("one"))
    contexts = written(contexts, "substring-contexts")
    settled = join_counted(hits, contexts.filter("n > 1").select("key", "ctx", "n"), ["key", "ctx"]).select("row", "pos")
    # one place of each context stands for it where a key has several: at the borders of repeats
    mixed = written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "substring-mixed")
    needs = join_counted(contexts.withColumn("settled", F.col("n") > 1).drop("n"), mixed, ["key"]).select("one.row", F.struct("key", "one.pos", "settled").alias("need"))
    needs = needs.groupBy("row").agg(F.collect_set("need").alias("needs"))
    windows = written(window_rows(packed_texts(rows).join(needs, "row")), "substring-windows")
    places = F.max(F.when(F.col("settled"), 2).otherwise(1))
    again = windows.groupBy("wh", "key").agg(F.count(F.lit(1)).alias("n"), places.alias("places")).filter("n + places > 2").select("wh", "key", "n")
    single = join_counted(windows.filter("NOT settled"), written(again, "substring-again"), ["wh", "key"]).select("row", "pos")
    spans = written(settled.unionByName(single).groupBy("row").agg(F.collect_set("pos").alias("spans")), "substring-spans")
    discard(found, shared, hits, contexts, mixed, windows)
    return spans


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row.

    Words are runs of bytes other than ASCII white space. A word goes if a window of 35 words over it also starts anywhere
    else. A null text counts as empty; texts of fewer than 35 words lose nothing. Rows that repeat another row are places of
    their own, so all of their windows go. Null ids are kept. An empty table gives an empty result. Other columns of the
    input are ignored, whatever their names.
    """
    rows = identified(docs, id_col, text_col)
    joined = packed_texts(rows).join(repeated_windows(rows), "row", "left")

    def run(batches):
        for b in sliced(batches, "size"):
            out = []
            for text, marks in zip(unpacked(b.column("frame")), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                gone = 0
                if marks:
                    delta = np.zeros(len(words) + 1, np.int32)
                    pos = np.array(marks, np.int64)
                    np.add.at(delta, pos >> 6, 1)
                    np.add.at(delta, (pos >> 6) + (pos & 63) + WIDTH, -1)
                    keep = np.cumsum(delta[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                else:
                    kept = b" ".join(words)
                out.append((len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode()))
            n, gone, sha, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return joined.select("doc_id", "frame", "size", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS k FROM texts, unnest(range(1, len(ws) - 33)) AS r(s)),
dup AS (SELECT k FROM wins GROUP BY k HAVING count(*) > 1),
marks AS (SELECT doc_id, s FROM wins SEMI JOIN dup USING (k)),
words AS (SELECT doc_id, i, ws[i] AS word FROM texts, unnest(range(1, len(ws) + 1)) AS r(i)),
flags AS (SELECT w.doc_id, i, word, max(s) OVER (PARTITION BY w.doc_id ORDER BY i ROWS 34 PRECEDING) IS NOT NULL AS gone
          FROM words w LEFT JOIN marks m ON w.doc_id = m.doc_id AND w.i = m.s),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM flags GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
