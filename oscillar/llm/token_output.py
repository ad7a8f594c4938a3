"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned by id; each task encodes its documents, in ascending order, into one stream of ids and writes
it as an Arrow IPC file whose batches hold fixed-size lists: the ids and a mask that is false where the last sequence of a
file is padded. As sequences are equal in length, the place of any id follows from arithmetic, and a reader that maps the
file touches only the pages it needs. Files are named anew by every attempt; the index names those that counted.
"""

from __future__ import annotations

import codecs
import json
import re
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oscillar.llm.common import filesystem, identified, shared_dir, sliced, table, worker_memo, written

#: fixed values of the tokenizer file whose steps WordEncoder takes itself.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
SEQUENCE = 1024
#: text bytes for each file, from which their number follows (the session's shuffle partitions at least).
FILE_BYTES = 1 << 28
SEQUENCES_PER_BATCH = 256
END_ID = 2
#: parts of words, and whole words, that a Python worker remembers from batch to batch, and the most characters of one.
CACHE, LONGEST = 300_000, 64


def byte_alphabet() -> str:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else free))
        free += b not in shown
    return "".join(out)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)


def byte_kinds() -> np.ndarray:
    """The kind of each byte of UTF-8. The apostrophe is OTHER, as it may begin a contraction; lead and following bytes of two-byte letters are LETTER."""
    kinds = np.full(256, OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        kinds[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN
    kinds[ord("'")] = OTHER
    kinds[[*range(9, 14), 32]] = SPACE
    kinds[0x80:0xC0] = kinds[0xC3:0xCA] = LETTER
    return kinds


def lower_letters() -> np.ndarray:
    """The lower case of each code point below U+0280 that is a letter from U+00C0 to U+024F, if both take two bytes; else 0."""
    out = np.zeros(0x280, np.uint16)
    for c in range(0xC0, 0x250):
        low = chr(c).lower()
        if chr(c).isalpha() and len(low) == 1 and ord(low) < 0x800:
            out[c] = ord(low)
    return out


KINDS, LOWER_LETTERS = byte_kinds(), lower_letters()
LOWER_BYTES = np.array([b + 32 * (0x41 <= b <= 0x5A) for b in range(256)], np.uint8)


def word_parts(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """Parts of all words of the texts, by STEPS, which of them are whole words, and the place of each text's first.

    Words of other characters than basic Latin letters, digits and signs, or with an apostrophe or "<|", stay whole and as they
    are; no part equals one of them.
    """
    if not texts.buffers()[2]:
        return pa.array([], pa.large_string()), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    kinds = KINDS[data]
    full = kinds != SPACE
    begins = bounds[:-1][bounds[:-1] < len(data)]
    word, part = full.copy(), kinds == DIGIT  # where one begins
    word[1:] &= ~full[:-1]
    word[begins] = full[begins]
    part[1:] |= kinds[1:] != kinds[:-1]
    at = np.flatnonzero(part & full | word)
    first = word[at]
    words = at[first]

    lead = np.flatnonzero((data >= 0xC3) & (data < 0xCA))
    low = LOWER_LETTERS[(data[lead].astype(np.uint16) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    less = np.flatnonzero(data[:-1] == ord("<"))
    others = np.concatenate([np.flatnonzero(kinds == OTHER), lead[low == 0], less[data[less + 1] == ord("|")]])
    whole = np.zeros(len(words), bool)
    whole[np.searchsorted(words, others, side="right") - 1] = True
    lowered = LOWER_BYTES[data]
    lowered[lead] = 0xC0 | low >> 6
    lowered[lead + 1] = 0x80 | low & 0x3F
    of_whole = np.zeros(len(at), bool)
    if len(others):
        of_whole = whole[np.cumsum(first) - 1]
        at, of_whole = at[first | ~of_whole], of_whole[first | ~of_whole]
        turns = np.zeros(len(data) + 1, np.int8)
        turns[words[whole]] += 1
        turns[np.append(words[1:], len(data))[whole]] -= 1
        kept = np.cumsum(turns[:-1], dtype=np.int8) > 0
        lowered[kept] = data[kept]

    sizes = np.add.reduceat(full, at, dtype=np.int64) if len(at) else []
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    parts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(lowered[full]))
    return parts, of_whole, np.searchsorted(at, bounds)


class WordEncoder:
    """Ids of texts by a tokenizer.

    If its steps are STEPS, it drops white space and works word by word: what a word becomes depends on the word alone. Words
    of basic Latin letters then go to the vocabulary's model by the tokenizer's own steps (lower case, split, bytes), part by
    part and remembered; any other word goes through the whole tokenizer. With other steps the whole text goes through it.
    A batch is lower-cased and split at once (word_parts), so that only distinct parts are looked up, not words in every case
    and with every sign beside them.
    Ids are remembered as bytes (of unsigned 32-bit integers): a fifth of what lists of them hold, and joined at once.
    """

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        steps = json.loads(tokenizer_json)
        plain_model = steps["model"].get("type", "BPE") == "BPE" and not any(steps["model"].get(k) for k in ("dropout", "ignore_merges", "byte_fallback"))
        added = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in steps.get("added_tokens", []))
        self.by_word = plain_model and added and all(steps.get(k) == v for k, v in STEPS.items()) and not steps.get("truncation")
        self.alphabet = byte_alphabet()
        self.plain = regex.compile("[\x21-\x7eÀ-įı-ɏ]+")
        self.split = regex.compile(SPLIT)
        self.split_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        self.known: dict[str, bytes] = {"": b""}  # of words and of their parts: a part that stands alone is a word of the same ids

    def word(self, word: str) -> bytes:
        if "<|" in word:
            return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if word.isascii() and word.isprintable():
            parts = self.split_ascii(word.lower())
        elif self.plain.fullmatch(word):
            parts = self.split.findall(word.lower())
        else:
            return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return b"".join([self.part(p) for p in parts])

    def part(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            mapped = part if part.isascii() else codecs.charmap_decode(part.encode(), "strict", self.alphabet)[0]
            ids = self.remember(part, packed([t.id for t in self.model.tokenize(mapped)]))
        return ids

    def remember(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST:
            self.known[word] = ids
        return ids

    def forget(self, words: list[str], counts: np.ndarray) -> None:
        """Keeps the commonest words of the last batch, half of CACHE at most, if more than CACHE are remembered."""
        if len(self.known) > CACHE:
            often = np.argsort(-counts, kind="stable")[: CACHE // 2].tolist()
            self.known = {words[k]: self.known[words[k]] for k in often if words[k] in self.known} | {"": b""}

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and each text's first."""
        if not self.by_word:
            own = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            return np.fromiter(chain.from_iterable(own), np.uint32, int(ends[-1]) if len(own) else 0), np.append(0, ends)
        parts, of_whole, starts = word_parts(texts)
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = np.zeros(len(words), bool)
        whole[np.asarray(coded.indices)[of_whole]] = True
        own = list(map(self.known.get, words))
        for k, (w, found) in enumerate(zip(words, own)):
            if found is None:
                own[k] = self.remember(w, self.word(w)) if whole[k] else self.part(w)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) // 4)
        ids = np.frombuffer(b"".join(own), "<u4")
        self.forget(words, np.bincount(np.asarray(coded.indices), minlength=len(words)))
        each = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), pa.array(ids)).take(coded.indices)
        at = np.asarray(each.offsets)
        return each.flatten().to_numpy(), (at - at[0])[starts]


def encoder(tokenizer_json: str) -> WordEncoder:
    """One for each Python worker, so that tasks share what it remembers."""
    memo = worker_memo(f"tokens {hash(tokenizer_json)}")
    if not memo:
        memo["own"] = WordEncoder(tokenizer_json)
    return memo["own"]


class SequenceWriter:
    """Cuts a stream of ids into batches of fixed-size lists; close() pads and masks the last sequence."""

    def __init__(self, sink, kind: pa.DataType, length: int = SEQUENCE, per_batch: int = SEQUENCES_PER_BATCH):
        self.kind, self.length, self.size = kind, length, length * per_batch
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.size:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.size * self.size
            for at in range(0, whole, self.size):
                self._write(flat[at : at + self.size], self.size)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = pa.FixedSizeListArray.from_arrays
        self.out.write_batch(pa.record_batch([lists(pa.array(ids, self.kind), self.length), lists(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(np.append(flat, np.zeros(-len(flat) % self.length, flat.dtype)), len(flat))
        self.out.close()


class SequenceReader:
    """Random access to spans of ids of a file."""

    def __init__(self, source, length: int = SEQUENCE, per_batch: int = SEQUENCES_PER_BATCH):
        self.file, self.size = pa.ipc.open_file(source), length * per_batch
        self.held: tuple[int, np.ndarray, np.ndarray] = (-1, None, None)

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.held[0] != k:
            b = self.file.get_batch(k)
            self.held = k, b.column(0).flatten().to_numpy(), np.asarray(b.column(1).flatten())
        return self.held[1:]

    def span(self, first: int, n: int) -> np.ndarray:
        out = []
        for k in range(first // self.size, (first + max(n, 1) - 1) // self.size + 1):
            ids, mask = self.batch(k)
            lo, hi = max(first - k * self.size, 0), min(first + n - k * self.size, len(ids))
            if not mask[lo:hi].all():
                raise ValueError("the span reaches into the padding")
            out.append(ids[lo:hi])
        return np.concatenate(out) if len(out) > 1 else out[0]


def write_sequences(rows: DataFrame, folder: str, tokenizer_json: str, end_id: int = END_ID, length: int = SEQUENCE, partitions: int | None = None) -> DataFrame:
    """Writes the ids of identified() rows in ascending (doc_id, row) order and returns the written index: doc_id, file, part, first, n_tokens."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: its size doesn't depend on the data
    if not partitions:
        held = rows.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_BYTES))

    def run(batches):
        fs = sink = out = name = None
        part, at = TaskContext.get().partitionId(), 0
        own = encoder(shared.value)
        kind = np.uint16 if own.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        for b in sliced(batches):
            if out is None:
                fs, root = filesystem(folder)
                fs.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.arrow"
                sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                out = SequenceWriter(sink, pa.from_numpy_dtype(kind), length)
            ids, starts = own.texts(b.column("content").cast(pa.large_string()))
            ids = np.insert(ids, starts[1:], end_id).astype(kind)
            n = np.diff(starts) + 1
            out.add(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([name] * len(n)), pa.array([part] * len(n), pa.int32()), pa.array(at + np.cumsum(n) - n), pa.array(n)], names=["doc_id", "file", "part", "first", "n_tokens"])
            at += int(n.sum())
        if out is not None:
            out.close()
            sink.close()

    dealt = rows.repartitionByRange(partitions, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "content")
    return written(dealt.mapInArrow(run, "doc_id long, file string, part int, first long, n_tokens long"), "token-index")


def read_sequences(index: DataFrame, folder: str, length: int = SEQUENCE) -> DataFrame:
    """doc_id, part, first, n_tokens, ids_crc32 of every document, its ids read from the files."""

    def run(batches):
        fs, root = filesystem(folder)
        held = name = None
        for b in batches:
            names, first, n = b.column("file").to_pylist(), b.column("first").to_pylist(), b.column("n_tokens").to_pylist()
            crc = [0] * len(n)
            for k in sorted(range(len(n)), key=lambda k: (names[k], first[k])):
                if names[k] != name:
                    path = f"{root}/{names[k]}"
                    source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
                    held, name = SequenceReader(source, length), names[k]
                crc[k] = zlib.crc32(held.span(first[k], n[k]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("first"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    return index.select("doc_id", "part", "first", "n_tokens", "file").mapInArrow(run, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every row, from the files.

    A null or empty text is its end id alone. Null ids come first; rows that repeat an id follow each other as they lie in
    their files. An empty table writes no file and gives an empty result. Other columns are ignored, whatever their names.
    """
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    index = write_sequences(identified(docs, id_col, text_col), folder, tokenizer_json, end_id, length)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("held"))  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    rows = read_sequences(index, folder, length).join(parts, "part")
    return rows.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
