"""Toxicity by a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

Sentences are read as segments: words reduced to their letters, and runs of very short words joined, so that spelled-out
insults become whole again. The kernel counts common subsequences of three letters, weighted down by the gaps they span, so
inserted, doubled or dropped letters cost little. Landmarks give the Nyström features on which a linear machine is trained.
As the machine is linear in the kernel's own feature space, its weights are carried over to that space (one for each
triple of letters), and a segment is scored exactly by its subsequences, without touching the landmarks again.

Training examples are labelled sentences: each has its text's label and hands it to its segments, and every text weighs the
same. After a first machine, sentences of toxic texts without a segment on the toxic side are left out (but for the text's
highest one), landmarks are set at the clean segments that it took most for toxic ones, and the machine is trained again.
Stems that are unevenly spread choose the other landmarks. The begin of a segment and the accents of its letters are letters
to the kernel, so stems differ from the same letters elsewhere. A text is scored on all its evidence: a logistic curve over
the histogram of its segments' values and its highest few, trained on labelled texts.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import sliced, table, worker_memo, written

LETTERS = 31  # a to z, the begin of a segment, and four for other alphabets
BEGIN, OTHER = b"{", b"|}~\x7f"
DECAY = 0.6
LONGEST = 20  # letters of a segment; longer ones are cut into windows that overlap by half
FLOOR = -4.0  # the value of a segment of less than three letters
#: bounds of the training sample.
TOXIC_ROWS, CLEAN_ROWS, UNITS, COMMON, OTHERS, SPELLED, LURES, LANDMARKS = 1500, 4000, 400, 6000, 12_000, 200, 300, 320
STEMS = (4, 5, 6, 7)
ALIKE = 0.8  # landmarks of a greater kernel value are not taken beside each other
COST = 300_000  # of either class
EDGES = np.arange(-5, 11) / 10  # of the histogram
TOPS = 6
SENTENCE_END = r"[.!?]+\s+|\n+"
CACHE = 150_000
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def folded(word: str) -> bytes:
    """The letters of a word: lower case, digits and signs dropped; accents, and letters of other alphabets, by their code point as one of OTHER.

    An accent stands behind its letter, so a word with and one without it share all but the subsequences with the accent.
    """
    word = word.lower()
    if word.isascii():
        return word.encode().translate(None, _NOT_LETTERS)
    parts = unicodedata.normalize("NFKD", word)
    return b"".join(c.encode().translate(None, _NOT_LETTERS) if c.isascii() else OTHER[ord(c) % 4 : ord(c) % 4 + 1] for c in parts if c.isalpha() or unicodedata.combining(c))


def windows_of(segment: bytes) -> list[bytes]:
    """What the kernel sees of a segment: the sign of its begin and its letters, in windows if they are many."""
    if len(segment) <= LONGEST:
        return [BEGIN + segment]
    half = LONGEST // 2
    return [BEGIN * (not k) + segment[k : k + LONGEST] for k in range(0, len(segment) - half, half)]


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a segment of n letters and their gap weights."""
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1)


def norms(codes: np.ndarray) -> np.ndarray:
    """Square root of each segment's kernel with itself (segments of one length, a row each)."""
    rows, n = codes.shape
    match = (codes[:, :, None] == codes[:, None, :]).astype(np.float64) * DECAY**2
    level = match
    for _ in range(2):
        for axis in (1, 2):  # sums over earlier positions, weighted by the gap
            out, carry = np.zeros_like(level), np.zeros((rows, n))
            for k in range(1, n):
                carry = carry * DECAY + (level[:, k - 1, :] if axis == 1 else level[:, :, k - 1])
                if axis == 1:
                    out[:, k, :] = carry
                else:
                    out[:, :, k] = carry
            level = out
        level = level * match
    return np.sqrt(np.maximum(level.sum((1, 2)), 1e-12))


def projected(segments: list[bytes], weights: np.ndarray, more: int = 0) -> np.ndarray:
    """Inner products of the normalised feature vectors with columns of weights (LETTERS ** 3 rows), and `more` columns of ones; short segments give 0."""
    width = weights.shape[1]
    out = np.zeros((len(segments), width + more))
    out[:, width:] = 1
    length = np.array([len(s) for s in segments], np.int64)
    for n in np.unique(length):
        if n < 3:
            continue
        at, gap = triples(int(n))
        pick = np.flatnonzero(length == n)
        step = max(1, 1_000_000 // (len(at) * weights.shape[1]))
        for lo in range(0, len(pick), step):
            rows = pick[lo : lo + step]
            codes = (np.frombuffer(b"".join(segments[i] for i in rows), np.uint8).reshape(len(rows), n) - 97).astype(np.int64)
            code = (codes[:, at[:, 0]] * LETTERS + codes[:, at[:, 1]]) * LETTERS + codes[:, at[:, 2]]
            sums = weights[:, 0][code] @ gap[:, None] if weights.shape[1] == 1 else np.einsum("rtm,t->rm", weights[code], gap)
            out[rows, :width] = sums / norms(codes)[:, None]
    return out


def feature_columns(segments: list[bytes], kind=np.float64) -> np.ndarray:
    """The normalised feature vectors of a few segments as columns."""
    out = np.zeros((LETTERS**3, len(segments)), kind)
    for k, s in enumerate(segments):
        at, gap = triples(len(s))
        c = np.frombuffer(s, np.uint8).astype(np.int64) - 97
        np.add.at(out[:, k], (c[at[:, 0]] * LETTERS + c[at[:, 1]]) * LETTERS + c[at[:, 2]], gap)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->j", out, out)), 1e-12).astype(kind)
    return out


def squared_hinge(z: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last weight is the offset.

    cost: of each row as an example of the toxic and of the clean class.
    """
    w = np.zeros(z.shape[1])  # the last column of z is one
    keep = np.eye(z.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(rounds):
        value = z @ w
        up, down = cost[:, 0] * (value < 1), cost[:, 1] * (value > -1)
        weight, bend = up + down, keep.copy()
        for k in range(0, len(z), 2048):
            bend += (z[k : k + 2048] * weight[k : k + 2048, None]).T @ z[k : k + 2048]
        new = np.linalg.solve(bend, z.T @ (up - down))
        if np.allclose(new, w, atol=1e-9):
            break
        w = w + 0.7 * (new - w) if _ > 20 else new
    return w


@dataclass
class Model:
    weights: np.ndarray  # one for each triple of letters
    offset: float
    curve: np.ndarray | None = None  # one for each column of evidence, and the offset; None: every text is clean

    @property
    def key(self) -> tuple:
        return (float(self.offset), float(self.weights.sum()), float(np.abs(self.weights).sum()))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve[:-1] + self.curve[-1], -30, 30)))


def segments_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct segments, the segment number of every occurrence, and the text of every occurrence."""
    lists = pc.utf8_split_whitespace(texts)
    flat = lists.flatten()
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    coded = flat.dictionary_encode()
    letters = [folded(w) for w in coded.dictionary.to_pylist()]
    number = np.asarray(coded.indices)
    short = (np.array([len(s) for s in letters] or [0]) <= 2)[number] if len(number) else np.zeros(0, bool)
    distinct = {s: k for k, s in enumerate(dict.fromkeys(letters))}
    seg = np.array([distinct[s] for s in letters] or [0], np.int64)[number] if len(number) else np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], short.view(np.int8), [0]])))
    extra, extra_of = [], []
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if hi - lo < 3:
            continue
        owners = text_of[lo:hi]
        for t in np.unique(owners):
            run = number[lo:hi][owners == t]
            if len(run) >= 3:
                joined = b"".join(letters[k] for k in run)
                extra.append(distinct.setdefault(joined, len(distinct)))
                extra_of.append(t)
    return list(distinct), np.append(seg, np.array(extra, np.int64)), np.append(text_of, np.array(extra_of, np.int64))


def segment_values(distinct: list[bytes], model: Model) -> np.ndarray:
    """The decision value of each segment; a worker remembers those of the model it used last."""
    known = worker_memo(f"toxicity {model.key}")
    if len(known) > CACHE:
        known.clear()
    new = [s for s in distinct if s not in known]
    pieces = [windows_of(s) for s in new]
    flat = [p for ps in pieces for p in ps]
    values = projected(flat, model.weights[:, None])[:, 0] + model.offset if flat else np.zeros(0)
    values[np.array([len(p.lstrip(BEGIN)) < 3 for p in flat], bool)] = FLOOR
    at = 0
    for s, ps in zip(new, pieces, strict=True):
        known[s] = float(values[at : at + len(ps)].max())
        at += len(ps)
    return np.array([known[s] for s in distinct])


def text_evidence(texts: pa.Array, model: Model) -> np.ndarray:
    """A row for each text: counts and shares of its segments above each edge, its highest values (0 at least), its length."""
    distinct, seg, owner = segments_of(texts)
    n = len(texts)
    value = segment_values(distinct, model)[seg] if len(seg) else np.zeros(0)
    real = value > FLOOR
    value, owner = value[real], owner[real]
    width = len(EDGES) + 1
    bins = np.bincount(owner * width + np.searchsorted(EDGES, value), minlength=n * width).reshape(n, width)
    above = bins[:, ::-1].cumsum(1)[:, ::-1]
    size, above = above[:, :1], above[:, 1:]
    tops = np.zeros((n, TOPS))
    high = value > 0
    value, owner = value[high], owner[high]
    order = np.lexsort((-value, owner))
    value, owner = value[order], owner[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    tops[owner[place < TOPS], place[place < TOPS]] = value[place < TOPS]
    return np.hstack([np.log1p(size), np.log1p(above), above / np.maximum(size, 1), tops])


def sentence_segments(texts: pa.Array, toxic: np.ndarray, model: Model | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct segments, and of each: its weight in toxic sentences, in clean ones, and its occurrences.

    An occurrence weighs one by the segments of its text. With a model, toxic texts keep the sentences that have a segment
    above zero, and their highest one.
    """
    lists = pc.split_pattern_regex(texts, SENTENCE_END)
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    distinct, seg, sentence = segments_of(lists.flatten())
    long = np.array([len(s) >= 3 for s in distinct] or [False])[seg] if len(seg) else np.zeros(0, bool)
    seg, sentence = seg[long], sentence[long]
    if model is not None and len(seg):
        value = segment_values(distinct, model)[seg]
        top = np.full(len(text_of), FLOOR)
        np.maximum.at(top, sentence, value)
        highest = np.full(len(texts), FLOOR)
        np.maximum.at(highest, text_of, top)
        stays = (toxic[text_of] == 0) | (top > 0) | (top >= highest[text_of])
        seg, sentence = seg[stays[sentence]], sentence[stays[sentence]]
    text = text_of[sentence]
    weight = 1 / np.maximum(np.bincount(text, minlength=len(texts)), 1)[text]
    sums = [np.bincount(seg, weights=w, minlength=len(distinct)) for w in (weight * (toxic[text] == 1), weight * (toxic[text] == 0), np.ones(len(seg)))]
    return distinct, *sums


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def variants(word: bytes) -> list[bytes]:
    """A letter dropped, doubled or inserted."""
    out = [word[:k] + word[k + 1 :] for k in range(1, len(word) - 1)] if len(word) > 4 else []
    out += [word[:k] + word[k : k + 1] + word[k:] for k in range(len(word))]
    return out + [word[:k] + b"x" + word[k:] for k in range(1, len(word))]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most TOXIC_ROWS + CLEAN_ROWS labelled texts outside the held-out third, chosen by a hash of the id.

    Rows without an id or label are left out. Without toxic or without clean rows the model rates every text as clean.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    chosen = marked.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(marked.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("content")).filter("content IS NOT NULL")
    sample = rows.join(F.broadcast(chosen), "doc_id")  # the chosen ids are bounded
    sample = sample.groupBy("content").agg(F.max("toxic").alias("toxic"))  # a text that is marked toxic once counts as such
    sample = written(sample, "toxicity-sample")
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    model = Model(np.zeros(LETTERS**3), 0.0)
    if not n_toxic or not n_clean:
        return model
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = (total[0] / total[1]) / (n_clean / n_toxic)  # clean rows of the table for each one in the sample
    model = machine(sample, None)
    model = machine(sample, model) or model
    if model is None:  # no segment of three letters in either class
        model = Model(np.zeros(LETTERS**3), 0.0)

    def evidence_rows(batches):
        for b in sliced(batches):
            rows = text_evidence(b.column("content").cast(pa.large_string()), model)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["toxic", "evidence"])

    pairs = sample.select("content", "toxic").mapInArrow(evidence_rows, "toxic int, evidence array<double>").toArrow()  # bounded by the sample
    evidence = np.asarray(pairs.column("evidence").combine_chunks().flatten()).reshape(len(pairs), -1)
    model.curve = curve_of(evidence, np.asarray(pairs.column("toxic")), scale)
    return model


def machine(sample: DataFrame, model: Model | None) -> Model | None:
    """The machine of the sample's sentences, refined by that of the round before; None if a class has no segments."""

    def segment_rows(batches):
        for b in sliced(batches):
            distinct, t, c, n = sentence_segments(b.column("content").cast(pa.large_string()), np.asarray(b.column("toxic")), model)
            held = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array([distinct[k].decode() for k in held], pa.string()), *(pa.array(x[held]) for x in (t, c, n))], names=["segment", "t", "c", "n"])

    found = sample.select("content", "toxic").mapInArrow(segment_rows, "segment string, t double, c double, n double")
    seen = written(found.groupBy("segment").agg(*(F.sum(k).alias(k) for k in "tcn")), "toxicity-counts")
    sums = seen.agg(*(F.sum(k).alias(k) for k in "tcn"), F.count(F.lit(1)).alias("rows")).first()
    if not sums["t"] or not sums["c"]:
        return None
    each = sums["n"] / (sums["t"] + sums["c"])  # so that an occurrence weighs one on the average
    clean = F.col("c") * (sums["t"] / sums["c"])
    stems = [F.when(F.length("segment") > k, F.substring("segment", 1, k)) for k in STEMS]
    units = seen.select(F.explode(F.array_distinct(F.array_compact(F.array("segment", *stems)))).alias("unit"), "segment", "t", "c")
    units = units.groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.max(F.struct("t", "segment")).alias("most"))
    uneven = (F.col("t") - clean) / F.sqrt(F.col("t") + clean + 3 / each)
    units = units.select("unit", "most.segment", "t", clean.alias("c"), uneven.alias("uneven")).orderBy(F.col("uneven").desc(), "unit").limit(UNITS).collect()
    marks = list(dict.fromkeys(w.encode()[:LONGEST] for r in units for w in (r["unit"], r["segment"])))
    spelled = [r["segment"].encode() for r in units if r["segment"] == r["unit"] and r["t"] > 5 * r["c"]][:SPELLED]
    told = sorted({r["segment"] for r in units})
    common = seen.filter(~F.col("segment").isin(told)).orderBy((F.col("t") + F.col("c")).desc(), "segment").limit(COMMON).collect()
    known = sorted({r["segment"] for r in common} | set(told))
    others = seen.join(F.broadcast(seen.sparkSession.createDataFrame([(w,) for w in known], "segment string")), "segment", "left_anti")  # UNITS + COMMON rows
    others = others.orderBy(F.md5("segment"), "segment").limit(OTHERS).collect()
    share = (sums["rows"] - len(known)) / max(len(others), 1)
    examples = [(r["segment"].encode(), r["t"], r["c"]) for r in seen.filter(F.col("segment").isin(told)).collect() + common]
    examples += [(r["segment"].encode(), r["t"] * share, r["c"] * share) for r in others]
    lures = [] if model is None else mistaken(seen, model, sums["t"] / sums["c"])
    return fit(sorted(examples), marks, set(spelled), [r["segment"].encode() for r in common], lures)


def mistaken(seen: DataFrame, model: Model, scale: float) -> list[bytes]:
    """The segments of clean sentences that the model takes most for toxic ones; the next machine has landmarks there, too."""

    def run(batches):
        for b in batches:
            values = segment_values([s.encode() for s in b.column("segment").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values)], names=["segment", "t", "c", "value"])

    valued = seen.select("segment", "t", "c").mapInArrow(run, "segment string, t double, c double, value double")
    harm = (F.col("c") * scale - F.col("t")) * F.col("value")
    return [r["segment"].encode() for r in valued.filter((F.col("value") > 0) & (harm > 0)).orderBy(harm.desc(), "segment").limit(LURES).collect()]


def fit(examples: list[tuple[bytes, float, float]], marks: list[bytes], spelled: set[bytes], common: list[bytes], lures: list[bytes] = []) -> Model:  # noqa: B006
    """Nyström features on landmarks, then the linear machine.

    A segment stands for the toxic and the clean sentences that it was found in, as examples of either class. Those in
    spelled give half of their weight to their variants. Half of the landmarks are at marks, three eighths at lures (segments
    that an earlier machine mistook), the others at common segments.
    """
    held, chosen = np.zeros((LANDMARKS, LETTERS**3), np.float32), []
    for words, most in ((marks, LANDMARKS // 2), (lures, LANDMARKS * 7 // 8)):
        for w in (BEGIN + w[:LONGEST] for w in words if len(w) >= 3):
            column = feature_columns([w], np.float32)[:, 0]  # one at a time: all of them would take much of the driver's memory
            if len(chosen) < most and (not chosen or (held[: len(chosen)] @ column).max() < ALIKE):
                held[len(chosen)] = column
                chosen.append(w)
    del held
    left = LANDMARKS - len(chosen)
    plain = [BEGIN + w[:LONGEST] for w in common[:: max(1, len(common) // left)]][:left]
    columns = feature_columns(list(dict.fromkeys(chosen + plain)), np.float32)  # single numbers, for the driver's memory
    values, vectors = np.linalg.eigh((columns.T @ columns).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    basis = columns @ root.astype(np.float32)  # features of a segment: its inner products with these columns
    del columns
    x, cost = [], []
    for s, t, c in examples:
        lures = [v for v in variants(s) if len(v) <= LONGEST] if s in spelled else []
        for w in windows_of(s):
            x.append(w)
            cost.append((t, c) if not lures else (t / 2, c / 2))
        x += [BEGIN + v for v in lures]
        cost += [(t / 2 / len(lures), c / 2 / len(lures)) for _ in lures]
    cost = np.array(cost)
    cost = cost / cost.sum(0) * COST
    w = squared_hinge(projected(x, basis, 1), cost)
    return Model(basis @ w[:-1], float(w[-1]))


def curve_of(evidence: np.ndarray, toxic: np.ndarray, scale: float) -> np.ndarray:
    """Weights and offset of a logistic curve, lightly regularised; a clean row stands for scale rows."""
    mean, spread = evidence.mean(0), evidence.std(0)
    spread = np.where(spread > 1e-9, spread, np.inf)
    x = np.column_stack([(evidence - mean) / spread, np.ones(len(evidence))])
    weight = np.where(toxic == 1, 1.0, scale)
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    pull = np.diag(np.append(np.full(len(mean), 3e-4), 1e-9))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, x.T @ (weight * (p - toxic)) + pull @ w)
        w = w - step * min(1, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] / spread) @ mean)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null text is scored as an empty one. Only the text is looked at.

    keep: columns of the input to carry along instead of doc_id and held_out; the text crosses to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LETTERS ** 3 weights
    carried = [F.col(c) for c in keep] if keep else [F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out")]
    own = keep.index(text_col) if keep and text_col in keep else len(carried)
    rows = docs.select(*carried) if own < len(carried) else docs.select(*carried, F.col(text_col).cast("string").alias("scored_content"))
    names = [c for c in rows.columns if c != "scored_content"]

    def run(batches):
        for b in sliced(batches, own, 2 << 20):
            p = shared.value.probability(text_evidence(pc.fill_null(b.column(own).cast(pa.large_string()), ""), shared.value))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in names)
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
