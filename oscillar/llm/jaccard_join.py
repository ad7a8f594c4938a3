"""N-gram Jaccard join as a blocked sparse matrix product of the document by n-gram incidence.

Rows of the matrix are the distinct sets, so copies cost nothing. Sizes bound how far two linked rows can differ, and that
bound is used three times to discard what can't be linked: a row whose first columns (in the order of their hashes) are
mostly its own has no partner; of enough column blocks two linked rows are equal in at least one, so rows that share no
block are not multiplied; and within the product a pair goes as soon as its accumulated overlap and what is left of the two
rows stay below the overlap that their sizes ask for. What remains forms clusters; a cluster is cut into row blocks, and each
pair of row blocks is one task's product, which accumulates the overlap counts column block by column block. A task returns
a spanning forest of the links that it finds and their number for each row, not the pairs.

Where only the components are asked for, every row is first multiplied by one pivot, the row that it shares the most column
blocks with; rows found to be of one component need no further product, which leaves little of a large group of near copies.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import U64, RowFilter, WordHashes, discard, identified, join_counted, mix, packed_texts, pair_hash, release_memory, sliced, table, unpacked, worker_memo, written
from oscillar.llm.components import components

NGRAM = 3
#: links at 100 * intersection >= PERCENT * union.
PERCENT = 90
#: bounds of a row block: its rows and their elements; a task multiplies two row blocks.
BLOCK_ROWS, BLOCK_ELEMENTS = 1024, 1 << 19
#: rounds of pivots where links are not counted.
PIVOTS = 1
#: bytes of the texts whose sets a task makes at a time; sets hold some fifty times as much while they are made.
SLICE_BYTES = 1 << 20
#: columns of a column block.
BLOCK_COLUMNS = 2048
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def most_difference(total: int, percent: int = PERCENT) -> int:
    """How many elements two linked sets may differ in, if their sizes add up to total."""
    return total * (100 - percent) // (100 + percent)


def size_classes(largest: int, percent: int = PERCENT, ratio: float = 1.4) -> list[tuple[int, int, int, int]]:
    """(first size, last size, blocks, spare): classes of sizes above the smallest class, which sheds single elements.

    A set also joins the next class if a set of that class may be linked with it. Of the blocks, at least 1 + spare are equal
    in two linked sets, so a set with at most spare empty blocks needs no signature for those.
    """
    first = 1
    while most_difference(2 * first, percent) < 2:
        first += 1
    out = []
    while first <= largest:
        last = max(first, int(first * ratio) - 1)
        k = most_difference(2 * last, percent)
        spare = 1 + k // 8
        out.append((first, last, k + 1 + spare, spare))
        first = last + 1
    return out


def ngram_sets(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, flat, with each text's first element; fewer than n words are one n-gram."""
    w = WordHashes(texts, LOWER)
    h, starts = w.hashes, w.starts
    count = np.diff(starts)
    doc = np.repeat(np.arange(len(count)), count)
    grams, owner = [], []
    for width in range(1, n + 1):
        g = h
        for k in range(1, width):
            g = pair_hash(g[:-1], h[k:], width)
        whole = doc[: len(g)] == doc[width - 1 :] if len(g) else np.zeros(0, bool)
        fits = count[doc[: len(g)]] >= n if width == n else count[doc[: len(g)]] == width
        at = np.flatnonzero(whole & fits)
        grams.append(g[at])
        owner.append(doc[at])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(count) + 1))


def prefix_sizes(n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(m, c): of a set's first m elements in the common order, at least c are among the first ones of any linked set, too.

    Linked sets differ in at most (a + b) * (100 - percent) / (100 + percent) elements, and a set has at most so many elements
    before a shared one as the other set has before it and this difference. With m(x) >= mu * x + 1 (or all), the shared ones
    of both prefixes are m(b) - difference, which is least for the smallest linked b, percent * a / 100; mu is 7 / 4 of
    (100 - percent) / 100, so c = (percent * mu / 100 - (100 - percent) / 100) * a.
    """
    apart, gain = 100 - percent, 7 * percent - 400
    if gain < 0:
        return n, np.minimum(n, 1)
    return np.minimum(n, -(-7 * apart * n // 400) + 1), np.minimum(n, np.maximum(1, apart * gain * n // 40_000))


def signatures(grams: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of each set, flat, their kinds, and each set's first: two linked sets that differ share at least one.

    at: the first element of each set, and the end. A kind packs a class of sizes with the number of signatures (the lowest
    16 bits) that a set shares at least with a linked one of that class.
    """
    n = np.diff(at)
    h = mix(grams)
    sums = np.append(U64(0), np.cumsum(h, dtype=U64))
    totals = sums[at[1:]] - sums[at[:-1]]
    classes = size_classes(max(2 * int(n.max(initial=0)), 64), percent)
    small = classes[0][0] - 1  # up to here linked sets differ in one element
    shrinks, grows = (n > 0) & (n <= small) & (100 * (n - 1) >= percent * n), (n > 0) & (n < small) & (100 * n >= percent * (n + 1))
    own = np.repeat(np.arange(len(n)), n)
    salt = U64(0x5851F42D4C957F2D)
    part = np.flatnonzero(shrinks[own])
    found = [mix((totals[own[part]] - h[part]) ^ salt), mix(totals[shrinks | grows] ^ salt)]
    owners = [own[part], np.flatnonzero(shrinks | grows)]
    kinds = [np.ones(len(x), np.int64) for x in owners]
    block_hash, weight = (h >> U64(11)), mix(h)
    for number, (first, last, blocks, spare) in enumerate(classes, 1):
        sets = np.flatnonzero((n > 0) & (n <= last) & ((n >= first) | (100 * n >= percent * first)))
        if not len(sets):
            continue
        place = np.full(len(n), -1)
        place[sets] = np.arange(len(sets))
        mine = np.flatnonzero(place[own] >= 0)
        slot = place[own[mine]] * blocks + (block_hash[mine] % U64(blocks)).astype(np.int64)
        sums = np.zeros(len(sets) * blocks, U64)
        np.add.at(sums, slot, weight[mine])
        full = np.bincount(slot, minlength=len(sums)).reshape(len(sets), blocks) > 0
        empty = blocks - full.sum(1)
        full |= (empty > spare)[:, None]  # empty blocks speak for themselves where they are many
        pick = np.flatnonzero(full.ravel())
        found.append(pair_hash(sums[pick], mix((pick % blocks).astype(U64) + U64(first) * U64(1 << 20)), 5))
        owners.append(sets[pick // blocks])
        kinds.append((number << 16) + np.minimum(1 + spare - np.minimum(spare, empty), (1 << 16) - 1)[pick // blocks])
    found, owners, kinds = np.concatenate(found), np.concatenate(owners), np.concatenate(kinds)
    order = np.argsort(owners, kind="stable")
    return found[order], kinds[order], np.searchsorted(owners[order], np.arange(len(n) + 1))


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def set_rows(rows: DataFrame, percent: int = PERCENT, words: int = NGRAM) -> DataFrame:
    """doc_id, row, n, fp (128-bit fingerprint of the set; null without words), prefix, m and c of prefix_sizes()."""

    def run(batches):
        worker_memo("jaccard")  # nothing of the stage before is remembered beside the sets
        for b in sliced(batches, most_bytes=SLICE_BYTES):
            grams, at = ngram_sets(b.column("content"), words)
            n = np.diff(at)
            fps = [hashlib.md5(grams[lo:hi].tobytes()).digest() if hi > lo else None for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            m, c = prefix_sizes(n, percent)
            ends = np.cumsum(m)
            first = grams[np.repeat(at[:-1] - ends + m, m) + np.arange(int(ends[-1]))]  # an order of hashes is as good as any
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), lists(first, np.append(0, ends)), pa.array(m, pa.int64()), pa.array(c, pa.int64())],
                names=["doc_id", "row", "n", "fp", "prefix", "m", "c"],
            )

    return rows.select("doc_id", "row", "content").mapInArrow(run, "doc_id long, row long, n long, fp binary, prefix array<bigint>, m long, c long")


def signed_sets(texts: DataFrame, percent: int = PERCENT, words: int = NGRAM) -> DataFrame:
    """node, copies, n, grams, sigs and kinds of packed texts."""

    def run(batches):
        for b in sliced(batches, "size", SLICE_BYTES):
            grams, at = ngram_sets(pa.array([t.decode() for t in unpacked(b.column("frame"))], pa.large_string()), words)
            sigs, kinds, first = signatures(grams, at, percent)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("copies"), pa.array(np.diff(at), pa.int64()), lists(grams, at), lists(sigs, first), lists(kinds, first)], names=["node", "copies", "n", "grams", "sigs", "kinds"]
            )

    return texts.select("row", "copies", "frame", "size").mapInArrow(run, "node long, copies long, n long, grams array<bigint>, sigs array<bigint>, kinds array<bigint>")


def product(sets: list[np.ndarray], left: int, cross: bool, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i < j) of a block pair: of all rows, or across the first `left` rows and the others.

    Overlaps are accumulated over blocks of the columns that more than one row has. After each, the pairs that can't reach
    the overlap which their sizes ask for are discarded, and rows without a pair are multiplied no further.
    """
    sizes = np.array([len(s) for s in sets], np.int32)
    cols = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, col, seen = np.unique(cols, return_inverse=True, return_counts=True)
    several = seen[col] > 1
    number = np.cumsum(seen > 1) - 1
    row, col = row[several], number[col[several]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = sizes.astype(np.int64)
    need = (-(-percent * (both[:, None] + both[None, :]) // (100 + percent))).astype(np.int32)
    alive = np.triu(np.ones(need.shape, bool), 1)
    if cross:
        alive[:left, :left] = False
        alive[left:, left:] = False
    rest = np.bincount(row, minlength=len(sets)).astype(np.int32)
    overlap = np.zeros(need.shape, np.float32)
    alive &= np.minimum(rest[:, None], rest[None, :]) >= need
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, BLOCK_COLUMNS):
        rows = np.flatnonzero(alive.any(0) | alive.any(1))
        if not len(rows):
            break
        lo, hi = np.searchsorted(col, [first, first + BLOCK_COLUMNS])
        place = np.full(len(sets), -1)
        place[rows] = np.arange(len(rows))
        mine = place[row[lo:hi]]
        part = np.zeros((len(rows), BLOCK_COLUMNS), np.float32)
        part[mine[mine >= 0], col[lo:hi][mine >= 0] - first] = 1
        overlap[np.ix_(rows, rows)] += part @ part.T
        rest -= np.bincount(row[lo:hi], minlength=len(sets)).astype(np.int32)
        alive &= overlap >= need - np.minimum(rest[:, None], rest[None, :])
    return np.nonzero(alive)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
    return out


def block_links(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, links: edges (b not null) and for each row of the matrix its number of linked rows in the block pair (b null).

    Input: rows of root, p, q (a block pair of a cluster), side (0: of block p), node, copies, grams, sorted by root, p, q.
    """

    def flush(key, held):
        held.sort(key=lambda x: x[:2])
        sets = [s for *_, s in held]
        left = sum(1 for side, *_ in held if side == 0)
        i, j = product(sets, left, key[1] != key[2], percent)
        copies = np.array([c for _, _, c, _ in held], np.int64)
        links = np.zeros(len(held), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        nodes = [f for _, f, _, _ in held]
        edges = [(nodes[a], nodes[b], 0) for a, b in forest(i, j, len(held))]
        return edges + [(nodes[k], None, int(links[k])) for k in np.flatnonzero(links)]

    def run(batches):
        key, held, out = None, [], []
        for b in batches:
            at = np.asarray(b.column("grams").offsets)
            grams = b.column("grams").values.to_numpy().view(U64)
            cols = [b.column(c).to_pylist() for c in ("root", "p", "q", "side", "node", "copies")]
            for k, (root, p, q, side, node, copies) in enumerate(zip(*cols, strict=True)):
                if (root, p, q) != key:
                    out += flush(key, held) if len(held) > 1 else []
                    key, held = (root, p, q), []
                held.append((side, node, copies, grams[at[k] : at[k + 1]].copy()))
            if len(out) > 20_000:
                yield rows_of(out)
                out = []
        out += flush(key, held) if len(held) > 1 else []
        yield rows_of(out)
        release_memory()

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["a", "b", "links"])

    return blocks.mapInArrow(run, "a long, b long, links long")


def shared_signatures(signed: DataFrame, trim: bool = False) -> DataFrame:
    """node, root, kinds, sig: the signatures that rows of different roots share, of rows that share as many of a kind as a linked row would.

    Of so many signatures that two linked rows share at least, one is left if either row drops its commonest but for that
    number; trim does so, and keeps what is still shared.
    """
    some = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("sig", "n")
    some = written(some, "jaccard-shared")
    met = join_counted(signed, some.withColumn("k", F.col("n")), ["sig"])
    own = met.groupBy("node", "root", "kinds").agg(F.array_sort(F.collect_list(F.struct("k", "sig"))).alias("sigs"))
    least = F.col("kinds").bitwiseAND(F.lit((1 << 16) - 1)).cast("int")
    enough = own.filter(F.size("sigs") >= least)
    if not trim:
        return written(enough.select("node", "root", "kinds", F.explode("sigs").alias("s")).select("node", "root", "kinds", "s.sig"), "jaccard-met")
    few = written(enough.select("node", "root", F.explode(F.slice("sigs", F.lit(1), F.size("sigs") - least + 1)).alias("s")).select("node", "root", "s.sig"), "jaccard-rare")
    left = few.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("sig", "n")
    return written(join_counted(few, written(left, "jaccard-shared"), ["sig"]), "jaccard-met")


def multiplied(kept: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The links of rows (node, root, p, q, side): a product for each root, p, q; side 0 stands first."""
    pairs = kept.select("node", "copies", "grams").join(rows, "node").select("root", "p", "q", "side", "node", "copies", "grams")
    return written(block_links(pairs.repartition(F.col("root"), F.col("p"), F.col("q")).sortWithinPartitions("root", "p", "q"), percent), "jaccard-links")


def block_count(block_rows: int):
    """Row blocks of the rows (with their sizes n) of a group."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks")


def banded(kept: DataFrame, clusters: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """node, root, own, others: the row block of every row and those that it is multiplied with.

    A cluster of one row block is multiplied by itself. The rows of a larger one lie in bands of sizes, in which linked rows
    are neighbours: blocks are cut from a band and meet those of their own and the next bands only.
    """
    held = clusters.join(kept.select("node", "n"), "node").withColumn("band", F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-6))).cast("long"))
    sizes = held.groupBy("root", "band").agg(block_count(block_rows), F.count(F.lit(1)).alias("n"), F.sum("n").alias("elements"))
    whole = F.greatest(F.ceil(F.sum("n") / block_rows), F.ceil(F.sum("elements") / BLOCK_ELEMENTS)).cast("int").alias("whole")
    sizes = sizes.groupBy("root").agg(whole, F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"))  # bands grow with the logarithm of the longest text
    held = join_counted(held.drop("n"), written(sizes, "jaccard-sizes"), ["root"])
    count = lambda d: F.coalesce(F.try_element_at("bands", F.col("band") + d), F.lit(0))
    of_band = lambda d: F.when(count(d) > 0, F.transform(F.sequence(F.lit(0), count(d) - 1), lambda o: (F.col("band") + d) * (1 << 24) + o)).otherwise(F.array().cast("array<bigint>"))
    own = F.col("band") * (1 << 24) + F.pmod(F.xxhash64("node"), count(0))
    one, zero = F.col("whole") == 1, F.lit(0).cast("long")
    return held.select("node", "root", F.when(one, zero).otherwise(own).alias("own"), F.when(one, F.array(zero)).otherwise(F.concat(*(of_band(d) for d in (-1, 0, 1)))).alias("others"))


def cluster_links(kept: DataFrame, clusters: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """The links within clusters (node, root), by the products of pairs of their row blocks."""
    rows = banded(kept, clusters, percent, block_rows).withColumn("o", F.explode("others"))
    return multiplied(kept, rows.select("node", "root", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), (F.col("own") > F.col("o")).cast("int").alias("side")), percent)


def pivot_links(kept: DataFrame, met: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """The links between rows and their pivots. met: node, sig, root; a row's pivot is the lowest row of another component that leads most of its signatures."""
    leads = met.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("root", "node")).alias("lead"))
    pairs = join_counted(met, written(leads, "jaccard-leads"), ["sig"]).filter("root <> lead.root")
    pairs = pairs.groupBy("node", F.col("lead.node").alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    stars = pairs.groupBy("node").agg(F.max(F.struct("n", (-F.col("lead")).alias("minus"))).alias("best")).select("node", (-F.col("best.minus")).alias("root"))
    stars = written(stars, "jaccard-stars")
    sizes = stars.join(kept.select("node", "n"), "node").groupBy("root").agg(block_count(block_rows), F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, "jaccard-sizes")
    rows = join_counted(stars, sizes, ["root"]).select("node", "root", F.lit(0).alias("p"), (F.pmod(F.xxhash64("node"), F.col("blocks")) + 1).cast("int").alias("q"), F.lit(1).alias("side"))
    pivots = sizes.select(F.col("root").alias("node"), "root", F.lit(0).alias("p"), F.explode(F.sequence(F.lit(1), "blocks")).alias("q"), F.lit(0).alias("side"))
    return multiplied(kept, rows.unionByName(pivots), percent)


def rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    """met with the components found so far as root."""
    held = met.drop("root").join(roots, "node", "left")
    return written(held.withColumn("root", F.coalesce("root", "node")), "jaccard-held")


def chained(met: DataFrame) -> DataFrame:
    """node, root: rows of equal root share a signature, directly or by way of others."""
    leads = met.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"))
    near = join_counted(met, written(leads, "jaccard-leads"), ["sig"]).filter("node <> lead")
    return components(near.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "bigint")


def component_roots(kept: DataFrame, met: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """node, root of the components, by pivots first and then by what may still be linked across components.

    That lies in clusters of rows that share signatures. A cluster is multiplied by its row blocks or, where that copies more
    rows, by the groups of rows that share a signature (groups of the same rows are one).
    """
    edges = kept.sparkSession.createDataFrame([], "a long, b long")
    for _ in range(PIVOTS):
        edges = edges.unionByName(pivot_links(kept, met, percent, block_rows).filter("b IS NOT NULL").select("a", "b"))
        met = shared_signatures(rooted(met, components(edges, "bigint")))
    met = shared_signatures(met, trim=True)
    clusters = written(chained(met).withColumnRenamed("root", "cluster"), "jaccard-clusters")
    groups = met.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("least"), F.max("node").alias("most"))
    groups = groups.groupBy("n", "members", "least", "most").agg(F.min("sig").alias("sig")).select("sig", "n", F.col("least").alias("node"))
    groups = written(groups.join(clusters, "node").select("sig", "n", "cluster"), "jaccard-groups")
    by_group = groups.groupBy("cluster").agg(F.sum("n").alias("by_group"))
    by_block = banded(kept, clusters.withColumnRenamed("cluster", "root"), percent, block_rows).groupBy(F.col("root").alias("cluster")).agg(F.sum(F.size("others")).alias("by_block"), F.count(F.lit(1)).alias("n"))
    chosen = written(by_block.join(by_group, "cluster").select("cluster", "n", (F.col("by_group") < F.col("by_block")).alias("grouped")), "jaccard-chosen")
    whole = join_counted(clusters, chosen.filter("NOT grouped").select("cluster", "n"), ["cluster"]).select("node", F.col("cluster").alias("root"))
    some = groups.join(chosen.filter("grouped").select("cluster"), "cluster").select("sig", "n")
    parts = join_counted(met.select("node", "sig"), written(some, "jaccard-few"), ["sig"]).select("node", F.col("sig").alias("root"))
    last = cluster_links(kept, written(whole.unionByName(parts), "jaccard-parts"), percent, block_rows)
    return components(edges.unionByName(last.filter("b IS NOT NULL").select("a", "b")), "bigint")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block_rows: int = BLOCK_ROWS, words: int = NGRAM, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, with count_links, n_links for every row.

    To count its links, a row is multiplied by all rows of its cluster; without, the components are found by fewer products.

    A null text counts as empty; rows without words have no set, no links and are components of their own. component_id is
    the smallest id of the component (null ids are passed over unless there is no other). Rows that repeat a row are linked
    with it. n_links counts linked rows, those of the same set included. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    rows = identified(docs, id_col, text_col)
    sets = written(set_rows(rows, percent, words), "jaccard-sets")
    ids = written(sets.select("doc_id", F.col("n").alias("n_shingles"), "fp"), "jaccard-ids")
    some = sets.filter("fp IS NOT NULL")
    classes = some.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "m", "c")).alias("one"))
    classes = written(classes.select("fp", "least", "copies", "one.row", "one.m", "one.c"), "jaccard-classes")
    held = some.select("row", F.explode("prefix").alias("gram")).groupBy("gram").agg(F.min("row").alias("row"), F.max("row").alias("other"))
    alone = held.filter("row = other").groupBy("row").agg(F.count(F.lit(1)).alias("alone"))
    alike = classes.join(alone, "row", "left").filter(F.col("m") - F.coalesce("alone", F.lit(0)) >= F.col("c")).select("row", "copies")
    alike = written(alike, "jaccard-alike")
    discard(sets)
    kept = written(signed_sets(packed_texts(rows, RowFilter(alike)).join(alike, "row"), percent, words), "jaccard-kept")
    signed = kept.select("node", F.col("node").alias("root"), F.explode(F.arrays_zip("kinds", "sigs")).alias("s")).select("node", "root", "s.kinds", F.col("s.sigs").alias("sig"))
    met = shared_signatures(signed, trim=count_links)
    if count_links:
        links = cluster_links(kept, written(chained(met), "jaccard-clusters"), percent, block_rows)
        roots = components(links.filter("b IS NOT NULL").select("a", "b"), "bigint")
        counts = links.filter("b IS NULL").groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    else:
        roots = component_roots(kept, met, percent, block_rows)
        counts = classes.limit(0).select("row", F.lit(0).cast("long").alias("links"))
    known = classes.join(roots.withColumnRenamed("node", "row"), "row", "left").join(counts, "row", "left")
    known = known.select("fp", F.coalesce("root", "row").alias("root"), "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    known = join_counted(known, written(least, "jaccard-least"), ["root"])
    known = written(known.select("fp", "component_id", "n_links", F.col("copies").alias("n")), "jaccard-known")
    discard(kept, met)
    lone = ids.filter("fp IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = join_counted(ids, known, ["fp"]).select("doc_id", "n_shingles", "component_id", "n_links").unionByName(lone)
    return out if count_links else out.drop("n_links")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 2], ' ') AS g FROM texts, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS r(s) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * o >= 90 * (a.n + b.n - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS node, x AS seen FROM both_ways UNION SELECT node, y FROM reach JOIN both_ways ON seen = x),
comps AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
degrees AS (SELECT x, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, t.doc_id) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM texts t LEFT JOIN sizes s ON t.doc_id = s.doc_id LEFT JOIN comps ON node = t.doc_id LEFT JOIN degrees ON x = t.doc_id
"""
