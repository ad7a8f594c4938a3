"""Source divergence audit: how far the words of the sources of a language lie from each other and from the language.

Counts of terms are postings, a row for each term of a source. The terms that lead a source are searched by upper bounds: its
terms fall into buckets of like counts, and no term of a bucket is worth more than the bucket's largest probability over its
smallest probability in the language. Buckets are evaluated best bound first: those that hold enough terms give the last value
that counts so far, and of the rest only buckets whose bound isn't strictly below it are evaluated.

Pairs of sources are told by postings, too. Of a term that one of them lacks the other's count alone decides, so counts of
counts suffice; only terms that both have are met one by one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oscillar.llm.common import release_memory, table, written

#: fixed values of the report: documents that a term needs, ranks, units of a probability, smoothing.
LEAST_DOCS, TOP, UNIT, ALPHA = 3, 200, 1_000_000_000, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: so many rows of sources or buckets (some MB) are broadcast; more of them are joined, each key in SALTS parts.
FEW, SALTS = 50_000, 16
#: pairs of postings that are multiplied at a time.
PAIRS = 1 << 19
GROUP = ["lang", "source"]


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT (count + ALPHA) / (total + ALPHA kept)), exactly."""
    return F.expr(f"1L + (CAST({count} + {ALPHA} AS DECIMAL(20, 0)) * CAST({UNIT} AS DECIMAL(10, 0))) div CAST({total} + {ALPHA} * {kept} AS DECIMAL(20, 0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def met(rows: DataFrame, few: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """rows joined with few (a written table, one row for a key or a handful), so that a key of many rows isn't one task's."""
    if few.count() <= FEW:
        return rows.join(F.broadcast(few), on)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def postings(texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n and, of the language, lang_n of the terms that so many of its documents have; lead marks one row of each."""
    words = F.array_remove(F.split(F.translate("content", UPPER, LOWER), BETWEEN), "")
    each = texts.withColumn("words", words).withColumn("size", F.size("words"))
    each = each.select(*GROUP, "size", F.posexplode(F.concat("words", F.array_distinct("words"))).alias("at", "term"))  # the second half counts documents
    told = [F.sum((F.col("at") < F.col("size")).cast("long")).alias("n"), F.sum((F.col("at") >= F.col("size")).cast("long")).alias("docs")]
    same = Window.partitionBy("lang", "term")
    counted = each.groupBy(*GROUP, "term").agg(*told)
    counted = counted.withColumn("lang_n", F.sum("n").over(same)).withColumn("lang_docs", F.sum("docs").over(same)).withColumn("lead", F.col("source") == F.min("source").over(same))
    return counted.filter(F.col("lang_docs") >= least_docs).select(*GROUP, "term", "n", "lang_n", "lead")


def leading_terms(scored: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value: the `top` terms of each source that it has more often than its language does."""
    bits = F.length(F.bin("n"))
    bucket = F.when(F.col("n") < 8, F.col("n")).otherwise(8 * bits + F.expr("shiftright(n, CAST(length(bin(n)) AS INT) - 3)"))
    ahead = scored.filter("p > q").withColumn("bucket", bucket.cast("long"))
    bounds = ahead.groupBy(*GROUP, "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"), F.min("q").alias("q")).withColumn("bound", divergence("p", "q"))
    earlier = Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = written(bounds.select(*GROUP, "bucket", "bound", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) < top).alias("first")), "divergence-bounds")
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")

    def evaluated(buckets: DataFrame) -> DataFrame:
        found = met(ahead, written(buckets.select(*GROUP, "bucket"), "divergence-chosen"), [*GROUP, "bucket"], ["term"])
        return found.select(*GROUP, F.col("term").alias("item"), divergence("p", "q").alias("value"))

    def highest(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    first = written(highest(evaluated(bounds.filter("first"))), "divergence-first")
    last = first.filter(F.col("rank") == top).select(*GROUP, F.col("value").alias("last"))  # without one, all buckets are evaluated
    open_ = bounds.filter("NOT first").join(last, GROUP).filter("bound >= last")
    return highest(first.drop("rank").unionByName(evaluated(open_)))


def shared_terms(scored: DataFrame) -> DataFrame:
    """lang, source, item, value: what terms that both have add to f summed as if each lacked the other's terms."""

    def f(p, q):
        return (p - q) * (p - q) // q

    def sums(t: pa.Table):
        lang, term, source = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        langs, sources = lang.dictionary, source.dictionary
        key = np.asarray(lang.indices).astype(np.int64)
        group = key * len(sources) + np.asarray(source.indices)
        key = key * len(term.dictionary) + np.asarray(term.indices)
        p, zero = (t.column(c).to_numpy() for c in ("p", "zero"))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        start, many = np.repeat(first, size), np.repeat(size, size)
        ends = np.cumsum(many)
        lo = 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            k = many[lo:hi]
            i = np.repeat(np.arange(lo, hi), k)
            j = np.repeat(start[lo:hi] - (np.cumsum(k) - k), k) + np.arange(len(i))
            i, j = i[i != j], j[i != j]
            value = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
            pairs, at = np.unique(np.stack([group[i], group[j]]), axis=1, return_inverse=True)
            out = np.zeros(pairs.shape[1], np.int64)
            np.add.at(out, at.ravel(), value)
            a, b = pairs
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(a // len(sources))), sources.take(pa.array(a % len(sources))), sources.take(pa.array(b % len(sources))), pa.array(out)], names=[*GROUP, "item", "value"])
            lo = hi

    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            t = pa.Table.from_batches([b]) if b is not None else None
            t = held if t is None else pa.concat_tables([held, t]) if held is not None else t
            if t is None or not t.num_rows:
                continue
            cut = t.num_rows
            if b is not None:  # the last term may go on in the next batch
                lang, term = t.column("lang").to_pylist(), t.column("term").to_pylist()
                while cut and (lang[cut - 1], term[cut - 1]) == (lang[-1], term[-1]):
                    cut -= 1
            if cut:
                yield from sums(t.slice(0, cut))
            held = t.slice(cut)
        release_memory()

    several = scored.repartition("lang", "term").sortWithinPartitions("lang", "term").select(*GROUP, "term", "p", "zero")
    return several.mapInArrow(run, "lang string, source string, item string, value long")


def source_pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: f summed over all kept terms for each two sources of a language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("terms").alias("other_terms"))
    other = written(other, "divergence-others")
    neither = met(groups, other, ["lang"], ["source"]).filter("source <> item")
    neither = neither.select(*GROUP, "item", F.coalesce(divergence("zero", "other_zero") * (F.col("kept") - F.col("terms") - F.col("other_terms")), F.lit(0)).alias("value"))
    counts = scored.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("n"))
    counts = met(counts, other, ["lang"], ["source", "p"]).filter("source <> item")
    ways = [F.struct("source", "item", (F.col("n") * divergence("p", "other_zero")).alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * divergence("other_zero", "p")).alias("value"))]
    one = counts.select("lang", F.inline(F.array(*ways)))
    parts = neither.unionByName(one).unionByName(shared_terms(scored))
    return parts.groupBy(*GROUP, "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the other sources (part pair) and its leading terms (part term).

    Null texts, languages and sources count as empty strings. A language without terms that enough of its documents have gives
    pairs of value 0 and no terms. Repeated rows count as often as they are there; ties are ranked by the bytes of the item.
    A text is one row of one task, however long it is. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("content"))
    kept = written(postings(texts, least_docs), "divergence-postings")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("lead").cast("long")).alias("kept"))
    own = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = texts.select(*GROUP).distinct().join(own, GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total", "kept"])
    groups = written(groups.withColumn("zero", F.when(F.col("kept") > 0, probability("0L", "total", "kept"))), "divergence-groups")
    scored = met(kept, groups, GROUP, ["term"])
    scored = written(scored.select(*GROUP, "term", "n", "zero", probability("n", "total", "kept").alias("p"), probability("lang_n", "lang_total", "kept").alias("q")), "divergence-scored")
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = source_pairs(scored, groups).withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    terms = leading_terms(scored, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select(*GROUP, "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT r, lang, source, unnest(ws) AS term FROM texts),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM texts) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT k.lang, t.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
  FROM kept k JOIN langs USING (lang) JOIN totals t ON t.lang = k.lang LEFT JOIN counts x ON x.lang = k.lang AND x.source = t.source AND x.term = k.term),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(n) + any_value(v)) AS q FROM counts JOIN langs USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM totals GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM dense JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
"""
