"""Filter interaction audit: a histogram of failure masks for each part, from which every order of the filters is told.

DataFrame functions only. A row is read once and leaves a mask, one bit for each filter it fails by its own text; the bit of
the duplicates comes from the smallest id of each text. Masks are counted for each part, and all figures of all orders follow
from those few cells. Texts are grouped by their SHA-256, so that no text is shuffled.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import join_counted, table, written

#: what fails a filter, over content (the text) and words (its words).
FILTERS = {
    "A": "size(words) < 50",
    "B": "100L * size(array_distinct(words)) < 65L * size(words)",
    "C": "100L * regexp_count(content, '[A-Z]') > 5L * char_length(content)",
    "D": "content RLIKE '[#$%&*|]'",
}
#: the filter that a text fails which a smaller id has, too.
COPIES = "E"
SPACES = r"[\x20\x09-\x0D]+"


def filter_orders(letters: str) -> Column:
    """An array of one struct for each order of the filters and each step of it, with the bits of the step's and of all earlier filters."""
    bits = {x: 1 << k for k, x in enumerate(letters)}
    rows = [
        {"filter_order": "".join(order), "step": k + 1, "own": bits[x], "before": sum(bits[y] for y in order[:k])}
        for order in itertools.permutations(letters) for k, x in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,own:int,before:int>>")


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, filters: dict[str, str], copies: str) -> DataFrame:
    """part, mask, n, good, toxic: how many rows of a part fail just the filters of the mask, and how many of those are labelled so."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    texts = texts.withColumn("words", F.array_remove(F.split("content", SPACES), ""))
    mask = sum((F.when(F.expr(fails), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    marks = written(texts.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("content", 256)).alias("sha")), "audit-marks")
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(c)
    flags = labels.groupBy("doc_id").agg(flag("quality"), flag("toxic")).filter("quality + toxic > 0")
    live = written(marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(flags, "doc_id"), "audit-labels")
    groups = marks.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    later = written(join_counted(marks, written(groups, "audit-groups"), ["sha"]).filter("doc_id > first").select("doc_id", "part", "mask"), "audit-later")

    def measures(rows: DataFrame, mask: Column, sign: int) -> list[DataFrame]:
        zero = F.lit(0).cast("long")
        counted = rows.select("part", mask.alias("mask"), F.lit(sign).cast("long").alias("n"), zero.alias("good"), zero.alias("toxic"))
        labelled = join_counted(rows.select("doc_id", "part", mask.alias("mask")), live, ["doc_id"])
        return [counted, labelled.select("part", "mask", zero.alias("n"), (sign * F.col("quality")).alias("good"), (sign * F.col("toxic")).alias("toxic"))]

    # a later copy leaves the cell of its own failures for that with the bit of the copies
    mask, bit = F.col("mask"), 1 << len(filters)
    moves = [*measures(marks, mask, 1), *measures(later, mask, -1), *measures(later, mask.bitwiseOR(F.lit(bit)), 1)] if copies else measures(marks, mask, 1)
    every = moves[0]
    for one in moves[1:]:
        every = every.unionAll(one)
    return every.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict[str, str] = FILTERS, copies: str = COPIES
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the filters.

    filters: letter → SQL condition over content and words that a failing row meets; copies: the letter of the filter for later
    copies of a text ("" for none), which looks at the whole table, removed rows included. There are k! orders of k filters, so
    k should be 6 at most.

    A null text is empty, a null part the empty string. A row without an id is no later copy and has no labels; rows that share
    id and text are no later copies of each other. An id with several rows in labels has what any of them says; null labels
    say nothing. A text is one row of one task, however long it is. An empty table gives no rows, empty labels none lost. Other
    columns are ignored, whatever their names.
    """
    letters = "".join(filters) + copies
    if len(set(letters)) != len(letters):
        raise ValueError("each filter needs a letter of its own")
    cells = mask_cells(docs, labels, id_col, text_col, part_col, filters, copies)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # a part has 2^k cells
    rows = parts.select("part", "cells", F.inline(filter_orders(letters)))

    def total(field: str, where: str) -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (s, c) -> s + {field})")

    fails, here = "(c.mask & own) <> 0", "(c.mask & own) <> 0 AND (c.mask & before) = 0"
    figures = {
        "kept": total("c.n", "(c.mask & (own | before)) = 0"),
        "removed": total("c.n", here),
        "redundant": total("c.n", f"{fails} AND (c.mask & before) <> 0"),
        "unique_fails": total("c.n", "c.mask = own"),
        "good_lost": total("c.good", here),
        "toxic_lost": total("c.toxic", here),
        # of all orders, the filter stands before the others of a mask in one of as many as the mask has bits
        "shapley": total(f"c.n * ({math.factorial(len(letters))}L div bit_count(c.mask))", fails),
    }
    return rows.select("part", "filter_order", "step", *(c.alias(name) for name, c in figures.items()))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
marks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM texts x LEFT JOIN flags USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT o, step, (instr(o, 'A') = step)::INT + 2 * (instr(o, 'B') = step)::INT + 4 * (instr(o, 'C') = step)::INT + 8 * (instr(o, 'D') = step)::INT + 16 * (instr(o, 'E') = step)::INT AS own,
    (instr(o, 'A') < step)::INT + 2 * (instr(o, 'B') < step)::INT + 4 * (instr(o, 'C') < step)::INT + 8 * (instr(o, 'D') < step)::INT + 16 * (instr(o, 'E') < step)::INT AS earlier
  FROM orders, range(1, 6) AS r(step)),
figures AS (
  SELECT part, o, step, own, coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
"""
