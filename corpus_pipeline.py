"""The corpus pipeline: stages that hand their documents on as Parquet.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes and rereads it as the next stage's docs.
Stages decide row by row: ids may be null or repeat, with the same text or another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import joined_numbers, keyed, small_batches, table, written
from oscillar.llm.decontamination import decontaminate
from oscillar.llm.jaccard_join import jaccard_join
from oscillar.llm.mixing import mix_documents
from oscillar.llm.token_output import token_output
from oscillar.llm.toxicity import score_texts, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near duplicates: shingles of five words at a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of the table.

    Rows are judged by their text alone: null and empty texts are clean, equal texts go or stay together, whatever their ids.
    """
    small_batches(spark)
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    verdicts = score_texts(docs, model, keep=COLUMNS)
    return verdicts.filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one of the smallest id stays (a null id is the largest); repeated rows are linked too.

    Of rows that share the smallest id the first in the files stays. Rows without words are linked with nothing and stay.
    """
    small_batches(spark)
    rows = keyed(docs)
    found = jaccard_join(rows, id_col="row", percent=PERCENT, words=WORDS, count_links=False)
    found = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go, each judged by its own text; null and empty texts stay."""
    small_batches(spark)
    rows = keyed(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="row")
    return joined_numbers(rows, found.filter("contaminated").select(F.col("doc_id").alias("row")), "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix on whole documents: each is dropped, kept or repeated to its source's target, and all are sorted by position.

    The files follow each other by position; copies of a document lie side by side. Rows without words are left out, as the mix
    takes none of theirs; a null source is a source of its own, and rows may lack or repeat ids.
    """
    rows = keyed(docs)
    sorted_rows = rows.join(mix_documents(rows), "row").orderBy("position", "row")
    return sorted_rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left, in files, in the order of the mix; a row for each document as read from them.

    Copies of a document are encoded each; ids may be null or repeat. A null text is its end id alone.
    """
    import public_tokenizers

    small_batches(spark)
    rows = keyed(docs)
    out = token_output(rows, public_tokenizers.path("word_bpe_49k.json"), id_col="row").withColumnRenamed("doc_id", "row")
    return out.join(rows.select("row", "doc_id"), "row").select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", tokens)]
#: A classifier and tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
