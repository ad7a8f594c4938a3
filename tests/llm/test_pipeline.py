"""The pipeline's stages on a small table: each keeps what it should by a brute-force reading of its input."""

import os
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def ids_of(texts):
    """(start, number, checksum) of the ids of texts that follow each other."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    from oscillar.llm import toxicity
    from oscillar.llm.common import keyed
    from tests.llm.test_operators import brute_links, contaminated

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        texts = [r["text"] for r in keyed(docs).orderBy("row").collect()]
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= set(before)
        ids = sorted(before)
        if name == "near_duplicates":
            found = brute_links([before[i] for i in ids], 5, 80)
            assert kept == {ids[c] for _, c, _ in found}
        elif name == "decontamination":
            found = contaminated([before[i] for i in ids], items)
            assert kept == {i for i, f in zip(ids, found) if not f[-1]}
        elif name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            verdict = {r["doc_id"]: r["predicted"] for r in toxicity.score_texts(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
            assert kept == {i for i in ids if not verdict[i]}
        elif name == "token_output":
            assert kept == set(before)
            assert sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in docs.collect()) == ids_of(texts)
        if name != "token_output":
            assert docs.columns == pipeline.COLUMNS


def test_mixing_carries_the_mix_out(spark, tmp_path):
    import corpus_pipeline as pipeline
    from oscillar.llm import mixing

    rows = [(k if k % 9 else None, " ".join([f"w{k}"] * (k * 7 % 40)), "en", "abcd"[min(k % 7, 3)] if k % 7 != 5 else None, k) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    out = str(tmp_path / "mixed")
    pipeline.mixing(spark, docs, None).write.parquet(out)
    got = [r for f in sorted((tmp_path / "mixed").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    words = {}
    for r in got:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert words.keys() == targets.keys()
    for source, n in words.items():
        assert abs(n - targets[source]) <= 20  # half of the longest document
    sizes = {s: sum(len(t.split()) for _, t, _, u, _ in rows if u == s) for s in targets}
    copies = {k: 0 for k in range(900)}
    for r in got:
        copies[r["n_chars"]] += 1
    for _, text, _, source, k in rows:
        ratio = targets[source] / sizes[source]
        assert copies[k] in ((int(ratio), int(ratio) + 1) if text else (0,))
    place = {r["n_chars"]: r["position"] for r in mixing.placed(docs, "doc_id", "text", "source", ["n_chars"]).collect()}
    order = [place[r["n_chars"]] for r in got]
    assert order == sorted(order)
    ids = [r["doc_id"] for r in pipeline.tokens(spark, spark.read.parquet(out), None).orderBy("start").collect()]
    assert ids == [r["doc_id"] for r in got]


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    benchmark = " ".join(f"item{k}" for k in range(14))
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    leak = f"{prose('x')} {benchmark} {prose('y')}"
    rows = [
        (None, prose("a")), (None, prose("b")), (None, prose("a")), (None, leak),  # without ids
        (7, prose("c")), (7, prose("c")), (7, prose("c")),  # repeated rows
        (8, prose("d")), (8, leak + " " + prose("z")), (8, prose("e")),  # one id, other texts
        (9, prose("b")), (3, prose("d") + " more"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        clean = pipeline.decontamination(spark, given, str(tmp_path)).collect()
        assert sorted(r["n_chars"] for r in clean) == [k for k, (_, t) in enumerate(rows) if benchmark not in t]
        kept = pipeline.near_duplicates(spark, given, str(tmp_path)).collect()
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("None", prose("a")), ("None", leak), ("7", prose("c")), ("8", rows[8][1]), ("8", prose("e")), ("9", prose("b")), ("3", rows[11][1])])
        mixed = pipeline.mixing(spark, given, str(tmp_path)).collect()
        words = sum(len(t.split()) for _, t in rows)
        assert abs(sum(len(r["text"].split()) for r in mixed) - words * 1.5) <= 70 and any(r["doc_id"] is None for r in mixed)
        assert sorted(str(r["doc_id"]) for r in pipeline.tokens(spark, given, str(tmp_path)).collect()) == sorted(str(i) for i, _ in rows)
    labels = spark.createDataFrame([(k, k // 8 % 2) for k in range(160)], "doc_id long, toxic int")
    taught = spark.createDataFrame([(k, prose("abcdexyz"[k % 8]) + f" more {benchmark}" + " idiot" * (k // 8 % 2)) for k in range(160)], "doc_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    taught.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["n_chars"] for r in pipeline.toxicity(spark, docs, str(tmp_path)).collect()} == set(range(len(rows)))


def test_stages_of_an_empty_table(spark):
    """No rows come of none, and all stages but the last keep the columns of documents."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "token_output" or out.columns == pipeline.COLUMNS)


def test_stages_pass_over_columns_that_are_not_theirs(spark):
    """A long text, a null one and extra columns with names of the operators' own go through the stages that judge single rows."""
    import corpus_pipeline as pipeline

    long = "word " * 200_000
    rows = [(1, long, "en", "a", 1, "x", 2), (2, None, "en", "a", 0, "y", 3), (3, "short one", None, None, 9, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, content string, at_ int")
    out = dict(pipeline.STAGES)["decontamination"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3] and out.columns == pipeline.COLUMNS
    mixed = dict(pipeline.STAGES)["mixing"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in mixed} <= {1, 3} and all(r["text"] in (long, "short one") for r in mixed)


def test_texts_cross_to_workers_in_small_batches(spark):
    import pyarrow as pa
    from oscillar.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        common.small_batches(spark)
        got = [r.n for r in spark.range(3000, numPartitions=1).selectExpr("repeat(CAST(id % 10 AS STRING), 5000) AS text").mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 15_000_000 and max(got) < common.BATCH_BYTES + 100_000
        spark.conf.set(name, "1000000")
        common.small_batches(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.set(name, before)
