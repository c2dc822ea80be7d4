"""The pipeline as a whole, and each stage on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from brute import SF
from newsflow.llm import op3_decontamination, op6_neardup, op7_quality
from newsflow.llm.tables import read


def test_stages(spark):
    docs = read(spark, SF, "documents").cache()
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = state
        state = stage(spark, before, SF).cache()
        assert state.columns == docs.columns, name
        assert state.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        kept = {r.doc_id for r in state.select("doc_id").collect()}
        if name == "quality rules":
            want = {r.doc_id for r in op7_quality.quality(before).where("kept").collect()}
        elif name == "MinHash near-dedup":
            want = {r.doc_id for r in op6_neardup.classes(before).where("first").collect()}
        elif name == "benchmark decontamination":
            got = op3_decontamination.decontaminate(before, read(spark, SF, "benchmark"))
            want = {r.doc_id for r in got.where("not contaminated").collect()}
        else:
            want = {r.doc_id for r in before.select("doc_id").collect()}
        assert kept == want, name
    packed = corpus_pipeline.STAGES[-1][1](spark, state, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    # where pieces are cut depends on how the rows are dealt out, what is packed does not
    total = [(r.doc_id, r.doc_tokens, r.n) for r in packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).orderBy("doc_id").collect()]
    again = corpus_pipeline.run(spark, SF).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).orderBy("doc_id")
    assert all(tokens == n for _, tokens, n in total) and [tuple(r) for r in again.collect()] == total


def test_stages_take_an_empty_table(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
