"""The stages on the smallest table, each checked against its operator's brute force where it has one."""

import corpus_pipeline
from rasterloom.llm import decontaminate, neardup
from rasterloom.llm.scratch import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    everything = sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())
    assert kept["language_id"] == everything
    groups = neardup.near_duplicates(spark, table(spark, SF, "documents"))
    assert kept["near_dedup"] == sorted(r.doc_id for r in groups.where("kept").collect())
    leaks = {r.doc_id for r in decontaminate.contaminations(spark, table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    assert kept["decontamination"] == [d for d in kept["near_dedup"] if d not in leaks]
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and kept["sharding"] == kept["mixing"]


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
