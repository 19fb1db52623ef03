import corpus_pipeline as cp
from featloom.llm.shared import rewritten


def test_stages_and_their_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, out = {}, docs
    for name, stage in cp.STAGES:
        before = out
        out = rewritten(stage(spark, out, sf_dir), "test")
        counts[name] = out.count()
        if name != "tokens":
            assert out.columns == docs.columns and out.distinct().join(before, "doc_id", "left_anti").count() == 0
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    assert docs.count() > counts["quality"] > counts["near_dedup"] >= counts["decontaminate"] > 0
    assert counts["mix"] == counts["tokens"]


def test_empty_documents(spark, sf_dir):
    out = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = rewritten(stage(spark, out, sf_dir), "test")
    assert out.count() == 0
