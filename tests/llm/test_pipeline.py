from __future__ import annotations

import corpus_pipeline as pipeline
from granary.llm.common import materialize


def test_stages_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept, at = docs.columns, {}, {}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), f"test-{name}")
        at[name], kept[name] = docs, {r[0] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
    assert kept["line_dedup"] <= kept["quality_classifier"] <= kept["quality_rules"]
    texts = {r["doc_id"]: r["text"] for r in at["quality_classifier"].collect()}
    assert all(texts[i] in {texts[k] for k in kept["line_dedup"]} for i in kept["quality_classifier"] - kept["line_dedup"])
    assert at["line_dedup"].where("trim(text) = ''").count() == 0
    assert kept["packing"] == kept["near_dedup"] < kept["line_dedup"]
    good = {r[0] for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id").collect()}
    assert len(good & kept["quality_classifier"]) == len(good & kept["quality_rules"])
    assert at["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    for name, df in (("odd", odd), ("none", nothing)):
        folder = f"file://{tmp_path}/{name}"
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (6, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = pipeline.run(spark, folder)
        assert "sequence_id" in out.columns and out.count() >= 0
