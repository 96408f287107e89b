"""The pipeline's stages, one after the other, and its registration."""

import __spark_entry__ as entry
import corpus_pipeline
from ledgerops.llm import decontaminate, ngram_join, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).cache()
    assert out.columns == docs.columns and 0 < out.count()
    assert all(not secrets.spans_of(r["text"], rule) for r in out.collect() for rule in secrets.BASE)
    distinct = out.dropDuplicates(["doc_id"])
    assert ngram_join.jaccard_groups(distinct).where("n_links > 0").count() == 0
    assert decontaminate.clean(distinct, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == distinct.count()


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
