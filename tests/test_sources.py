from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerops.session import scratch_path
from ledgerops.sources import files
from ledgerops.sources.swap import rollback_swap, swap_tables
from tests.conftest import rows


def test_landed_json_keeps_broken_lines(spark):
    path = scratch_path(spark, "t-json")
    lines = [
        '{"number":"0x10","hash":"0xAA","miner":"0xABC","timestamp":"0x0"}', "{broken",
        '{"number":"0xffffffffffffffffff","hash":null,"miner":null,"timestamp":null}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = files.read_landed_json(spark, path, files.BLOCK_PAYLOAD).cache()
    good = got.where("hash = '0xAA'").first()
    assert int(good["number"]) == 16 and good["miner"] == "0xabc" and good["_corrupt_record"] is None
    assert got.where("_corrupt_record = '{broken'").count() == 1
    assert got.where("number > 1000").count() == 1  # nine bytes still fit


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_export_import(spark, fmt):
    df = spark.createDataFrame([(1, "a,b", datetime(2024, 1, 1, 1, 2, 3, 4)), (2, None, None)], "id int, s string, t timestamp_ntz")
    target = scratch_path(spark, "t-target")
    df.write.parquet(target)
    out = files.export_rows(df.where("id = 1"), scratch_path(spark, "t-export"), fmt)
    files.import_rows(spark, out, target, df.schema, fmt)
    assert rows(spark.read.parquet(target)) == rows(df.unionByName(df.where("id = 1")))


def test_swap_and_back(spark):
    for name, n in (("t_live", 1), ("t_staged", 2), ("t_live2", 3)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.range(n).write.option("path", scratch_path(spark, name)).saveAsTable(name)
    with pytest.raises(ValueError):  # checks come before the first rename
        swap_tables(spark, {"t_live": "t_staged", "t_live2": "t_missing"})
    assert spark.table("t_live").count() == 1
    swap_tables(spark, {"t_live": "t_staged"})
    assert spark.table("t_live").count() == 2 and spark.table("t_live_old").count() == 1
    rollback_swap(spark, {"t_live": "t_staged"})
    assert spark.table("t_live").count() == 1 and spark.table("t_staged").count() == 2
    for name in ("t_live", "t_staged", "t_live2"):
        spark.sql(f"DROP TABLE {name}")


def test_samples_and_unions(spark):
    df = spark.createDataFrame([("public", "logs", 5, 0.5)], "s string, t string, n bigint, r double")
    out = files.to_samples(df, "q", ["s", "t"], ["n", "r"], "2024-01-01").collect()
    assert sorted((r["metric"], r["value"], tuple(sorted(r["labels"].items()))) for r in out) == [
        ("q_n", 5.0, (("s", "public"), ("t", "logs"))), ("q_r", 0.5, (("s", "public"), ("t", "logs"))),
    ]
    assert files.to_samples(df, "q", [], ["n"], "2024-01-01").first()["labels"] == {}
    a, b = df.select("s"), df.select(F.col("n").alias("m"))
    both = files.union_sources({"a": a, "b": b}, {"cluster": "x"})
    assert rows(both.select("s", "m", "source", "cluster")) == [("public", None, "a", "x"), (None, 5, "b", "x")]
    s = spark.createDataFrame([({"cluster": "own"},), ({},)], "labels map<string,string>")
    got = [r["labels"] for r in files.with_external_labels(s, {"cluster": "x", "env": "p"}).collect()]
    assert got == [{"cluster": "own", "env": "p"}, {"cluster": "x", "env": "p"}]


def test_tiers(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 10),)], "at timestamp_ntz")
    assert [r["tier"] for r in files.tier_split(df, "at", "2024-01-31", 21).orderBy("at").collect()] == ["cold", "hot"]
