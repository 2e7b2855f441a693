"""Canonical JSON is written within a value's row."""

from pyspark.sql import functions as F

from assaykit.functions.canonical import canonical


def test_nothing_is_shuffled_and_depth_is_free(spark):
    deep = "[" * 400 + "15e-1" + "]" * 400
    rows = [(1, deep), (2, '{"b":1.0,"a":[12345678901234567890,1e-7,"\\u001f"]}'), (3, "null"), (4, None)]
    got = canonical(spark.createDataFrame(rows, "id int, t string").select("id", F.try_parse_json("t").alias("v")), "v")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {1: deep.replace("15e-1", "1.5"), 2: '{"a":[12345678901234567000,1e-7,"\\u001F"],"b":1}', 3: "null", 4: None}
    assert {r.id: r.canonical for r in got.collect()} == want
