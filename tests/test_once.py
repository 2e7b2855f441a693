"""Patterns of rules that nobody asks for aren't tried, and front matter is read once a row."""

from pyspark.sql import functions as F

from assaykit.operators import lint
from assaykit.sources import fixtures, readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_asked_rules_are_tried(spark):
    docs = spark.createDataFrame([(1, "TODO sk-abcdefgh12"), (2, "a table")], "doc_id int, text string")
    got = lint.prompt_findings(docs, rules=["FORMAT"])
    assert [(r.doc_id, r.rule, r.line) for r in got.collect()] == [(1, "FORMAT", 0)]
    assert "AKIA" not in plan(got) and "AKIA" in plan(lint.prompt_findings(docs))


def test_front_matter_is_read_once(spark):
    text = "---\nid: 1\nid: 2 # two\nname: 'x'\n---\nbody"
    docs = spark.createDataFrame([(text,), ("---\nid\n---\n",), ("none",), (None,)], "text string").withColumn("k", F.monotonically_increasing_id())
    got = readers.frontmatter(docs)
    assert got.columns == ["text", "k", "fields", "body", "error"]
    assert sorted((str(r.fields and sorted(r.fields.items())), str(r.body), str(r.error)) for r in got.collect()) == sorted([("[('id', '2'), ('name', 'x')]", "body", "None"), ("None", "", "frontmatter-line"), ("None", "none", "frontmatter-missing"), ("None", "None", "None")])
    assert plan(got).count("regexp_extract(text") == 1


def test_fixtures_are_parsed_once_and_equal_lines_read_once(spark, monkeypatch):
    text = "a:\n" + "\n".join(f"  - n: [x, {k}, ]\n    same_of_once: 'it''s' # note" for k in range(20))
    read, uncommented = [], fixtures.uncommented
    monkeypatch.setattr(fixtures, "uncommented", lambda s: read.append(s) or uncommented(s))
    got = fixtures.tree(text)
    assert got == {"a": [{"n": ["x", k], "same_of_once": "it's"} for k in range(20)]} and sum("same_of_once" in s for s in read) == 1
    got["a"][0]["n"].append(1)
    assert fixtures.tree(text)["a"][0]["n"] == ["x", 0]  # what is remembered isn't handed out
    x = fixtures.fixtures(spark.createDataFrame([(text,), ("a: 1",), ("",), ("&x",)], "text string"))
    one = x.where("try_variant_get(record, '$.a', 'int') = 1").select(F.try_variant_get("record", "$.a", "int").alias("a"))
    assert one.collect()[0].a == 1 and plan(one).lower().replace("_", "").count("parsejson") == 1
    assert [r.error for r in x.where("record IS NULL").collect()] == ["fixture-absent", "fixture-unreadable"]
