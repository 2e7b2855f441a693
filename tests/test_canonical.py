"""Canonical JSON of any depth against a recursive version."""

import json
import random

from pyspark.sql import functions as F

from assaykit.functions.canonical import canonical, number_text

#: Doubles and what JavaScript writes for them.
NUMBERS = {0.0: "0", -0.0: "0", 1.0: "1", -2.5: "-2.5", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1e-7: "1e-7", 1.25e-9: "1.25e-9", 0.1: "0.1", 12345678.9: "12345678.9", 1.7976931348623157e308: "1.7976931348623157e+308", 100.0: "100", -1234.0: "-1234"}


def brute(value):
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + brute(value[k]) for k in sorted(value, key=str.encode)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(brute, value)) + "]"
    if isinstance(value, float):
        return NUMBERS[value]
    return json.dumps(value, ensure_ascii=False)


def random_value(rnd, depth=0):
    kind = rnd.randrange(4 if depth > 5 else 7)
    if kind > 3:
        n = rnd.randrange(4)
        return [random_value(rnd, depth + 1) for _ in range(n)] if kind == 4 else {rnd.choice(["a", "b", 'q"', "é", "漢", ""]) + str(i % 3): random_value(rnd, depth + 1) for i in range(n)}
    return [None, rnd.choice([True, False]), rnd.choice(["", "x\n\"y\\", "ü/"]), rnd.choice(list(NUMBERS))][kind]


def shuffled(rnd, value):
    if isinstance(value, dict):
        keys = list(value)
        rnd.shuffle(keys)
        return {k: shuffled(rnd, value[k]) for k in keys}
    return [shuffled(rnd, v) for v in value] if isinstance(value, list) else value


def test_numbers_are_written_as_in_javascript(spark):
    got = spark.createDataFrame([(float(x),) for x in NUMBERS], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == NUMBERS
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),)], "x double").select(number_text(F.col("x")).alias("t"))
    assert [r.t for r in odd.collect()] == ['"Infinity"', '"-Infinity"', '"NaN"']


def test_equal_values_have_one_text(spark):
    rnd = random.Random(2)
    values = [random_value(rnd) for _ in range(60)] + [{}, [], [[]], {"a": {}}, {"a": [{"b": [1.0, {"c": None}]}]}, None, "s"]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(i, json.dumps(shuffled(rnd, v), indent=1)) for i, v in enumerate(values)] + [(-1, "{broken"), (-1, None)]
    frame = spark.createDataFrame(rows, "id int, value string").withColumn("v", F.try_parse_json("value"))
    got = canonical(frame, "v").collect()
    assert len(got) == len(rows) and {(r.id, r.canonical) for r in got} == {(i, brute(v)) for i, v in enumerate(values)} | {(-1, None)}
    assert canonical(frame.where("id > 10000"), "v").count() == 0
