"""Set-similarity joins against all pairs, and how few pairs they look at."""

import random

from pyspark.sql import functions as F

from assaykit.functions.scalars import token_set
from assaykit.operators import similar


def similarity(a, b):
    both = len(a & b)
    return max(both / len(a | b), both / min(len(a), len(b))) if a and b else 0


def titles(n=120):
    rnd = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    return [(i % 3, i, " ".join(rnd.choices(words, weights=[60 / (k + 1) for k in range(60)], k=rnd.randint(1, 9)))) for i in range(n)] + [(0, n, None), (0, n + 1, ""), (1, n + 2, "the of")]


def test_pairs_equal_all_pairs(spark):
    rows = titles()
    frame = spark.createDataFrame(rows, "g int, k int, txt string")
    sets = {(r.g, r.k): set(r.t or []) for r in frame.select("g", "k", token_set(frame.txt).alias("t")).collect()}
    for threshold in (0.6, 0.34, 1.0):
        got = {(r.g, r.a, r.b, r.similarity) for r in similar.similar_pairs(frame, "g", "k", "txt", threshold).collect()}
        want = {(g, a, b, round(similarity(sets[g, a], sets[g, b]), 6)) for (g, a) in sets for (h, b) in sets if g == h and a < b and similarity(sets[g, a], sets[g, b]) >= threshold}
        assert got == want and got


def test_passages_equal_all_pairs(spark):
    docs = spark.createDataFrame([(i, t) for _, i, t in titles()], "doc_id long, text string")
    passages = spark.createDataFrame([(i, t) for _, i, t in titles(30) if t], "item_id int, text string")
    d = {r.doc_id: set(r.t) for r in docs.selectExpr("doc_id", "coalesce(text, '') AS text").select("doc_id", token_set(F.col("text")).alias("t")).collect() if r.t}
    p = {r.item_id: set(r.t) for r in passages.select("item_id", token_set(passages.text).alias("t")).collect() if r.t}
    got = {tuple(r) for r in similar.contained_passages(docs, passages).collect()}
    assert got == {(i, j, round(similarity(a, b), 6)) for i, a in d.items() for j, b in p.items() if similarity(a, b) >= 0.6}


def test_a_common_token_brings_few_pairs_together(spark):
    rows = [(0, i, f"common shared everywhere first{i} second{i} third{i} fourth{i % 50} fifth{i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "g int, k int, txt string")
    sets = similar._ordered(similar._token_sets(frame, frame.txt, frame.g, frame.k), "g")
    met = similar.candidates(sets, sets, 0.6, "n_s < n_l OR n_s = n_l AND row_s < row_l", "g")
    assert met.count() <= 2_000  # of 79,800


def test_only_short_documents_are_ordered(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i + k}" for k in range(40))) for i in range(50)] + [(50, "w1 w2"), (51, "w1 w90")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "w1 w2 w3 w4 w5")], "item_id int, text string")
    ordered, sets = [], similar._ordered
    monkeypatch.setattr(similar, "_ordered", lambda x, *a, **k: ordered.append(x) or sets(x, *a, **k))
    got = {tuple(r) for r in similar.contained_passages(docs, passages).collect()}
    assert got == {(0, 7, 1.0), (1, 7, 1.0), (2, 7, 0.8), (3, 7, 0.6), (50, 7, 1.0)}
    assert sum(x.count() for x in ordered) == 4  # the passage twice, two documents once
