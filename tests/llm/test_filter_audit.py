"""Filter audit against a brute-force version that applies every order row by row."""

import itertools
import re
from collections import defaultdict

import pytest

from tests.llm.fixtures import edge_rows, frame, last, multiset, random_rows


def brute_fails(rows):
    smallest = {}
    for r in rows:
        smallest[r[1] or ""] = min(last(r[0]), smallest.get(r[1] or "", 2**63 - 1))
    for r in rows:
        text = r[1] or ""
        w = text.encode().split()
        yield [
            len(w) < 200,
            100 * len(set(w)) < 50 * len(w),
            100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            smallest[text] < last(r[0]),
        ]


def brute_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = list(brute_fails(rows))
    out, shapley = {}, defaultdict(int)
    for part in {r[2] or "" for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            held = {i for i, r in enumerate(rows) if (r[2] or "") == part}
            everyone = set(held)
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                failing = {i for i in everyone if fails[i][k]}
                removed = failing & held
                redundant = failing - held
                held -= removed
                out[part, order, step] = [len(held), len(removed), len(redundant), sum(sum(fails[i]) == 1 for i in failing), sum(rows[i][0] in good for i in removed), sum(rows[i][0] in toxic for i in removed)]
                shapley[part, letter] += len(removed)
    return [(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()]


def cases():
    long = " ".join(f"w{i}" for i in range(250))
    shout = " ".join(f"W{i}" for i in range(250))
    more = [(100, long, "en", "s", 0), (100, long, "de", "s", 0), (100, long, "en", "s", 0), (101, long, "en", "s", 0), (102, shout, "en", "s", 0), (103, shout + " #", None, "s", 0), (104, long + " a|b", "", "s", 0)]
    more += [(None, long, "en", "s", 0), (None, long, "en", "s", 0), (105, "a " * 300, "en", "s", 0), (None, "only here", "en", "s", 0), (None, "only here", "en", "s", 0)]
    return edge_rows() + random_rows(40) + more


@pytest.mark.parametrize("rows", [[], edge_rows(), cases()], ids=["empty", "edge", "all"])
def test_filter_audit(spark, rows):
    from assaykit.llm.filter_audit import audit, mask_cells

    labels = [(r[0], i % 3 and 1, (i // 2) % 2) for i, r in enumerate(rows) if i % 4] + [(100, None, None), (101, 0, 1), (101, 1, None), (None, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality long, toxic long").repartition(3)
    got = audit(mask_cells(frame(spark, rows), told))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert multiset(tuple(r) for r in got.collect()) == multiset(brute_audit(rows, labels))
