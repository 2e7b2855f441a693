"""Release rules against a line-by-line version, and fixtures against JSON."""

import json
import random

import pytest

from assaykit.operators.release import Phrase, parse_findings, phrase_findings
from assaykit.sources.fixtures import Unreadable, fixtures, tree

RULES = [Phrase("STALE", "old-name", name=True), Phrase("STALE", "Approval", fold=True), Phrase("NEEDED", "claimed_by", required=True), Phrase("NEEDED", "no edge", required=True, fold=True), Phrase("STALE", "va"), Phrase("EXACT", "Approval")]


def test_phrases(spark):
    texts = {
        ("r", "a.md"): "old-name here\n/old-name $old-name\nmy old-name, old-names\nAPPROVAL approval\nİ approval",
        ("r", "b.md"): "claimed_by\n\nApproval val",
        ("q", "c.md"): None,
        ("q", "d.md"): "No Edge x\n éold-name old-nameé old-name",
    }
    files = spark.createDataFrame([(r, p, t) for (r, p), t in texts.items()], "release string, path string, text string")
    got = {(r.release, r.path, r.line, r.code, r.phrase) for r in phrase_findings(files, RULES).collect()}
    assert got == {
        ("r", "a.md", 1, "STALE", "old-name"),
        ("r", "a.md", 3, "STALE", "old-name"),
        ("r", "a.md", 4, "STALE", "Approval"),
        ("r", "a.md", 5, "STALE", "Approval"),
        ("r", "a.md", 4, "STALE", "va"),
        ("r", "a.md", 5, "STALE", "va"),
        ("r", "b.md", 3, "STALE", "Approval"),
        ("r", "b.md", 3, "EXACT", "Approval"),
        ("r", "b.md", 3, "STALE", "va"),
        ("r", None, None, "NEEDED", "no edge"),
        ("q", "d.md", 2, "STALE", "old-name"),
        ("q", None, None, "NEEDED", "claimed_by"),
    }
    assert phrase_findings(files.where("false"), RULES).count() == 0
    jsons = spark.createDataFrame([("r", "a.json", "{"), ("r", "b.json", "[1]"), ("r", "c.json", None), ("r", "d.md", "{")], files.schema)
    assert {r.path for r in parse_findings(jsons).collect()} == {"a.json", "c.json"}


def dumped(rnd, value, indent=0):
    """A value in block form, as lines; what is empty or a scalar stands behind its key."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        for k, v in value.items():
            inner = rnd.choice([1, 2, 4]) + indent
            if isinstance(v, list) and v and rnd.random() < 0.5:
                inner = indent  # entries may stand below their key
            yield from entry(rnd, pad + json.dumps(k) + ":", v, inner)
    elif isinstance(value, list) and value:
        for v in value:
            lines = list(dumped(rnd, v, 0)) if isinstance(v, (dict, list)) and v else None
            if lines:
                yield pad + "- " + lines[0]
                yield from (pad + "  " + x for x in lines[1:])
            else:
                yield pad + "- " + json.dumps(v)
    else:
        yield pad + json.dumps(value)


def entry(rnd, head, v, inner):
    if isinstance(v, (dict, list)) and v and rnd.random() < 0.8:
        yield head + rnd.choice(["", "  # a note"])
        yield from dumped(rnd, v, inner)
    else:
        yield head + " " + json.dumps(v)  # scalars and flow values
    if rnd.random() < 0.1:
        yield ""


def random_tree(rnd, depth=0):
    kind = rnd.randrange(3) if depth < 4 else 2
    if kind == 2:
        return rnd.choice([None, True, 0, -3, 1.5, "", "a: b", "x # y", 'q"\\', "- z", "ü", "1", "null", [], {}])
    n = rnd.randint(1, 3)
    return [random_tree(rnd, depth + 1) for _ in range(n)] if kind else {f"k{i}": random_tree(rnd, depth + 1) for i in range(n)}


def test_fixtures_are_what_json_says(spark):
    rnd = random.Random(9)
    values = [random_tree(rnd) for _ in range(300)]
    rows = [(i, "\n".join(dumped(rnd, v)), json.dumps(v)) for i, v in enumerate(values)]
    got = fixtures(spark.createDataFrame(rows, "id int, text string, want string")).selectExpr("id", "to_json(record) AS got", "to_json(parse_json(want)) AS want", "error").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.error is None and r.got == r.want, rows[r.id][1]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("", None),
        ("# only\n\n", None),
        ("---\na: 1", {"a": 1}),
        ("a: b c # d\nb: 'it''s'\nc: \"x\\n\"\nd: ~\ne: True\nf: 1e3\ng: 01\nh: http://x/y#z", {"a": "b c", "b": "it's", "c": "x\n", "d": None, "e": True, "f": 1000.0, "g": "01", "h": "http://x/y#z"}),
        ("a: |\n  x\n\n   y\nb: >-\n  p\n  q\n\n  r\nc: |-\n", {"a": "x\n\n y\n", "b": "p q\nr", "c": ""}),
        ("a: [1, 'b, c', [d], {e: f}]\nb: {}\nc: []", {"a": [1, "b, c", ["d"], {"e": "f"}], "b": {}, "c": []}),
        ("a:\n- b: 1\n  c: 2\n- d:\n    e: 3\nf: -1", {"a": [{"b": 1, "c": 2}, {"d": {"e": 3}}], "f": -1}),
        ("- - 1\n  - 2\n-\n  - 3\n- x", [[1, 2], [3], "x"]),
        ("a:\n  b:\nc: d", {"a": {"b": None}, "c": "d"}),
        ("just words", "just words"),
    ],
)
def test_fixture_forms(text, value):
    assert tree(text) == value


@pytest.mark.parametrize("text", ["a: &x 1", "a: 1\n- b", "a: [1", "a: 1\na: 2", "a: 1\n  b: 2", "a\nb", "\ta: 1", "a: 'x"])
def test_texts_that_are_not_taken(text):
    with pytest.raises((Unreadable, ValueError)):
        tree(text)


def test_fixture_errors_are_rows(spark):
    rows = [(1, None), (2, " \n"), (3, "a: [1"), (4, "a: 1")]
    got = fixtures(spark.createDataFrame(rows, "id int, text string")).selectExpr("id", "to_json(record) AS r", "error").collect()
    assert {(r.id, r.r, r.error) for r in got} == {(1, None, "fixture-absent"), (2, None, "fixture-absent"), (3, None, "fixture-unreadable"), (4, '{"a":1}', None)}
