"""Handoff sections, bullets and meta blocks are told within a text's row, and text work is dealt over tasks."""

from assaykit.operators import handoff, lint
from assaykit.plans.views import view

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_sections_join_and_shuffle_nothing(spark):
    named = [x for s in lint.SECTIONS for x in (f"## {s}", "one two three")]
    swapped = [*named[2:4], *named[:2], *named[4:]]
    empty = [*named[:-1], "<one two three>"]
    x = docs(spark, "\n".join(named), "\n".join(swapped), "\n".join([*empty, "## " + lint.SECTIONS[0]]), None)
    got = lint.section_findings(x)
    assert not any(w in plan(got) for w in ("Exchange", "Join"))
    rows = {(r.doc_id, r.code, r.section) for r in got.collect()}
    assert rows == {(1, "sections-out-of-order", ""), (2, "section-empty", lint.SECTIONS[-1]), (2, "section-repeated", lint.SECTIONS[0])} | {(3, "section-missing", s) for s in lint.SECTIONS}


def test_the_view_of_handoffs_is_dealt_over_tasks(spark):
    assert view(spark, SF, "handoff_text").rdd.getNumPartitions() >= 8


def test_lines_begin_behind_every_end_of_line(spark):
    x = docs(spark, "plain\x0cSYSTEM: wait\x0bsee <x>\x1c<y>", "well\x0cfix it", None)
    assert {tuple(r) for r in lint.line_findings(x).collect()} == {(0, "directive-2", 2), (0, "placeholder", 4)}
    assert [(r.doc_id, r.line) for r in lint.prompt_findings(x).where("rule = 'VAGUE'").collect()] == [(1, 2)]


def test_bullets_go_on_over_repeated_sections_without_a_shuffle(spark):
    got = lint.folded_bullets(docs(spark, "- none\n## Verification\nlead\n- one\n  more\nplain\n## x\n- no\n## Verification\n  last\n- two", None), "Verification")
    assert "Exchange" not in plan(got) and {tuple(r) for r in got.collect()} == {(0, 4, "- one more last"), (0, 11, "- two")}


def test_content_is_told_without_a_shuffle(spark):
    text = "## Current state\n**In flight**\nwords\n## Next action\nthink\n## Locked decisions and constraints\n- LOCKED: a\n- b"
    got = handoff.content_findings(docs(spark, text, None))
    assert "Exchange" not in plan(got)
    rows = [(r.code, r.place) for r in got.collect()]
    assert rows == [("subgroup-missing", "**Done and verified**"), ("subgroup-missing", "**Done, unverified**"), ("subgroup-empty", "**Done and verified**"), ("action-without-anchor", ""), ("decision-without-kind", "8")]


def test_lines_are_made_once(spark):
    assert plan(lint.line_budget(docs(spark, "a\nb"))).count("split(") == 1


def test_values_of_the_meta_block_are_found_once(spark):
    text = "x\n ```yaml \n written: soon\nroot: a\nroot: /b\ncwd: <c>\nfocus: f\n``` \nhead: h"
    got = handoff.meta_findings(docs(spark, text, None))
    assert {(r.doc_id, r.code, r.key) for r in got.collect()} == {(1, "meta-absent", ""), (0, "meta-duplicate", "root"), (0, "meta-placeholder", "cwd"), (0, "meta-path", "cwd"), (0, "meta-written", "written"), *((0, "meta-missing", k) for k in ("branch", "head", "dirty"))}
    assert plan(got).count("= written)") <= 2
