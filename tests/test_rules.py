"""Rules with hand-made examples: link spellings, placeholders, tasks, and views that trip every rule."""

from assaykit.operators import handoff, lint, scores, skills
from assaykit.plans.views import view

SF = "/root/testdata/sf0.001"


def test_links_are_decoded_before_they_are_judged(spark):
    text = "[a](a%20b.md) [b](a+b.md) [c](100%.md) [d](%E9%zz.md) [e](x%5Cy.md) [f](%2E%2E/z.md) [g](a%20b.md%23part) [h](https%3A//x.y)"
    files = spark.createDataFrame([(1, "SKILL.md", text), (1, "a b.md", ""), (1, "100%.md", "")], "skill_id int, path string, text string")
    got = {(r.target, r.code) for r in skills.link_findings(files).collect()}
    assert got == {("a+b.md", "link.broken"), ("�%zz.md", "link.broken"), ("x\\y.md", "path.backslash"), ("x\\y.md", "link.broken"), ("../z.md", "path.escape")}


def test_placeholders_by_precedence(spark):
    lines = ["<path> and <todo>", "<todo> <a b c>", "<x>", "see <a b c>", "a < b", "<itemised>"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")
    assert {(r.line, r.code) for r in lint.line_findings(docs).collect()} == {(1, "template-placeholder"), (2, "inline-placeholder"), (3, "placeholder"), (4, "placeholder"), (6, "template-placeholder")}


def test_a_weight_over_the_budget_is_told_and_not_cut(spark):
    rows = [("p", "a", 9, ["b", "b", "x"]), ("p", " b ", 1, None), ("p", "b", 2, []), ("q", None, 3, ["b"]), ("q", "x", None, None)]
    tasks = spark.createDataFrame(rows, "plan string, id string, weight int, depends_on array<string>")
    got = {tuple(r) for r in scores.task_findings(tasks, "plan", 4).collect()}
    assert got == {("p", "a", "TASK_WEIGHT_EXCEEDS_BUDGET", "9"), ("p", "a", "TASK_DEPENDENCY_UNKNOWN", "x"), ("p", "b", "TASK_ID_DUPLICATE", "2"), ("q", "", "TASK_ID_INVALID", ""), ("q", "", "TASK_DEPENDENCY_UNKNOWN", "b")}
    full = tasks.selectExpr("*", "'' AS owner", "'' AS kind", "'' AS executor_class", "0 AS priority", "0 AS expected_ms", "array('r', 'r') AS resources", "-1 AS retries", "0 AS timeout_ms", "true AS retry_on_timeout")
    row = scores.normalized_tasks(full).where("id = 'a'").first()
    assert (row.weight, row.depends_on, row.resources, row.retries, row.timeout_ms, row.retry_on_timeout, row.allow_failed_dependencies) == (9, ["b", "x"], ["r"], 0, None, True, False)


def test_every_rule_and_kind_of_secret_has_rows(spark):
    texts = view(spark, SF, "prompt_text")
    rules = {r.rule: r["count"] for r in lint.prompt_findings(texts).groupBy("rule").count().collect()}
    assert set(rules) == {"CRED", "INJECT", "AGENTIC", "PERSIST", "COT", "VAGUE", "FORMAT", "STACK", "TODO"} and min(rules.values()) >= 5
    secrets = {r.secret: r["count"] for r in handoff.secret_lines(texts).groupBy("secret").count().collect()}
    assert set(secrets) == set(handoff.SECRETS) and min(secrets.values()) >= 5


def test_checks_of_counts_order_and_questions(spark):
    texts = ["1. Which NEXT step?\n2. Why?\nfirst then second", "second first", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    checks = [lint.Check("q", questions=(2, 2), not_asked=["next"]), lint.Check("o", "ORDER", order=("First", "second")), lint.Check("w", required=list("uvwxyza"), forbidden=["first"])]
    got = {(r.doc_id, r.check_id): (r.ok, r.code, r.evidence) for r in lint.check_runs(docs, checks).collect()}
    assert got[0, "q"] == (False, "EVIDENCE-INCOMPLETE", "Which NEXT step?") and got[1, "q"][2] == got[2, "q"][2] == "question count 0"
    assert got[0, "o"] == (True, "ORDER", "") and got[1, "o"][:2] == got[2, "o"][:2] == (False, "ORDER")
    assert got[0, "w"][2] == "missing: u|missing: v|missing: z|missing: a|present: first"
    assert got[2, "w"][2] == "missing: u|missing: v|missing: w|missing: x|missing: y|missing: z"


def test_receipts_of_queries_and_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from assaykit.streaming.receipts import Receipts, listening

    told = Receipts(spark, "r")
    x = told.watched(told.watched(spark.range(100), "made").where("id % 2 = 0"), "even", most=F.max("id"))
    with told.timed("even"):
        x.write.format("noop").mode("overwrite").save()
    rows = {r.stage: r for r in told.stages().collect()}
    assert (rows["made"].rows, rows["even"].rows) == (100, 50) and rows["even"].ended >= rows["even"].started > 0 and rows["made"].started is None
    assert dict(told.metrics())["even"]["most"] == 98
    times = {r.stage: r.elapsed for r in scores.stage_times(told.stages(), "run").collect()}
    assert times["even"] == rows["even"].ended - rows["even"].started

    spark.range(10).write.parquet(str(tmp_path / "in"))
    with listening(spark) as heard:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        query = stream.writeStream.queryName("heard").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    stages = heard.stages(spark).collect()
    assert sum(r.rows or 0 for r in stages if r.stage.startswith("batch-")) == 10
    assert {r.run for r in stages} == {"heard"} and any(r.stage == "addBatch" for r in stages)
    assert all(r.ended >= r.started for r in stages)


def test_front_matter_syntax_by_line(spark):
    texts = {1: "---\na: b\n\n# c\n nested\nno colon\nd: >-\n  held\n\n  held\n# ends it\n  nested\n---\nno colon", 2: "a: b", 3: "---\na: b", 4: "---\n---", 5: None}
    files = spark.createDataFrame([(i, "SKILL.md", t) for i, t in texts.items()] + [(6, "other.md", "x")], "skill_id int, path string, text string")
    got = {(r.skill_id, r.code.split(".")[1], r.line) for r in skills.syntax_findings(files).collect()}
    assert got == {(1, "nested", 5), (1, "syntax", 6), (1, "nested", 12), (2, "missing", 1), (3, "unclosed", 1), (5, "missing", 1)}


def test_reports_isolation_and_environments(spark):
    from pyspark.sql import functions as F

    from assaykit.operators import delta, health_rules

    frame = lambda rows: spark.createDataFrame(rows, "id string, score double")
    got = {tuple(r) for r in delta.report_diff(frame([("a", 1.0), ("b", None), ("c", 2.0)]), frame([("b", 3.0), ("c", 2.126), ("d", 4.0)]), ["id"], "score").collect()}
    assert got == {("a", "resolved", 1.0, None, None), ("b", "carried", None, 3.0, None), ("c", "carried", 2.0, 2.126, 0.13), ("d", "new", None, 4.0, None)}
    commands = spark.createDataFrame([(i, "test") for i in "abcd"], "repository string, kind string")
    told = spark.createDataFrame([("a", "worktree"), ("b", "none"), ("c", "shared"), ("x", "none")], "repository string, isolation string")
    assert {tuple(r) for r in health_rules.isolation_findings(told, commands).collect()} == {("b", "baseline-not-isolated"), ("c", "baseline-isolation-unknown"), ("d", "baseline-isolation-unknown")}
    x = spark.range(1).select(*[delta.environment_fingerprint(F.expr(m)).alias(n) for n, m in {"a": "map('x', '1', 'y', '2')", "b": "map('y', '2', 'x', '1')", "c": "map('x', '1')", "d": "CAST(NULL AS map<string,string>)"}.items()]).first()
    assert x.a == x.b and len({x.a, x.c, x.d}) == 3
    states = spark.createDataFrame([(1, "A", "B"), (2, "A", "A"), (3, None, "A"), (4, "A", None)], "id int, stored_grade string, grade string")
    assert {(r.id, r.stored, r.computed) for r in delta.stored_states(states, ["id"], {"stored_grade": "grade"}).collect()} == {(1, "A", "B"), (4, "A", None)}


def test_lane_receipts(spark):
    from assaykit.operators import evidence

    rows = [
        (1, "a", "s", "complete", ["c1"], [], [], []),
        (1, "a", None, "failed", ["c1", "c1"], ["n1"], [], [""]),
        (2, None, "s", None, None, [], ["x"], []),
        (3, "b", "s", "partial", ["c1"], [], [], []),
    ]
    receipts = spark.createDataFrame(rows, "packet_id int, lane_id string, surface string, status string, claim_refs array<string>, negative_claim_refs array<string>, contradiction_refs array<string>, limitations array<string>")
    records = spark.createDataFrame([(1, "claim_refs", "c1"), (1, "negative_claim_refs", "n1"), (3, "negative_claim_refs", "c1")], "packet_id int, field string, id string")
    packets = spark.createDataFrame([(1, "expedition"), (2, "inline"), (3, "expedition"), (4, "expedition"), (5, "inline")], "packet_id int, mode string")
    got = {(r.packet_id, r.lane_id, r.code, r.path) for r in evidence.receipt_findings(receipts, records, packets).collect()}
    assert got == {
        (1, "a", "lane-id-duplicate", "lane_id"),
        (1, "a", "lane-surface-missing", "surface"),
        (1, "a", "duplicate-value", "claim_refs"),
        (1, "a", "string-required", "limitations"),
        (2, None, "id-invalid", "lane_id"),
        (2, None, "lane-status-invalid", "status"),
        (2, None, "array-required", "claim_refs"),
        (2, None, "lane-ref-unknown", "contradiction_refs:x"),
        (2, None, "inline-lanes-forbidden", "lane_receipts"),
        (3, "b", "lane-ref-unknown", "claim_refs:c1"),
        (3, None, "expedition-lanes-missing", "lane_receipts"),
        (4, None, "expedition-lanes-missing", "lane_receipts"),
    }
