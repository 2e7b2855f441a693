"""Word boundaries beside letters that aren't ASCII."""

from pyspark.sql import functions as F

from assaykit.functions.scalars import ascii_words
from assaykit.operators import evidence, handoff, lint

TEXTS = {"noño": True, "ñno": True, "énone.": True, "no\u0301": True, "abſent": True, "noneſ": True, "nope": False, "no_one": False, "knowno": False, "does not exiſt": True}


def test_negatives_know_ascii_words_only(spark):
    x = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert {r.text: r.n for r in x.select("text", evidence.is_negative(F.col("text")).alias("n")).collect()} == TEXTS


def test_negatives_beside_their_sql(spark):
    import duckdb

    from assaykit.queries import SQL

    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    assert [r[1] for r in sorted(con.sql(SQL["evidence_negatives"]).fetchall())] == list(TEXTS.values())


def test_rules_and_secrets_know_ascii_words_only(spark):
    docs = spark.createDataFrame([(1, "éformaté"), (2, "éTODOé"), (3, "éghp_" + "a1" * 12 + "é")], "doc_id int, text string")
    got = {(r.doc_id, r.rule) for r in lint.prompt_findings(docs).collect()}
    assert (1, "FORMAT") not in got and {(2, "TODO"), (2, "FORMAT"), (3, "CRED")} <= got
    assert [(r.doc_id, r.secret) for r in handoff.secret_lines(docs).collect()] == [(3, "github-token")]


def test_only_real_boundaries_are_rewritten():
    assert ascii_words(r"\\bx\d\b") == r"\\bx\d(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    assert ascii_words(r"\bTODO\b") == r"(?<!\w)TODO(?!\w)"
