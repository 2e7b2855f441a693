"""The registered queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.bpe import read_ranks, round_trip
from assaykit.llm.collocations import collocations
from assaykit.llm.common import bounded_batches
from assaykit.llm.exact_dedup import exact_groups
from assaykit.llm.filter_audit import audit, mask_cells
from assaykit.llm.html_text import main_texts
from assaykit.llm.line_dedup import without_repeated_lines
from assaykit.llm.mixing import mixture
from assaykit.llm.quality import quality_rules
from assaykit.llm.secrets import RULES, secret_spans
from assaykit.llm.simhash import near_groups
from assaykit.llm.substring_index import without_repeated_windows
from assaykit.llm.suffix_dedup import without_repeated_strings
from assaykit.llm.url_filter import judged

#: Files of public tokenizers.
BYTE_BPE, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, public_tokenizers.path(PIECES))


def op2_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_windows(documents(spark, sf_dir))
    return out.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), read_ranks(public_tokenizers.path(BYTE_BPE)), public_tokenizers.PATTERN)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(documents(spark, sf_dir))
    return out.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256)).drop("base_spans")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(documents(spark, sf_dir))
    return out.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_strings(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_cells(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_quality_rules, op2_url_ratio, op3_substring_index, op4_simhash, op5_byte_bpe, op6_secrets, op7_line_dedup, op8_exact_dedup, op9_suffix_dedup, op10_mixture,
        op11_filter_audit, op12_collocations, op13_html_text,
    )
    return {"pipeline": pipeline} | {f.__name__: f for f in each}


def _secrets_sql() -> str:
    """Places of matches from the texts between them: one SELECT a rule."""
    quoted = lambda s: s.replace("'", "''")
    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{quoted(r.pattern)}') AS w, regexp_extract_all(text, '{quoted(r.pattern)}', {r.group}) AS g, string_split_regex(text, '{quoted(r.pattern)}') AS s FROM t"
        for k, r in enumerate(RULES)
    )
    return f"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({each}),
            e AS (
                SELECT doc_id, k, kind, length(w[i]) AS n, length(g[i]) >= least AS ok,
                       coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start
                FROM m, unnest(range(1, len(w) + 1)) AS u(i)),
            f AS (SELECT doc_id, k, start, concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT) AS told FROM e WHERE ok),
            a AS (
                SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                       string_agg(told, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(told, ',' ORDER BY start, k) AS spans
                FROM f GROUP BY doc_id)
            SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
                   coalesce(spans, '') AS spans, sha256(coalesce(base, '')) AS base_sha256
            FROM documents LEFT JOIN a USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_secrets": _secrets_sql(),
        "op3_substring_index": r"""
            WITH words AS (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            windows AS (
                SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS content
                FROM words, unnest(range(1, greatest(len(w) - 11, 1))) AS u(i)),
            repeated AS (
                SELECT doc_id, i FROM windows JOIN (SELECT content, min(doc_id) AS first FROM windows GROUP BY content) USING (content)
                WHERE first < doc_id),
            gone AS (SELECT DISTINCT doc_id, i + k AS i FROM repeated, unnest(range(0, 13)) AS u(k)),
            cut AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
                   sha256(array_to_string(list_filter(w, lambda x, i: places IS NULL OR NOT list_contains(places, i)), ' ')) AS kept_sha256
            FROM words LEFT JOIN cut USING (doc_id)""",
        "op7_line_dedup": r"""
            WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
            lines AS (
                SELECT doc_id, i, l[i] AS line,
                       translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                FROM x, unnest(range(1, len(l) + 1)) AS u(i)),
            repeated AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
            judged AS (SELECT doc_id, i, line, first IS NOT NULL AND doc_id > first AS dropped FROM lines LEFT JOIN repeated USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
            FROM judged GROUP BY doc_id""",
        "op8_exact_dedup": r"""
            WITH x AS (
                SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
                FROM documents)
            SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
                   row_number() OVER best = 1 AS kept, sha256(content) AS text_sha256
            FROM x WINDOW best AS (PARTITION BY content ORDER BY n DESC, doc_id)""",
        "op12_collocations": r"""
            WITH pieces AS (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents),
            words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
            sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
            grams AS (
                SELECT lang, k, w[i : i + k - 1] AS p FROM words, unnest(range(1, 5)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)),
            f AS (SELECT lang, k, p, count(*)::HUGEINT AS f FROM grams GROUP BY lang, k, p HAVING count(*) >= 30),
            cuts AS (
                SELECT c.lang, c.p, c.k, c.f AS a, cut, l.f AS l, r.f AS r, 2000000 * c.f // (l.f + r.f) AS score
                FROM (SELECT f.*, cut, p[1:cut] AS head, p[cut + 1:] AS tail FROM f, unnest(range(1, k)) AS u(cut)) c
                JOIN f l ON l.lang = c.lang AND l.p = c.head JOIN f r ON r.lang = c.lang AND r.p = c.tail),
            scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
            holders AS (
                SELECT lang, p[i : i + size - 1] AS p, max(f) AS most
                FROM f, unnest(range(2, k)) AS a(size), unnest(range(1, k - size + 2)) AS b(i) GROUP BY ALL),
            kept AS (
                SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM scored s LEFT JOIN holders h ON h.lang = s.lang AND h.p = s.p
                WHERE most IS NULL OR 100 * most < 80 * a)
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n,
                   score::BIGINT AS score
            FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000""",
        "op11_filter_audit": r"""
            WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
            w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
            firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
            said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
            fails AS (
                SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                       [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
                        regexp_matches(text, '[#$%&*|]'), first < w.doc_id] AS fails
                FROM w JOIN firsts USING (text) LEFT JOIN said ON said.doc_id = w.doc_id),
            letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS v(letter, k)),
            orders AS (
                SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
                FROM letters a, letters b, letters c, letters d, letters e
                WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
            judged AS (
                SELECT part, filter_order, step, ks[step] AS k, fails[ks[step]] AS here, good, toxic,
                       len(list_filter(ks[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails, n
                FROM (SELECT part, fails, good, toxic, count(*) AS n FROM fails GROUP BY ALL), orders, unnest(range(1, 6)) AS u(step)),
            steps AS (
                SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept,
                       coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
                       coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (here AND NOT gone AND good), 0)::BIGINT AS good_lost,
                       coalesce(sum(n) FILTER (here AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
                FROM judged GROUP BY part, filter_order, step, k)
            SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
                   (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
            FROM steps""",
    }
