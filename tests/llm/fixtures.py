"""Small document tables with the cases that every operator must handle, and a long random one."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["aa", "B", "ccc", "d", "éé", "ffff", "the", "token", "İx", "漢字"]


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text))


def edge_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        row(5, None, None, None),
        row(None, "some text without an id, which is last", "en", None),
        row(None, None, None, "s1"),
        row(7, ""),
        row(8, " \t\n\x0b\x0c\r"),
        row(1, long, "de", "s1"),
        row(2, long, "de", "s1"),
        row(3, "same same", "fr", ""),
        row(3, "same same", "fr", ""),
        row(3, "other text for the same id", "fr", "s1"),
        row(11, "x" * 70_000),
        row(12, "line one is long enough\nLINE ONE is long enough \nb"),
        row(13, "line one is long enough\nc"),
        row(-1, " ".join(f"w{i % 977}" for i in range(50)), "en", "s1"),
        row(-4, "negative\u00a0id \u2028 with odd spaces\r\n"),
    ]


def random_rows(n=150, seed=5):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) for _ in range(60)) for _ in range(4)]

    def text():
        t, k = rnd.choice(base), rnd.random()
        if k < 0.2:
            return " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 80)))
        if k < 0.4:
            return t
        w = t.split()
        i = rnd.randrange(len(w))
        w[i : i + 1] = [rnd.choice(WORDS)] * rnd.randint(0, 3)
        if k < 0.7:
            return " ".join(w)
        if k < 0.8:
            return "a" * rnd.randint(90, 400)
        return "\n".join([" ".join(w[rnd.randint(0, 40) :]), " ".join(base[rnd.randrange(4)].split()[:30]), " ".join(w[:30])])

    rows = [row(i, text(), rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", "s2", None])) for i in range(n)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, parts=5):
    # columns that clash with those the operators use inside
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("did", "rid", "rank", "size", "content", "key", "hash", "start", "_did", "name", "block")}
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns(extra)


def last(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id


def multiset(rows):
    return sorted(map(repr, rows))
