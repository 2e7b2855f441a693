"""Phrase collocations against a brute-force version, and the sketch's promise."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import edge_rows, frame, multiset, random_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, longest=4, scale=2_000_000, share=80):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in candidates.items():
            held = any(100 * b >= share * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not held:
                cuts = [(scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        out += [(lang, i, p.decode(), a, left, right, n[lang], score) for i, (_, _, p, a, left, right, score) in enumerate(sorted(kept)[:top], 1)]
    return out


def phrases():
    rnd = random.Random(3)
    fixed = ["New York City", "machine learning model", "per se", "ça va bien", "a\tb  c", "x y z"]
    text = lambda: " ".join(rnd.choice([*fixed, "the", "of", "to", "A", "é."]) + rnd.choice(["", "", ",", "\n", "!"]) for _ in range(120))
    return [(i, text(), rnd.choice(["en", "en", "fr", "", None, "und"]), "s", 0) for i in range(60)]


@pytest.mark.parametrize(("rows", "least", "top"), [([], 2, 5), (edge_rows(), 2, 50), (random_rows(), 5, 7), (phrases() + edge_rows(), 3, 2000), (phrases(), 30, 10)], ids=["empty", "edge", "random", "all", "default"])
def test_collocations(spark, rows, least, top):
    from assaykit.llm.collocations import collocations

    got = [tuple(r) for r in collocations(frame(spark, rows), least=least, top=top).collect()]
    assert multiset(got) == multiset(brute(rows, least, top))
    assert got or not rows


def test_sketch_loses_nothing_frequent_and_scores_stay_exact(spark):
    from assaykit.llm.collocations import reached, scored

    rnd = np.random.default_rng(1)
    entries = [(rnd.integers(0, 4000, 3000).astype(np.uint32), rnd.integers(1, 5, 3000).astype(np.uint32)) for _ in range(8)]
    total = np.zeros(4000, np.int64)
    for h, c in entries:
        np.add.at(total, h, c)
    told = [x for (h, _), bits in zip(entries, reached(entries, 30), strict=True) for x in zip(h.tolist(), bits.tolist(), strict=True)]
    assert all(bit for h, bit in told if total[h] >= 30)
    assert not all(bit for _, bit in told)
    big = 9 * 10**17
    counts = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 7)]
    row = scored(spark.createDataFrame(counts, "lang string, phrase string, k int, f long")).first()
    assert row.score == 2_000_000 * (big - 7) // (2 * big + 1)
