"""The window index when work breaks off, and tables whose rows have no or extreme ids."""

import shutil

import pytest

from tests.llm.fixtures import edge_rows, frame, multiset, random_rows
from tests.llm.test_operators import brute_strings, brute_windows

LARGEST = 2**63 - 2


def without_ids(rows, share):
    return [(None if i % share == 0 else r[0], *r[1:]) for i, r in enumerate(rows)]


CASES = {
    "all null": without_ids(random_rows(40), 1),
    "third null": without_ids(random_rows(90), 3) + edge_rows(),
    "mostly null": [(None, *r[1:]) for r in edge_rows()] + random_rows(3),
    "largest": [(LARGEST - i % 3, *r[1:]) for i, r in enumerate(random_rows(40))] + [(None, *r[1:]) for r in random_rows(20)] + [(-(2**63) + 1, *r[1:]) for r in random_rows(5)],
}


@pytest.mark.parametrize("name", CASES)
def test_ids_that_are_null_or_extreme(spark, name):
    from assaykit.llm.substring_index import without_repeated_windows
    from assaykit.llm.suffix_dedup import without_repeated_strings

    rows = CASES[name]
    got = multiset(tuple(r) for r in without_repeated_windows(frame(spark, rows)).collect())
    assert got == multiset(brute_windows([r[:2] for r in rows]))
    got = multiset((*r[:4], bytes(r.kept)) for r in without_repeated_strings(frame(spark, rows)).collect())
    assert got == multiset(brute_strings([r[:2] for r in rows]))


def test_rows_without_an_id_are_dealt_by_text(spark):
    from assaykit.llm import repeats
    from assaykit.llm.common import keyed

    rows = [(i if i % 2 else None, f"text {i} " * 20, "en", "s", 0) for i in range(1000)]
    dealt = keyed(frame(spark, rows)).withColumn("spot", repeats.spot()).repartition(8, "did", "spot")
    sizes = [r["count"] for r in dealt.groupBy(repeats.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 1000 / 8


@pytest.fixture
def index_rows():
    return sorted((r for r in random_rows(60) if r[0] is not None), key=lambda r: r[0])


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", range(5))
def test_adding_that_breaks_off_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch, index_rows, step):
    from assaykit.llm import substring_index
    from assaykit.llm.substring_index import WindowIndex, new_documents

    folder, cuts = f"file://{tmp_path}/index", [0, 20, 40, 60]
    want = {r[0]: r for r in brute_windows([r[:2] for r in index_rows])}
    index = WindowIndex.create(spark, folder, 4, fan_in=1)
    new_documents(index, frame(spark, index_rows[:20]), frame(spark, [])).collect()

    # the second batch writes a run, hits and a merged run, then the manifest, then deletes two runs: break one of these
    calls = []

    def broken(whole):
        def run(*a, **b):
            calls.append(whole)
            if len(calls) == step + 1:
                raise Broken
            return whole(*a, **b)

        return run

    with monkeypatch.context() as m:
        m.setattr(substring_index, "bucketed", broken(substring_index.bucketed))
        m.setattr(substring_index, "sure_hits", broken(substring_index.sure_hits))
        m.setattr(WindowIndex, "_note", broken(WindowIndex._note))
        m.setattr(substring_index, "drop_bucketed", broken(substring_index.drop_bucketed))
        with pytest.raises(Broken):
            index.add(substring_index.keyed(frame(spark, index_rows[20:40])))
    reopened = WindowIndex.open(spark, folder)
    if step == 4:  # the manifest was in place: the batch is in
        assert reopened.version == 2 and len(reopened.runs) == 1
    else:
        assert reopened.version == 1 and len(reopened.runs) == 1
        again = new_documents(reopened, frame(spark, index_rows[20:40]), frame(spark, index_rows[:20])).collect()
        assert multiset(tuple(r) for r in again) == multiset(want[r[0]] for r in index_rows[20:40])
    last = new_documents(WindowIndex.open(spark, folder), frame(spark, index_rows[40:]), frame(spark, index_rows[:40])).collect()
    assert multiset(tuple(r) for r in last) == multiset(want[r[0]] for r in index_rows[40:])


def test_an_index_that_lost_a_run_is_not_opened(spark, tmp_path, index_rows):
    from assaykit.llm.substring_index import WindowIndex

    folder = f"file://{tmp_path}/index"
    with pytest.raises(Exception):
        WindowIndex.open(spark, folder)
    index = WindowIndex.create(spark, folder, 4)
    index.add(frame(spark, index_rows).selectExpr("doc_id AS did", "0L AS rid", "text"))
    assert WindowIndex.open(spark, folder).runs == index.runs
    shutil.rmtree(tmp_path / "index" / index.runs[0])
    session = spark.newSession()
    with pytest.raises(ValueError, match="0 of 4 buckets"):
        WindowIndex.open(session, folder)


def test_levels_grow(spark, tmp_path, index_rows):
    from assaykit.llm.substring_index import WindowIndex

    index = WindowIndex.create(spark, f"file://{tmp_path}/index", 2, fan_in=1)
    shapes = []
    for k in range(4):
        index.add(frame(spark, index_rows[15 * k : 15 * k + 15]).selectExpr("doc_id AS did", "0L AS rid", "text"))
        shapes.append(sorted(int(r.split("-")[1]) for r in index.runs))
    assert shapes == [[0], [1], [0, 1], [2]]
