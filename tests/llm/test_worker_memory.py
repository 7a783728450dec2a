"""What executors and their Python workers hold: few files for few rows, freed memory given back after each task."""

import pytest

from tablesense.llm import common, components


def test_few_rows_of_many_partitions_become_few_files(spark):
    wide = spark.range(0, 500, 1, 60)
    settled = common.settle(wide, "few", True)
    assert len(settled.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in settled.collect()) == list(range(500))
    assert len(common.settle(wide, "many").inputFiles()) == 60


def test_an_empty_frame_of_few_rows(spark):
    assert common.settle(spark.range(0).coalesce(1), "few", True).count() == 0


def test_components_write_counted_links_as_few_files(spark, monkeypatch):
    said, settle = [], common.settle
    monkeypatch.setattr(components, "settle", lambda df, name, few=False: said.append((name, few)) or settle(df, name, few))
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {r.component for r in components.connected_components(links).collect()} == {0}
    assert all(few for name, few in said[1:])
    monkeypatch.setattr(components, "are_few", lambda df: False)
    said.clear()
    assert {r.component for r in components.connected_components(links).collect()} == {0}
    assert not any(few for name, few in said)


@pytest.mark.parametrize("ended", [True, False])
def test_a_worker_gives_back_what_it_freed(monkeypatch, ended):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    out = common.giving_back(lambda batches: (b for b in batches))(iter([1, 2, 3]))
    assert next(out) == 1 and not given
    if ended:
        assert list(out) == [2, 3]
    else:
        out.close()
    assert given == [1]


def test_giving_back_frees_arrow_and_runs_twice():
    common.give_back()
    common.give_back()
