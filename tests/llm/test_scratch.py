"""Scratch tables: where they go without the setting, and that nothing is left."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from wavemill.llm import common
from wavemill.llm.graph import components


def _session(master, name):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: other), sparkContext=SimpleNamespace(master=master, applicationId=name))


def test_without_the_setting_only_a_local_master_runs():
    root = common.scratch_root(_session("local[2]", "test-local"))
    assert root.startswith("file://") and root == common.scratch_root(_session("local[2]", "test-local"))
    with pytest.raises(ValueError):
        common.scratch_root(_session("spark://host:7077", "test-cluster"))
    del common._ROOTS["test-local"]


def _files(path):
    return [p for p in Path(path.removeprefix("file://")).rglob("*") if p.is_file()]


def test_tables_are_deleted(spark):
    common.clear_scratch(spark)
    links = spark.range(50).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components(links, task_links=7).collect()} == {0}
    kept = common.materialize(links)
    root = common.scratch_root(spark)
    assert _files(kept._scratch)
    common.discard(kept)
    assert not Path(kept._scratch.removeprefix("file://")).exists()
    assert _files(root)  # the components' last table
    common.clear_scratch(spark)
    assert not Path(root.removeprefix("file://")).exists()


def test_a_stage_frees_the_one_before(spark):
    paths = []

    @common.frees_scratch
    def stage(spark, docs):
        out = common.materialize(docs)
        paths.append(out._scratch)
        return out

    first = common.materialize(stage(spark, spark.range(3)))
    assert stage(spark, first).count() == 3
    assert not Path(paths[0].removeprefix("file://")).exists() and _files(paths[1])
    assert first.count() == 3  # what the caller has written stays
