"""Steps that are found in one pass are commits of their own, each with what a step by step run would have stored."""

import pytest
from conftest import records
from st_files import corpus

from plcatlas.plans import index_job
from plcatlas.plans.index_job import Options
from plcatlas.sources.store import GraphStore
from plcatlas.streaming import ingest

UNIT = "FUNCTION_BLOCK {}\nEND_FUNCTION_BLOCK\n"
USER = "PROGRAM {}\nVAR x : {}; END_VAR\nEND_PROGRAM\n"
BEFORE = {"b.st": UNIT.format("A"), "c.st": UNIT.format("C"), "use.st": USER.format("P", "A"), "v.st": USER.format("Q", "C")}
# an earlier bearer of A, then A's and C's old files go, then one user takes another name and the last one gets C back
AFTER = {"a.st": UNIT.format("A"), "use.st": USER.format("P", "C"), "v.st": BEFORE["v.st"], "w.st": UNIT.format("C")}
STATES = [
    ({"a.st", "b.st", "c.st", "use.st", "v.st"}, {("st:use.st:P", "st:a.st:A"), ("st:v.st:Q", "st:c.st:C")}),
    ({"a.st", "c.st", "use.st", "v.st"}, {("st:use.st:P", "st:a.st:A"), ("st:v.st:Q", "st:c.st:C")}),
    ({"a.st", "use.st", "v.st"}, {("st:use.st:P", "st:a.st:A")}),
    ({"a.st", "use.st", "v.st"}, set()),
    ({"a.st", "use.st", "v.st", "w.st"}, {("st:use.st:P", "st:w.st:C"), ("st:v.st:Q", "st:w.st:C")}),
]


def state(store):
    paths, edges = store.read().files.select("path").collect(), store.read().relationships.select("from_id", "to_id").collect()
    assert len({r.path for r in paths}) == len(paths) and len(set(edges)) == len(edges)
    return {r.path for r in paths}, {tuple(r) for r in edges}


@pytest.fixture
def store(spark, tmp_path):
    made = GraphStore(spark, str(tmp_path / "g"), buckets=2)
    index_job.full_index(made, corpus(spark, BEFORE), Options(1))
    return made


def test_every_step_is_a_state_of_its_own(spark, store, monkeypatch):
    commit, write, states, whole = store._commit, store._write_all, [], []

    def seen(rows):
        commit(rows)
        if rows[0][1] is not None:
            states.append(state(store))

    monkeypatch.setattr(store, "_commit", seen)
    monkeypatch.setattr(store, "_write_all", lambda writes, version: (whole.append(version), write(writes, version)))
    ingest.catch_up(store, corpus(spark, AFTER), Options(1), files_per_step=1)
    assert states == STATES and not whole  # no bucket was written whole
    assert store.steps_to_fold() == 5
    store.fold()
    assert state(store) == STATES[-1] and store.steps_to_fold() == 0
    assert records(store.near("pous", spark.createDataFrame([("w.st",)], "path STRING")), "id") == [("st:w.st:C",)]


def test_a_pass_that_died_goes_on_and_is_folded(spark, store, monkeypatch):
    monkeypatch.setattr(ingest, "STEPS_AT_ONCE", 3)
    commit, steps = store._commit, []

    def broken(rows):
        if rows[0][1] is not None:
            steps.append(rows)
            if len(steps) == 3:
                raise OSError("lost")
        commit(rows)

    monkeypatch.setattr(store, "_commit", broken)
    with pytest.raises(OSError):
        ingest.catch_up(store, corpus(spark, AFTER), Options(1), files_per_step=1)
    assert state(store) == STATES[1]
    monkeypatch.setattr(store, "_commit", commit)
    left = ingest.catch_up(store, corpus(spark, AFTER), Options(1), files_per_step=1)
    assert records(left, "path") == [("c.st",), ("use.st",), ("w.st",)]
    assert state(store) == STATES[-1] and store.steps_to_fold() == 3
    index_job.update(store, corpus(spark, BEFORE), Options(1))
    assert state(store)[1] == {("st:use.st:P", "st:b.st:A"), ("st:v.st:Q", "st:c.st:C")}
