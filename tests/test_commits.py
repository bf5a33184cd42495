import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.ingest.sweep import sweep, sweeping
from factloom.schema import ENTITIES, EPISODES, FACTS
from factloom.sources.saves import Saves
from factloom.sources.store import Conflict, Store
from factloom.streaming.keyed import drain

AT = datetime(2024, 1, 1)


def entity(uuid, name, summary=""):
    return (uuid, "g", name, [], summary, "{}", AT, None)


def rows(spark, *entities):
    return {"entities": spark.createDataFrame(list(entities), ENTITIES)}


def test_of_two_writers_one_wins_and_the_other_does_its_work_again(spark, tmp_path):
    store, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    store.commit(0, **rows(spark, entity("1", "Ann", "0")))
    seen = []

    def add(head):
        if not seen:  # meanwhile another writer commits
            assert other.transact(lambda h: rows(spark, entity("2", "Bob", "other"))) == 1
        seen.append(head)
        count = store.read("entities", upto=head).count()
        return rows(spark, entity("3", "Carol", f"after {count}"))

    assert store.transact(add) == 2 and seen == [0, 1]
    assert {(r.name, r.summary) for r in store.read("entities").collect()} == {("Ann", "0"), ("Bob", "other"), ("Carol", "after 2")}
    assert store.versions() == [0, 1, 2] and not store.commit(1, **rows(spark, entity("9", "Never")))
    assert store.read("entities").count() == 3 and store.transact(lambda h: None) is None


def test_a_marker_is_created_once(spark, tmp_path):
    stores = [Store(spark, f"file://{tmp_path}/s") for _ in range(4)]
    won = []
    threads = [threading.Thread(target=lambda s=s, k=k: won.append(s._publish(7, f"a{k}"))) for k, s in enumerate(stores)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False, False, False, True]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    names = [f"n{k}" for k in range(3)]
    work = [threading.Thread(target=lambda n=n: Store(spark, f"file://{tmp_path}/s").transact(lambda h: rows(spark, entity(n, n)), tries=20)) for n in names]
    [t.start() for t in work]
    [t.join() for t in work]
    store = Store(spark, f"file://{tmp_path}/s")
    assert {r.name for r in store.read("entities").collect()} == set(names) and store.versions() == [0, 1, 2]


def test_a_writer_that_dies_leaves_nothing_and_one_that_is_always_overtaken_says_so(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store._write(0, rows(spark, entity("1", "Ann")))  # no marker
    (tmp_path / "s/_commits").mkdir()
    (tmp_path / "s/_commits/0").touch()  # a marker without content
    assert store.versions() == [] and store.read("entities").count() == 0
    assert store.transact(lambda h: rows(spark, entity("2", "Bob"))) == 1 and [r.name for r in store.read("entities").collect()] == ["Bob"]

    def overtaken(head):
        Store(spark, store.path).transact(lambda h: rows(spark, entity(f"x{head}", f"x{head}")))
        return rows(spark, entity("3", "Carol"))

    with pytest.raises(Conflict):
        store.transact(overtaken, tries=2)
    assert "Carol" not in {r.name for r in store.read("entities").collect()}


def test_saves_are_coalesced_and_never_overlap():
    running, most, begun = [], [], threading.Event()

    def write():
        running.append(1)
        most.append(len(running))
        begun.set()
        time.sleep(0.2)
        running.pop()

    saves = Saves(write)
    saves.ask()
    begun.wait(5)
    for _ in range(50):
        saves.ask()
    saves.flush(10)
    assert saves.runs == 2 and max(most) == 1 and saves.saved == saves.asked == 51
    away = [True]
    broken = Saves(lambda: 1 / 0 if away else None)
    broken.ask()
    with pytest.raises(ZeroDivisionError):
        broken.flush(10)
    away.clear()
    broken.flush(10)
    broken.close()
    assert broken.saved == 1
    with pytest.raises(RuntimeError):
        broken.ask()


def episode(uuid, text, status, attempts, day):
    at = datetime(2024, 1, day)
    return (uuid, "g", uuid, "text", "", text, at, at, status, "why" if status == "failed" else None, f"k{uuid}", attempts)


def test_sweep_commits_facts_and_status_together(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    notes = [episode("a", "Alice works at Acme", "failed", 1, 1), episode("b", "Bob works at Acme", "failed", 3, 2), episode("c", "Alice left Acme", "pending", 0, 3), episode("d", "Carol likes Acme", "processed", 1, 4)]
    store.commit(0, episodes=spark.createDataFrame(notes, EPISODES))
    assert sweep(store) == 1
    state = lambda: {r.uuid: (r.status, r.attempts, r.error) for r in store.read("episodes").collect()}
    assert state() == {"a": ("processed", 2, None), "b": ("failed", 3, "why"), "c": ("pending", 0, None), "d": ("processed", 1, None)}
    assert [(r.uuid, r.invalid_at) for r in store.facts("g").collect()] == [("a/f0", None)]
    assert sweep(store) is None and sweep(store, recover=True) == 2
    assert state()["c"][:2] == ("processed", 1) and [r.invalid_at for r in store.facts("g").collect()] == [datetime(2024, 1, 3)]
    assert {r.name for r in store.entities("g").collect()} == {"Alice", "Acme"}


def test_sweeping_on_a_schedule_until_it_is_drained(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(0, episodes=spark.createDataFrame([episode("a", "Alice works at Acme", "failed", 0, 1)], EPISODES))
    query = sweeping(store, f"file://{tmp_path}/check", "1 seconds")
    until = time.time() + 120
    while time.time() < until and store.versions() != [0, 1]:
        time.sleep(0.5)
    drain(query, 2)
    assert not query.isActive and store.read("facts").count() == 1 and store.read("episodes").where(F.col("status") == "processed").count() == 1
    assert FACTS.fieldNames() == store.read("facts").columns or set(FACTS.fieldNames()) == set(store.read("facts").columns)
