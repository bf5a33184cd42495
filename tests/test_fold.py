from datetime import datetime, timedelta

import pytest

from factloom.functions.text import is_unspaced, mentions, tokens_of
from factloom.functions.vectors import hash_vector
from factloom.ingest.extract import extraction
from factloom.ingest.fold import Episode, State, fold, sooner, window


def d(text):
    return datetime.fromisoformat(text)


NONE, ALL = (lambda s, shown: []), (lambda s, shown: True)
NOW = d("2026-06-01")


def say(n, at, facts=(), ends=(), content="", created=None):
    names = {x for r in [*facts, *ends] for x in (r["source_name"], r["target_name"])}
    people = [{"name": x, "labels": ["Entity"], "summary": f"{x} summary"} for x in sorted(names)]
    return Episode(f"ep{n}", content or f"note {n}", d(at), d(created) if created else NOW, people, list(facts), list(ends))


def st(src, rel, tgt, fact=None, start=None, end=None, replaces=False):
    return {"source_name": src, "target_name": tgt, "relation": rel, "fact": fact, "valid_at": d(start) if start else None, "invalid_at": d(end) if end else None, "replaces_previous": replaces}


def end(src, rel, tgt, at=None):
    return {"source_name": src, "target_name": tgt, "relation": rel, "invalid_at": d(at) if at else None}


def run(*notes, judge=NONE):
    state = State()
    return state, fold(state, notes, judge, NOW)


def windows(state, relation=None):
    return sorted(((f.text, f.valid, f.invalid) for f in state.facts if relation in (None, f.name)), key=lambda x: (str(x[1]), x[0]))


def test_backfilled_statement_does_not_bring_a_closed_fact_back():
    state, out = run(
        say(1, "2024-01-15", [st("Bob", "WORKS_AT", "Initech", "Bob works at Initech")]),
        say(2, "2025-03-01", ends=[end("Bob", "WORKS_AT", "Initech", "2025-02-01")]),
        say(3, "2024-06-01", [st("Bob", "WORKS_AT", "Initech", "Bob works at Initech")]),
    )
    assert windows(state) == [("Bob works at Initech", d("2024-01-15"), d("2025-02-01"))]
    assert state.facts[0].episodes == ["ep1", "ep3"] and len(out[2].reinforced) == 1 and len(out[1].invalidated) == 1


def test_new_title_ends_the_old_one():
    state, _ = run(say(1, "2020-01-01", [st("Ann", "HAS_TITLE", "Acme", "junior at Acme")]), say(2, "2022-01-01", [st("Ann", "HAS_TITLE", "Acme", "CTO at Acme")]), judge=ALL)
    assert windows(state) == [("junior at Acme", d("2020-01-01"), d("2022-01-01")), ("CTO at Acme", d("2022-01-01"), None)]
    assert [f.expired for f in state.facts if f.invalid] == [NOW]


def test_only_the_judged_fact_ends():
    judge = lambda s, shown: [i for i, f in enumerate(shown) if "title" in f["fact"]]
    state, _ = run(say(1, "2024-01-01", [st("Ann", "TITLE", "Acme", "title junior"), st("Ann", "HOLDS", "Acme", "owns shares")]), say(2, "2025-01-01", [st("Ann", "TITLE", "Acme", "promoted to lead")]), judge=judge)
    assert {t: i for t, _, i in windows(state)} == {"title junior": d("2025-01-01"), "owns shares": None, "promoted to lead": None}


def test_many_valued_relations_ask_no_judge():
    asked = []
    judge = lambda s, shown: asked.append(s["relation"]) or True
    state, _ = run(say(1, "2024-01-01", [st("Ann", "IN_TEAM", "A", "in team A"), st("Ann", "HAS_ROLE", "R1", "role one")]), say(2, "2025-01-01", [st("Ann", "IN_TEAM", "B", "in team B")]), say(3, "2026-03-01", [st("Ann", "HAS_ROLE", "R2", "role two")]), judge=judge)
    assert asked == ["HAS_ROLE"]
    assert {t: i for t, _, i in windows(state)} == {"in team A": None, "role one": d("2026-03-01"), "in team B": None, "role two": None}


def test_flagged_values_added_late():
    state, _ = run(say(1, "2025-06-01", [st("S", "OWNED_BY", "platform", "owner is platform", replaces=True)]), say(2, "2025-01-01", [st("S", "OWNED_BY", "payments", "owned by payments")]), say(3, "2026-01-01", [st("S", "OWNED_BY", "data", "data owns it", replaces=True)]), judge=ALL)
    holds = lambda t: [f.text for f in state.facts if f.covers(d(t))]
    assert (holds("2025-03-01"), holds("2025-09-01"), holds("2026-03-01")) == (["owned by payments"], ["owner is platform"], ["data owns it"])


@pytest.mark.parametrize("judge", [NONE, ALL])
def test_older_value_never_ends_a_newer_one(judge):
    state, out = run(say(1, "2022-01-01", [st("Ann", "HAS_ROLE", "Acme", "CTO now")]), say(2, "2020-01-01", [st("Ann", "HAS_ROLE", "Acme", "junior first")]), judge=judge)
    assert not out[1].invalidated
    assert windows(state) == [("junior first", d("2020-01-01"), d("2022-01-01")), ("CTO now", d("2022-01-01"), None)]


def test_earlier_evidence_moves_the_start_back_only_without_a_transition():
    same = [st("Ann", "LIKES", "Tea", "Ann likes Tea")]
    state, _ = run(say(1, "2024-06-01", same), say(2, "2025-01-01", same), say(3, "2024-01-01", same))
    assert windows(state) == [("Ann likes Tea", d("2024-01-01"), None)] and state.facts[0].episodes == ["ep1", "ep2", "ep3"]
    state, _ = run(
        say(1, "2023-12-15", [st("D", "WORKS_AT", "Globex", "D works at Globex", "2023-01-01", "2023-12-01")]),
        say(2, "2024-01-01", [st("D", "WORKS_AT", "Initech", "D works at Initech")]),
        say(3, "2022-06-01", [st("D", "WORKS_AT", "Initech", "D works at Initech")]),
    )
    assert [(v, i) for t, v, i in windows(state) if "Initech" in t] == [(d("2022-06-01"), d("2024-01-01")), (d("2024-01-01"), None)]


def test_windows_of_coarse_dates():
    noted = d("2024-03-01")
    assert window(d("2020-01-01"), d("2020-01-01"), noted) == (d("2020-01-01"), d("2020-01-02"), False)
    assert window(d("2022-06-01"), d("2021-01-01"), noted) == (None, d("2021-01-01"), False)
    assert window(None, d("2023-01-01"), noted) == (None, d("2023-01-01"), False)
    assert window(None, None, noted) == (noted, None, True) and sooner(None, noted) == noted and sooner(None, None) is None


def test_same_start_keeps_a_window():
    role = lambda t: st("Ann", "HAS_ROLE", "Acme", t, "2024-03-01")
    state, _ = run(say(1, "2024-03-05", [role("old role")]), say(2, "2024-03-28", [role("new role")]), judge=ALL)
    assert ("old role", d("2024-03-01"), d("2024-03-28")) in windows(state)
    home = lambda n, c: say(n, "2025-01-01", [st("Ann", "LIVES_IN", c, f"lives in {c}")])
    state, _ = run(home(1, "Paris"), home(2, "Berlin"), judge=ALL)
    assert ("lives in Paris", d("2025-01-01"), d("2025-01-01") + timedelta(milliseconds=1)) in windows(state)


def test_termination_makes_no_fact_and_a_stated_end_closes():
    state, out = run(say(1, "2024-01-01", [st("A", "WORKS_AT", "B", "A works at B")]), say(2, "2025-03-01", [st("A", "WORKS_AT", "B", "A works at B", end="2025-02-01")]), say(3, "2025-04-01", ends=[end("A", "LIKES", "B"), end("X", "LIKES", "Y")]))
    assert windows(state) == [("A works at B", d("2024-01-01"), d("2025-02-01"))]
    assert out[2].dropped["invalidations"] == 0 and not out[2].invalidated


def test_outdated_note():
    made = "2026-05-20"
    state, _ = run(say(1, made, [st("Ann", "LIVES_IN", "Oslo", "home is Oslo")], created=made), say(2, "2026-02-20", [st("Ann", "LIVES_IN", "Rome", "moved to Rome", "2026-02-01")], [end("Ann", "LIVES_IN", "Oslo", "2026-02-01")]))
    old = next(f for f in state.facts if f.target != next(e.uuid for e in state.entities.values() if e.name == "Rome"))
    assert old.withdrawn and old.marks["outdatedWhenWritten"] and old.marks["closedByEpisode"] == "ep2"
    assert ("moved to Rome", d("2026-02-01"), None) in windows(state)


def test_alongside_and_same_verdicts():
    job = lambda n, at: say(n, at, [st("M", "EVALUATED_ON", "SetA", f"job {10 + n} number {n * 7}")])
    state, out = run(job(1, "2026-01-01"), job(2, "2026-02-01"), judge=lambda s, shown: {"ended": [], "same": []})
    assert len(state.facts) == 2 and not out[1].reinforced
    state, out = run(job(1, "2026-01-01"), job(2, "2026-02-01"), judge=lambda s, shown: {"ended": [], "same": [0]})
    assert len(state.facts) == 1 and len(out[1].reinforced) == 1


def test_failure_changes_nothing_and_keys_find_duplicates():
    first = say(1, "2024-01-01", [st("A", "WORKS_AT", "B", "A works at B")])
    first.key = "k"
    bad = say(2, "2025-01-01", [st("A", "WORKS_AT", "C", "A works at C")])
    state = State()
    broken = lambda s, shown: 1 / 0
    out = fold(state, [first, first, bad], broken, NOW)
    assert [o.status for o in out] == ["processed", "duplicate", "failed"]
    assert windows(state) == [("A works at B", d("2024-01-01"), None)] and set(state.entities) == {"a", "b"}


def test_entities_merge_literals_drop_and_echoes_are_ignored():
    state = State()
    a = Episode("e1", "Ann at 10.0.0.1", NOW, NOW, [{"name": "Ann", "labels": ["Person"], "summary": "one"}, {"name": "10.0.0.1", "labels": ["Host"], "summary": "x"}])
    b = Episode("e2", "ANN again", NOW, NOW, [{"name": "ANN", "labels": ["Lead"], "summary": ""}])
    c = Episode("e3", "something else", NOW, NOW, [{"name": "Ann", "labels": ["Zed"], "summary": "drift"}])
    out = fold(state, [a, b, c], NONE, NOW)
    assert out[0].dropped["entities"] == 1 and set(state.entities) == {"ann"}
    assert state.entities["ann"].labels == ["Person", "Lead"] and state.entities["ann"].summary == "one"


@pytest.mark.parametrize("text, tokens", [
    ("阿里巴巴", ["阿里", "里巴", "巴巴"]), ("猫", ["猫"]), ("阿里巴巴，腾讯。", ["阿里", "里巴", "巴巴", "腾讯"]), ("张伟在Google做PM", ["张伟", "伟在", "google", "做", "pm"]),
    ("2024年3月入职", ["2024", "年", "3", "月入", "入职"]), ("ＧＰＴ４ 发布", ["gpt4", "发布"]), ("コーヒーが好き", ["コー", "ーヒ", "ヒー", "ーが", "が好", "好き"]),
    ("삼성전자", ["삼성", "성전", "전자"]), ("𠮷野家", ["𠮷野", "野家"]), ("葛\U000e0100城市", ["葛城", "城市"]), ("神︀戸", ["神戸"]), ("Café", ["café"]), ("", []),
])
def test_tokens(text, tokens):
    assert tokens_of(text) == tokens


def test_mentions_and_scripts():
    assert not mentions("he said so", "AI") and mentions("Alice在Acme工作", "Acme") and mentions("use AI.", "AI") and not mentions("a", "a")
    assert is_unspaced("阿里") and not is_unspaced("abc")


def test_hash_vector_has_length_one():
    v = hash_vector("some words here", 64)
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9 and hash_vector("", 8) == [0.0] * 8


def extract(spark, text):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "content string").select(extraction(F.col("content")).alias("x")).first().x.asDict(recursive=True)


def test_extractor(spark):
    found = extract(spark, "Alice works at Acme Corp and Bob likes Pizza. Carol left Globex")
    assert [(f["source_name"], f["relation"]) for f in found["facts"]] == [("Alice", "WORKS_AT"), ("Bob", "LIKES")]
    assert [(f["source_name"], f["target_name"]) for f in found["invalidations"]] == [("Carol", "Globex")]
    assert extract(spark, "张伟在阿里巴巴工作")["facts"][0]["relation"] == "WORKS_AT" and extract(spark, None)["facts"] == []


def spans(state):
    return sorted((f.uuid, str(f.valid), str(f.invalid), tuple(f.episodes), str(sorted(f.marks.items()))) for f in state.facts)


def random_notes(seed):
    import random

    rng = random.Random(seed)
    names, relations, texts = ["A", "B", "C"][: rng.choice([2, 3])], ["WORKS_AT", "likes", "HAS_ROLE"][: rng.choice([1, 2, 3])], ["Ann joins Acme", "Ann left Acme", "Ann joins Acme now", "role one", "the role two is here", "", None]
    moment = lambda: None if rng.random() < 0.35 else d("2020-01-01") + timedelta(days=rng.randrange(60))
    notes = []
    for n in range(50):
        said = [{"source_name": rng.choice(names), "target_name": rng.choice(names), "relation": rng.choice(relations), "fact": rng.choice(texts), "valid_at": moment(), "invalid_at": moment() if rng.random() < 0.4 else None, "replaces_previous": rng.random() < 0.2} for _ in range(rng.randrange(4))]
        ends = [{"source_name": rng.choice(names), "target_name": rng.choice(names), "relation": rng.choice([None, *relations]), "invalid_at": moment()} for _ in range(rng.randrange(3))] if rng.random() < 0.5 else []
        noted = d("2020-01-01") + timedelta(days=rng.randrange(60))
        notes.append(Episode(f"e{n}", "text", noted, noted if rng.random() < 0.2 else d("2020-04-10") + timedelta(days=n // 2), [{"name": x, "labels": ["L"]} for x in names], said, ends))
    return notes


def random_judge(statement, shown):
    import random

    rng = random.Random(f"{statement['fact']}{len(shown)}")
    some = [i for i in range(len(shown)) if rng.random() < 0.4]
    if rng.random() < 0.1:
        raise ValueError("no answer")
    return rng.choice([some, {"ended": some, "same": [i for i in range(len(shown)) if i not in some and rng.random() < 0.5]}, {"ended": some}, True, False])


@pytest.mark.parametrize("seed", range(25))
def test_shelves_give_what_looking_at_every_fact_gives(seed, monkeypatch):
    from factloom.ingest import shelf

    found = []
    for small, block in ((10**9, 256), (0, 2), (3, 4)):
        monkeypatch.setattr(shelf, "SMALL", small)
        monkeypatch.setattr(shelf, "BLOCK", block)
        state = State()
        out = fold(state, random_notes(seed), random_judge)
        found.append((spans(state), [(o.status, [f.uuid for f in o.facts], [f.uuid for f in o.reinforced], [f.uuid for f in o.invalidated]) for o in out]))
    assert found[0] == found[1] == found[2]
    assert {o[0] for o in found[0][1]} >= {"processed"}


def test_a_slot_and_a_pair_with_many_statements():
    import time

    day = lambda k: d("2020-01-01") + timedelta(days=k)
    note = lambda k, facts: Episode(f"e{k}", "x", day(k), day(k), [{"name": n, "labels": ["L"]} for n in {x for f in facts for x in (f["source_name"], f["target_name"])}], facts)
    fact = lambda t, text, start=None, end=None: {"source_name": "a", "target_name": t, "relation": "uses", "fact": text, "valid_at": start, "invalid_at": end}
    for notes, many in (
        ([note(k, [fact(f"t{k}", f"a uses t{k}")]) for k in range(4000)], 4000), ([note(0, [fact(f"t{k}", f"a uses t{k}") for k in range(4000)])], 4000),
        ([note(k, [fact("b", f"they met on day {k} in room {k * 7 % 13}", day(k), day(k + 1))]) for k in range(10_000)], 10_000),
    ):
        began, state = time.time(), State()
        fold(state, notes)
        assert len(state.facts) == many and time.time() - began < 30  # seconds on a loaded machine; 2 to 6 on an idle one


def test_vectors_are_staged_before_any_change():
    asked = []

    def embed(texts):
        asked.append(list(texts))
        if any("boom" in t for t in texts):
            raise OSError("the service is away")
        return [[1.0, float(len(t))] for t in texts]

    state = State()
    out = fold(state, [say(1, "2024-01-01", [st("A", "WORKS_AT", "B", "A works at B"), st("A", "LIKES", "C", "A likes C")]), say(2, "2025-01-01", [st("A", "WORKS_AT", "D", "A works at D"), st("A", "LIKES", "E", "boom")], [end("A", "WORKS_AT", "B")])], NONE, NOW, embed)
    assert [o.status for o in out] == ["processed", "failed"] and asked[0] == ["A works at B", "A likes C", "A", "B", "C"]
    assert windows(state) == [("A likes C", d("2024-01-01"), None), ("A works at B", d("2024-01-01"), None)] and set(state.entities) == {"a", "b", "c"}
    assert [f.vector for f in state.facts] == [[1.0, 12.0], [1.0, 9.0]] and state.dims == 2


def test_vectors_of_another_length_are_made_anew_or_refused():
    state = State()
    two, three = (lambda texts: [[1.0, 0.0]] * len(texts)), (lambda texts: [[0.0, 1.0, 0.0]] * len(texts))
    fold(state, [say(1, "2024-01-01", [st("A", "WORKS_AT", "B", "A works at B")])], NONE, NOW, two)
    again = say(2, "2024-02-01", [st("A", "WORKS_AT", "B", "A works at B")])
    other = say(3, "2024-02-01", [st("A", "LIKES", "C", "A likes C")])
    assert fold(state, [other], NONE, NOW, three)[0].status == "failed" and len(state.facts) == 1 and set(state.entities) == {"a", "b"}  # the graph's length is pinned
    state.dims = 3  # the store has moved to the other model
    assert fold(state, [again], NONE, NOW, three)[0].status == "processed"
    assert state.facts[0].vector == [0.0, 1.0, 0.0] and all(len(e.vector) == 3 for e in state.entities.values())


def test_job_embeds_each_text_once_and_writes_nothing_when_that_fails(spark, tmp_path):
    from factloom.ingest.job import empty_state, fold_groups, next_state, with_payload
    from factloom.streaming.ingest import StateTable, ingest_batch

    rows = [(str(k), f"g{k % 3}", f"Alice works at Acme{'' if k < 6 else ' Corp'}", d("2024-01-01") + timedelta(days=k), d("2024-01-01") + timedelta(days=k)) for k in range(9)]
    notes = spark.createDataFrame(rows, "uuid string, group_id string, content string, valid_at timestamp_ntz, created_at timestamp_ntz")
    log = tmp_path / "asked"

    def embed(texts):
        with log.open("a") as out:
            out.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    changes = fold_groups(with_payload(notes), empty_state(spark), embed=embed).cache()
    vectors = changes.where("kind = 'fact'").selectExpr("get_json_object(row, '$.fact') AS t", "get_json_object(row, '$.fact_embedding') AS v").distinct().collect()
    assert vectors and all(r.v == f"[{float(len(r.t))},1.0]" for r in vectors)
    assert len(log.read_text().split("\n")) == len(set(log.read_text().split("\n")))

    def longer(texts):
        return [[1.0, 2.0, 3.0] for _ in texts]

    more = spark.createDataFrame([("x", "g0", "Alice works at Acme", d("2024-03-01"), d("2024-03-01"))], notes.schema)
    after = fold_groups(with_payload(more), next_state(empty_state(spark), changes), embed=longer).where("kind = 'fact'").collect()
    assert [r.row.count("1.0, 2.0, 3.0") for r in after] == [1]

    def broken(texts):
        raise OSError("away")

    table = StateTable(spark, f"file://{tmp_path}/state")
    ingest_batch(table, notes, 0, f"file://{tmp_path}/log", embed=embed)
    with pytest.raises(Exception, match="away"):
        ingest_batch(table, more, 1, f"file://{tmp_path}/log", embed=broken)
    assert table.versions() == [0]
