import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.ingest.job import empty_state, fold_groups, next_state, rows_of, with_payload
from factloom.operators import access, corrections, graph, search, temporal
from factloom.schema import ENTITIES, EPISODES, FACTS
from factloom.sources.store import Store, migrate, read_snapshot
from factloom.streaming.ingest import StateTable, start


def d(x):
    return datetime.fromisoformat(x) if x else None


BASE = dict(valid="2024-01-01", invalid="2025-03-01", created="2025-01-01", expired="2025-06-01")
STATES = {
    "ended, end learned later": {}, "end came with the fact": {"expired": None}, "retracted as a whole": {"invalid": None}, "retracted: empty window": {"invalid": "2024-01-01"},
    "stored with an empty window": {"invalid": "2024-01-01", "expired": None}, "open": {"invalid": None, "expired": None}, "start unknown": {"valid": None, "invalid": None, "expired": None},
    "starts later": {"valid": "2026-01-01", "invalid": None, "expired": None}, "end scheduled": {"invalid": "2026-01-01"}, "no creation": {"invalid": None, "expired": None, "created": None},
}
INSTANTS = ["2023-06-01", "2024-01-01", "2024-06-01", "2025-01-01", "2025-03-01", "2025-04-01", "2025-06-01", "2026-01-01", "2027-01-01"]


def frame(spark, rows):
    return spark.createDataFrame([(k, d(r["valid"]), d(r["invalid"]), d(r["created"]), d(r["expired"])) for k, r in rows.items()], "uuid string, valid_at timestamp_ntz, invalid_at timestamp_ntz, created_at timestamp_ntz, expired_at timestamp_ntz")


def plain(f, at, as_of):
    """(known, active) by the definition."""
    v, i, c, e = (d(f[k]) for k in ("valid", "invalid", "created", "expired"))
    known = c is None or c <= as_of
    started = v is None or v <= at
    over = (i <= at and (e or c) <= as_of) if i else (e is not None and e <= as_of)
    return known, known and started and not over


def test_state_grid(spark):
    rows = {k: BASE | v for k, v in STATES.items()}
    df = frame(spark, rows)
    cells = [(a, b) for a in INSTANTS for b in INSTANTS]
    picked = df.select("uuid", *[F.struct(temporal.is_known(b), temporal.is_active(a, b), temporal.state(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)]).collect()
    for row in picked:
        for i, (a, b) in enumerate(cells):
            known, active, state = row[f"c{i}"]
            assert (known, active) == plain(rows[row.uuid], d(a), d(b)), (row.uuid, a, b)
            assert (state == "active") == active and (state is None) == (not known), (row.uuid, a, b)
    base = df.where("uuid = 'ended, end learned later'")
    view = lambda a, b: base.select(temporal.state(a, b), temporal.ends_at(b), temporal.revised_later(b)).first()
    assert tuple(view("2025-04-01", "2027-01-01")) == ("ended", d("2025-03-01"), False)
    assert tuple(view("2025-04-01", "2025-05-01")) == ("active", None, True)
    assert view("2023-06-01", "2027-01-01")[0] == "future" and view("2024-06-01", "2024-12-01")[0] is None
    empty = df.where("uuid = 'retracted: empty window'")
    assert empty.select(temporal.state("2024-06-01", "2025-05-01")).first()[0] == "active"


def test_labels_live_and_covers(spark):
    df = frame(spark, {k: BASE | v for k, v in STATES.items()})
    got = {r.uuid: (r.label, r.live, r.cov) for r in df.select("uuid", temporal.validity_label("2025-04-01").alias("label"), temporal.is_live("2025-04-01").alias("live"), temporal.covers("2024-01-01").alias("cov")).collect()}
    assert got["open"] == ("since 2024-01-01", True, True) and got["starts later"] == ("from 2026-01-01", True, False)
    assert got["end scheduled"][0] == "since 2024-01-01, until 2026-01-01" and got["start unknown"][0] == "still true"
    assert got["ended, end learned later"][0] == "true 2024-01-01 → 2025-03-01" and got["retracted as a whole"][0] == "retracted"


def people(spark):
    return spark.createDataFrame([(str(i), "g", n, d("2024-01-01")) for i, n in enumerate(["Ann Lee", "Ann", "Joann", "Annabel", "Bob"])] + [("9", "h", "Ann", d("2024-01-01"))], "uuid string, group_id string, name string, created_at timestamp_ntz")


def test_name_tiers(spark):
    own = people(spark).where("group_id = 'g'")
    assert [r.name for r in search.find_entities(own, "ANN").collect()] == ["Ann", "Ann Lee", "Annabel", "Joann"]
    assert [r.name for r in search.find_entities(own, "ann", 2).collect()] == ["Ann", "Ann Lee"]
    assert search.find_entities(own, " ").count() == 0 and search.find_entities(own.limit(0), "ann").count() == 0
    named = own.withColumn("name_embedding", F.when(F.col("name") == "Bob", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8))))
    assert [r.name for r in search.find_entities(named, "Robert", 10, [1.0, 0.0]).collect()] == ["Bob"]


def test_hybrid_search_prefers_near_facts(spark):
    rows = [("f1", "nova", "orion", [1.0, 0.0, 0.0, 0.0], "Nova runs on Orion"), ("f2", "orion", "gpu7", [0.3, 1.0, 1.0, 0.0], "Orion has gpu7"), ("f3", "vega", "lyra", [0.5, 1.0, 0.5, 0.0], "Vega near Lyra")]
    facts = spark.createDataFrame([(u, "g", s, t, v, x, d("2024-01-01"), None, d("2024-01-01"), None) for u, s, t, v, x in rows], "uuid string, group_id string, source_node_uuid string, target_node_uuid string, embedding array<double>, fact string, valid_at timestamp_ntz, invalid_at timestamp_ntz, created_at timestamp_ntz, expired_at timestamp_ntz")
    facts = facts.withColumn("tokens", X.tokenize(F.col("fact")))
    ents = spark.createDataFrame([(n.lower(), "g", n) for n in ("Nova", "Orion", "gpu7", "Vega", "Lyra")], "uuid string, group_id string, name string")
    got = search.hybrid_search(facts, ents, "where is nova deployed", X.tokens_of("where is nova deployed"), [1.0, 1.0, 0.0, 0.0], "2025-01-01", group="g")
    assert [r.uuid for r in got.collect()] == ["f1", "f2", "f3"]
    none = search.hybrid_search(facts, ents, "zzz", ["zzz"], [0.0, 0.0, 0.0, 1.0], "2025-01-01", group="g")
    assert none.count() == 0
    assert [r.uuid for r in search.hybrid_search(facts, ents, "lyra", ["lyra"], None, "2025-01-01").collect()][0] == "f3"


def test_bm25_against_the_formula(spark):
    import math

    docs = {"a": ["x", "y", "x"], "b": ["y"], "c": ["z", "z"], "d": []}
    df = spark.createDataFrame(list(docs.items()), "uuid string, tokens array<string>")
    got = {r.uuid: r.score for r in search.bm25(df, ["x", "y", "x"]).collect()}
    avg = sum(map(len, docs.values())) / 4

    def score(doc):
        out = 0
        for q in ["x", "y", "x"]:
            df_ = sum(q in t for t in docs.values())
            tf = docs[doc].count(q)
            out += math.log(1 + (4 - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[doc]) / avg))
        return out

    assert set(got) == {"a", "b"} and all(abs(got[k] - score(k)) < 1e-12 for k in got)


def test_graph_lookups(spark):
    f = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d"), ("4", "a", "a")], "uuid string, source_node_uuid string, target_node_uuid string")
    ids = spark.createDataFrame([("a",)], "uuid string")
    near = graph.neighbours(f, ids)
    assert [r.uuid for r in near.collect()] == ["b"]
    assert {r.uuid: r.distance for r in graph.graph_distance(f, ids, near).collect()} == {"1": 0, "2": 1, "3": None, "4": 0}
    assert {r.uuid: r.degree for r in graph.degrees(f).collect()} == {"a": 3, "b": 2, "c": 2, "d": 1}
    assert {r.uuid for r in graph.touching(f, ids).collect()} == {"1", "4"} and graph.adjacency(f).count() == 7


def test_corrections(spark):
    rows = {"open": BASE | {"invalid": None, "expired": None}, "over": BASE, "gone": BASE | {"invalid": None}}
    f = frame(spark, rows)
    ids = f.select("uuid", F.lit("2025-05-01").cast("timestamp_ntz").alias("at"))
    assert {r.uuid: r.outcome for r in corrections.end_facts(f, ids, "2025-07-01").collect()} == {"open": "ended", "over": "conflict", "gone": "conflict"}
    assert {r.uuid for r in corrections.retract_facts(f, ids, "2025-07-01").collect()} == {"open", "over"}
    back = corrections.reopen_facts(f, f.select("uuid", F.lit(None).cast("timestamp_ntz").alias("invalid_at")), "2025-07-01").collect()
    assert sorted((r.outcome, r.invalid_at) for r in back if r.outcome == "reopened") == [("reopened", None)] * 2
    assert sorted(r.outcome for r in back) == ["conflict", "reopened", "reopened", "withdrawn", "withdrawn"] and [r.uuid for r in back if r.outcome == "conflict"] == ["open"]
    twice = corrections.end_facts(f, ids.union(ids), "2025-07-01")
    assert twice.count() == 3


def test_corrections_by_hand(spark):
    """The rules for ends: over by the end asked for, or in the past, refuses; marks keep their types; nothing is reopened twice."""
    rows = {"over": {"invalid": "2020-06-01"}, "ahead": {"invalid": "2022-01-01"}, "open": {"invalid": None}, "unknown": {"valid": None, "invalid": None}}
    base = {"valid": "2019-01-01", "created": "2019-01-02", "expired": None}
    f = frame(spark, {k: BASE | base | v for k, v in rows.items()})
    attributes = '{"closedByEpisode":"e1","previousEnd":"2023-01-01T00:00:00","flag":true,"n":1.5,"deep":{"x":[1,null,"a"]},"text":"true"}'
    f = f.withColumn("attributes", F.lit(attributes))
    end = lambda at, now: {r.uuid: r for r in corrections.end_facts(f, f.select("uuid", F.lit(at).cast("timestamp_ntz").alias("at")), now, "r" * 200).collect()}
    outcomes = lambda at, now: {k: r.outcome for k, r in end(at, now).items()}
    assert outcomes("2020-03-01", "2021-01-01") == {"over": "conflict", "ahead": "ended", "open": "ended", "unknown": "ended"}
    assert outcomes("2020-09-01", "2020-03-01") == {"over": "conflict", "ahead": "ended", "open": "ended", "unknown": "ended"}
    assert outcomes("2020-03-01", "2020-03-01")["over"] == "ended" and outcomes("2018-01-01", "2018-01-01")["open"] == "conflict"
    got = end("2021-05-01", "2021-01-01")["open"]
    assert json.loads(got.attributes) == {"flag": True, "n": 1.5, "deep": {"x": [1, None, "a"]}, "text": "true", "invalidatedBy": "r" * 120}
    assert json.loads(end("2018-01-01", "2021-01-01")["open"].attributes) == json.loads(attributes)
    gone = corrections.retract_facts(f, f.select("uuid"), "2021-01-01", "never so").where("uuid = 'open'").first()
    assert json.loads(gone.attributes)["retracted"] is True and json.loads(gone.attributes)["invalidatedBy"] == "never so" and "closedByEpisode" not in json.loads(gone.attributes)
    ask = lambda df: df.select("uuid", F.lit(None).cast("timestamp_ntz").alias("invalid_at"), F.lit("a slip").alias("reason"))
    back = corrections.reopen_facts(f, ask(f), "2021-01-01").cache()
    rows = {(r.uuid, r.outcome): json.loads(r.attributes) for r in back.collect()}
    copy = "over#20210101000000000"
    assert rows["over", "withdrawn"]["reopenedAs"] == copy and rows["over", "withdrawn"]["closedAt"].startswith("2020-06-01T00:00:00") and rows["over", "withdrawn"]["closedByEpisode"] == "e1"
    assert rows[copy, "reopened"]["reopenedFrom"] == "over" and rows[copy, "reopened"]["reopenReason"] == "a slip" and "closedByEpisode" not in rows[copy, "reopened"] and rows[copy, "reopened"]["deep"] == {"x": [1, None, "a"]}
    changed = back.where("outcome in ('withdrawn', 'reopened')").drop("outcome")
    assert {r.outcome for r in corrections.reopen_facts(changed, ask(changed), "2021-02-01").collect()} == {"conflict"}


def test_later_values_of_flagged_and_renamed_slots(spark):
    rows = [("a", "has role", "2020-01-01", None), ("b", "HAS-ROLE", "2021-01-01", None), ("c", "likes", "2020-01-01", None), ("d", "LIKES", "2021-01-01", '{"replacesPrevious":"true"}'), ("e", "likes", "2022-01-01", '{"replacesPrevious":true}'), ("f", "likes", "2023-01-01", None)]
    f = spark.createDataFrame(rows, "uuid string, name string, v string, attributes string").select("uuid", "name", "attributes", F.lit("s").alias("source_node_uuid"), F.lit("t").alias("target_node_uuid"), F.col("v").cast("timestamp_ntz").alias("valid_at"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"), F.lit(None).cast("timestamp_ntz").alias("expired_at"), F.col("v").cast("timestamp_ntz").alias("created_at"))
    assert {r.uuid: str(r.next_at)[:4] for r in corrections.later_values(f).collect()} == {"a": "2021", "c": "2022", "d": "2022", "e": "2023"}


def test_access(spark):
    grants = spark.createDataFrame([("u", "a*", "reader"), ("u", "ab", "owner"), ("v", "b", "writer")], "user string, pattern string, role string")
    groups = spark.createDataFrame([("a",), ("ab",), ("b",)], "group_id string")
    got = {(r.user, r.group_id): r.role for r in access.roles(grants, groups).collect()}
    assert got == {("u", "a"): "reader", ("u", "ab"): "owner", ("v", "b"): "writer"}
    assert {(r.group_id, r.role) for r in access.roles(grants, groups, "writer", ["ab"]).collect()} == {("ab", "writer")}


def test_effective_grants(spark):
    pairs = [("a*", "ab*"), ("a", "b"), ("*", "x"), ("a*", "b*"), ("a", "a*"), ("a*", "a*")]
    grants = spark.createDataFrame([(f"u{k}", a, "owner") for k, (a, _) in enumerate(pairs)], "user string, pattern string, role string")
    within = spark.createDataFrame([(f"u{k}", b) for k, (_, b) in enumerate(pairs)], "user string, pattern string")
    limits = spark.createDataFrame([(f"u{k}", "writer", True) for k in range(len(pairs))], "user string, cap string, narrowed boolean")
    got = {(r.user, r.pattern, r.role) for r in access.effective_grants(grants, limits, within).collect()}
    assert got == {("u0", "ab*", "writer"), ("u2", "x", "writer"), ("u4", "a", "writer"), ("u5", "a*", "writer")}


def test_forget_an_episode(spark):
    rows = [
        ("sole", ["e1"], "2024-01-01", None, None, None), ("shared", ["e1", "e2"], "2024-01-01", None, None, None),
        ("closed", ["e2"], "2024-01-01", "2024-05-01", "2024-06-01", '{"closedByEpisode":"e1","previousEnd":"2025-01-01T00:00:00.000"}'),
        ("old", ["e2"], "2024-01-01", "2024-05-01", "2024-06-01", None), ("gone", ["e1"], "2024-01-01", "2024-01-01", "2024-06-01", None),
    ]
    f = spark.createDataFrame(rows, "uuid string, episodes array<string>, v string, i string, x string, attributes string")
    f = f.select("uuid", "episodes", "attributes", F.lit("LIKES").alias("name"), F.col("uuid").alias("source_node_uuid"), F.lit("t").alias("target_node_uuid"), *[F.col(a).cast("timestamp_ntz").alias(b) for a, b in (("v", "valid_at"), ("i", "invalid_at"), ("x", "expired_at"))])
    f = f.withColumn("created_at", F.when(F.col("uuid") == "sole", F.lit("2024-06-01")).otherwise("2024-02-01").cast("timestamp_ntz"))
    people = spark.createDataFrame([("sole", "new", '{"summaryByEpisode":"e1","previousSummary":"former"}'), ("x", "", '{"createdByEpisode":"e1"}'), ("shared", "", '{"createdByEpisode":"e1"}')], "uuid string, summary string, attributes string")
    notes = spark.createDataFrame([("e1", "processed", None), ("e2", "processed", None)], "uuid string, status string, error string")
    out = corrections.forget_episode(f, people, notes, "e1", "wrong", "2025-07-01")
    assert {(r.uuid, r.outcome) for r in out.report.collect()} == {("sole", "retracted"), ("shared", "unlinked"), ("closed", "reopened"), ("old", "unmarked")}
    changed = {(r.uuid.split("#")[0], r.outcome): r for r in out.facts.collect()}
    assert set(changed) == {("sole", "retracted"), ("shared", "unlinked"), ("closed", "withdrawn"), ("closed", "reopened")}
    assert changed["shared", "unlinked"].episodes == ["e2"] and changed["closed", "reopened"].invalid_at == datetime(2025, 1, 1) and '"reopenedFrom":"closed"' in changed["closed", "reopened"].attributes
    assert changed["sole", "retracted"].invalid_at == datetime(2024, 1, 1) and '"retracted":true' in changed["sole", "retracted"].attributes
    assert [(r.uuid, r.summary) for r in out.entities.collect()] == [("sole", "former")] and [r.uuid for r in out.orphaned.collect()] == ["x"]
    assert [(r.status, r.error, r.outcome) for r in out.episode.collect()] == [("forgotten", "wrong", "forgotten")]


def test_notes_in_two_spellings_are_one(spark):
    key = spark.createDataFrame([("Caf\u00e9",), ("Cafe\u0301",)], "t string").select(X.idempotency_key(F.col("t"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("k"))
    assert len({r.k for r in key.collect()}) == 1


def test_retry_feeds_failed_notes_to_the_fold(spark):
    from factloom.ingest import lifecycle

    rows = [("1", "g", "Alice works at Acme", "2024-01-01", "failed", 1), ("2", "g", "Bob works at Acme", "2024-01-02", "failed", 3), ("3", "g", "Carol works at Acme", "2024-01-03", "pending", 0)]
    notes = spark.createDataFrame([(*r[:3], datetime.fromisoformat(r[3]), datetime.fromisoformat(r[3]), *r[4:], None) for r in rows], "uuid string, group_id string, content string, valid_at timestamp_ntz, created_at timestamp_ntz, status string, attempts int, error string")
    changes, after = lifecycle.refed(notes, empty_state(spark), recover=True)
    assert {r.uuid for r in changes.where("kind = 'fact'").collect()} == {"1/f0", "3/f0"}
    assert {(r.uuid, r.status, r.attempts) for r in after.collect()} == {("1", "processed", 2), ("2", "failed", 3), ("3", "processed", 1)}


NOTES = [
    ("1", "g", "Alice works at Acme", "2024-01-01"), ("2", "g", "Alice left Acme", "2024-06-01"), ("3", "g", "alice  WORKS at Acme", "2024-01-01"), ("4", "h", "Bob likes Pizza", "2024-02-01"), ("5", "g", "Carol joined Globex", "2024-07-01"), ("6", "g", None, "2024-07-02"),
]
NOTE_SCHEMA = "uuid string, group_id string, content string, valid_at timestamp_ntz, created_at timestamp_ntz"


def note_rows():
    return [(u, g, c, d(t), d(t)) for u, g, c, t in NOTES]


def facts_of(state):
    return sorted((r.fact, r.valid_at, r.invalid_at) for r in rows_of(state.withColumnRenamed("status", "s") if "status" in state.columns else state, "fact", FACTS).collect())


def test_batch_fold_and_next_state(spark):
    notes = spark.createDataFrame(note_rows(), NOTE_SCHEMA)
    changes = fold_groups(with_payload(notes), empty_state(spark)).cache()
    assert {r.uuid: r.status for r in changes.where("kind = 'episode'").collect()} == dict.fromkeys("123456", "processed") | {"3": "duplicate"}
    state = next_state(empty_state(spark), changes)
    assert ("Alice works at Acme", d("2024-01-01"), d("2024-06-01")) in facts_of(state)
    assert rows_of(state, "entity", ENTITIES).count() == 6
    again = fold_groups(with_payload(notes), state)
    assert {r.status for r in again.where("kind = 'episode' and uuid <> '6'").collect()} == {"duplicate"}


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    notes = spark.createDataFrame(note_rows(), NOTE_SCHEMA)
    table = StateTable(spark, f"file://{tmp_path}/state", compact_after=2)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(NOTE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k in range(2):
        notes.orderBy("created_at").where(F.col("created_at") < "2024-06-15" if k == 0 else F.col("created_at") >= "2024-06-15").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start(source, table, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    assert table.versions() == [0, 1]
    batch = next_state(empty_state(spark), fold_groups(with_payload(notes), empty_state(spark)))
    assert facts_of(table.read()) == facts_of(batch)


def test_store_versions_snapshot_and_migration(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    ent = lambda u, n, g="g": (u, g, n, ["Person"], "", "{}", d("2024-01-01"), None)
    fact = lambda u, s, t, x="x": (u, "g", s, t, "R", x, ["e"], None, None, d("2024-01-01"), None, '{"a": {"b": [1]}}', [1.0, 2.0])
    store.commit(0, entities=spark.createDataFrame([ent("1", "Ann"), ent("2", "Bob")], ENTITIES), facts=spark.createDataFrame([fact("f", "1", "2")], FACTS))
    store.commit(0, facts=spark.createDataFrame([fact("never", "1", "2")], FACTS))
    store.commit(1, entities=spark.createDataFrame([ent("3", "ANN")], ENTITIES), facts=spark.createDataFrame([fact("f", "1", "2", "changed")], FACTS))
    assert {(r.uuid, r.name) for r in store.read("entities", "g").collect()} == {("1", "ANN"), ("2", "Bob")}
    assert [r.fact for r in store.read("facts").collect()] == ["changed"] and [r.fact for r in store.read("facts", upto=0).collect()] == ["x"]
    assert store.health() == {"facts": 1, "dims": 2}
    store.commit(2, facts=store.read("facts").drop("deleted").withColumn("deleted", F.lit(True)))
    assert store.read("facts").count() == 0
    store.dump(f"{tmp_path}/snap")
    other = Store(spark, f"file://{tmp_path}/other")
    other.load(f"{tmp_path}/snap")
    assert other.read("entities").count() == 2
    (tmp_path / "doc.json").write_text('{"episodes": [], "entities": [{"uuid": "9", "group_id": "g", "name": "ann", "labels": [], "summary": "", "created_at": "2024-01-01T00:00:00"}], "facts": [{"uuid": "z", "group_id": "g", "source_node_uuid": "9", "target_node_uuid": "9", "name": "R", "fact": "t", "episodes": []}, {"uuid": "y", "group_id": "g", "source_node_uuid": "9", "target_node_uuid": "none", "name": "R", "fact": "t", "episodes": []}]}')
    report = migrate(read_snapshot(spark, f"{tmp_path}/doc.json"), other, 5)
    assert report == {"episodes": 0, "entities": 1, "facts": 1, "skipped": 1}
    assert [(r.source_node_uuid, r.fact) for r in other.read("facts").collect()] == [("1", "t")]
    other.reset()
    assert other.versions() == []


def test_upserts_by_column(spark, tmp_path):
    """What a later version of a row may change, as the rules for each table say."""
    store = Store(spark, f"file://{tmp_path}/store")
    ent = lambda u, name, summary, vector, at="2024-01-01": (u, "g", name, ["Person"], summary, "{}", d(at), vector)
    fact = lambda text, vector, src="1", at="2024-01-01", end=None, ep=("e",): ("f", "g", src, "2", "R", text, list(ep), None, end, d(at), None, "{}", vector)
    note = lambda text, status, at="2024-01-01": ("e", "g", "n", "text", "", text, d(at), d(at), status, None, "h", 0)
    frames = lambda **rows: {k: spark.createDataFrame(v, {"entities": ENTITIES, "facts": FACTS, "episodes": EPISODES}[k]) for k, v in rows.items()}
    store.commit(0, **frames(entities=[ent("1", "Ann", "a", [1.0, 2.0])], facts=[fact("x", [3.0, 4.0])], episodes=[note("content", "pending")]))
    store.commit(1, **frames(entities=[ent("9", "ANN", "", None, "2025-01-01")], facts=[fact("x", None, "7", "2025-01-01", d("2025-02-01"), ("e", "e2"))], episodes=[note("other", "processed", "2025-01-01")]))
    one = lambda name: store.read(name).first().asDict()
    e, f, n = one("entities"), one("facts"), one("episodes")
    assert (e["uuid"], e["name"], e["summary"], e["name_embedding"], e["created_at"]) == ("1", "ANN", "", [1.0, 2.0], d("2024-01-01"))
    assert (f["source_node_uuid"], f["created_at"], f["invalid_at"], f["episodes"], f["fact_embedding"]) == ("1", d("2024-01-01"), d("2025-02-01"), ["e", "e2"], [3.0, 4.0])
    assert (n["content"], n["created_at"], n["status"]) == ("content", d("2024-01-01"), "processed")
    store.commit(2, **frames(facts=[fact("y", None)]))
    assert one("facts")["fact_embedding"] is None and one("facts")["invalid_at"] is None
    store.commit(3, facts=store.read("facts").withColumn("deleted", F.lit(True)))
    assert store.read("facts").count() == 0
    store.commit(4, **frames(facts=[fact("z", [5.0], "8", "2026-01-01")]))
    assert (one("facts")["source_node_uuid"], one("facts")["created_at"], one("facts")["fact_embedding"]) == ("8", d("2026-01-01"), [5.0])


@pytest.mark.parametrize("value, found", [("10.0.0.1:80", True), ("::1", True), ("-1,000.5", True), ("https://x.y/z", True), ("v1.2.3", True), ("Ann", False), ("3 cats", False)])
def test_literals(spark, value, found):
    assert spark.range(1).select(X.is_literal(F.lit(value))).first()[0] is found and X.is_literal_name(value) is found


def test_hashes_and_relations(spark):
    df = spark.createDataFrame([(" A  b\n", "works at"), ("a B", " "), ("x", None)], "c string, r string")
    rows = df.select(X.content_hash(F.col("c")).alias("h"), X.normalise_relation(F.col("r")).alias("r")).collect()
    assert rows[0].h == rows[1].h != rows[2].h and [r.r for r in rows] == ["WORKS_AT", "RELATES_TO", "RELATES_TO"]


def test_a_store_as_one_document_and_facts_that_cite_a_lost_id(spark, tmp_path):
    import json

    store = Store(spark, f"file://{tmp_path}/store")
    row = lambda schema, **v: spark.createDataFrame([tuple(v.get(f.name) for f in schema)], schema)
    at = datetime(2024, 1, 1)
    store.commit(0, entities=row(ENTITIES, uuid="n1", group_id="g", name="Acme", created_at=at))
    store.commit(1, entities=row(ENTITIES, uuid="n2", group_id="g", name="ACME", created_at=at), facts=row(FACTS, uuid="f", group_id="g", source_node_uuid="n2", target_node_uuid="n9", name="X", created_at=at))
    assert [(r.uuid, r.name) for r in store.entities().collect()] == [("n1", "ACME")]
    assert [(r.source_node_uuid, r.target_node_uuid) for r in store.facts("g").collect()] == [("n1", "n9")]
    store.dump_document(f"file://{tmp_path}/one")
    text = "".join(p.read_text() for p in (tmp_path / "one").glob("part-*"))
    assert {k: len(v) for k, v in json.loads(text).items()} == {"episodes": 0, "entities": 1, "facts": 1}
    back = read_snapshot(spark, f"file://{tmp_path}/one")
    assert [r.uuid for r in back["facts"].collect()] == ["f"]


def test_replies_are_sanitised(spark):
    from factloom.ingest.reply import payload_of

    reply = '''Here: ```json
{"entities": [{"name": " Ann ", "labels": ["Person", ""]}, {"name": ""}, {"labels": []}], "facts": [
{"source_name": "Ann", "target_name": "Acme ", "relation": "works at", "valid_at": "2024-02-30", "invalid_at": "2024-03-01"}, {"source_name": "", "target_name": "x"}], "more": 1}
```'''
    got = [r.p.asDict(recursive=True) for r in spark.createDataFrame([(reply,), ("no object",), (None,)], "r string").select(payload_of(F.col("r")).alias("p")).collect()]
    assert [(e["name"], e["labels"]) for e in got[0]["entities"]] == [("Ann", ["Person"]), ("Acme", [])]
    assert [(f["target_name"], f["relation"], f["valid_at"], f["invalid_at"]) for f in got[0]["facts"]] == [("Acme", "WORKS_AT", None, "2024-03-01T00:00:00.000")]
    assert got[1] == got[2] == {"entities": [], "facts": [], "invalidations": []}


@pytest.mark.parametrize("seed", range(6))
def test_the_first_rows_of_a_fusion_without_ranking_all(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [
        (f"u{k:03}", d("2024-01-01") if rng.random() < 0.5 else d("2024-02-01"), rng.choice([None, 0.0, round(rng.random(), rng.choice([1, 6]))]) if rng.random() < 0.4 + 0.1 * seed else None,
         rng.choice([None, round(rng.uniform(-1, 1), rng.choice([1, 6]))]), rng.choice([None, None, 0, 1]) if seed % 2 else None)
        for k in range(400)
    ]
    df = spark.createDataFrame(rows, "uuid string, created_at timestamp_ntz, kw double, cosine double, distance int").repartition(3).cache()
    rank = lambda at: {r[0]: n for n, r in enumerate(sorted((r for r in rows if r[at] is not None and r[at] > 0), key=lambda r: (-r[at], r[1], r[0])), 1)}
    kw, vec = rank(2), rank(3)
    near = {0: search.NEAR_BONUS, 1: search.NEXT_BONUS, None: 0.0}
    scored = [(r[0], round((1 / (60 + kw[r[0]]) if r[0] in kw else 0) + (1 / (60 + vec[r[0]]) if r[0] in vec else 0) + near[r[4]], 12), r[1]) for r in rows if r[0] in kw or near[r[4]] or (r[3] is not None and r[3] >= 0.4)]
    want = [(u, s) for u, s, _ in sorted(scored, key=lambda x: (-x[1], -x[2].timestamp(), x[0]))]
    for limit, depth in ((5, 5), (40, None), (40, 8), (1000, 64)):
        got = search.fused_topk(df, limit, depth=depth)
        assert [u for u, _ in got] == [u for u, _ in want[:limit]] and all(abs(a[1] - b[1]) < 1e-11 for a, b in zip(got, want, strict=False))


def test_names_are_folded_and_quoted(spark):
    own = spark.createDataFrame([("1", "ＧＰＴ４"), ("2", "a\\Eb"), ("3", "plain"), ("4", "Café"), ("5", "x")], "uuid string, name string")
    named = lambda q, folded=True: {r.uuid for r in search.naming_entities(own, q, folded).collect()}
    assert named("is gpt4 here") == {"1"} and named("the A\\EB thing") == {"2"} and named("PLAIN. x") == {"3"} and named("plainly") == set()
    assert named("the ｃａｆé") == {"4"} and named("is gpt4 here", False) == set() and {r.uuid for r in search.anchors(own, "ＰＬＡＩＮ").collect()} == {"3"}


def test_index_within_a_scope(spark, tmp_path):
    docs = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["y"]), ("c", ["x", "z"]), ("e", [])], "uuid string, tokens array<string>")
    index = search.Index(spark, f"file://{tmp_path}/index").write(docs)
    rows = lambda df: sorted((r.uuid, round(r.score, 9)) for r in df.collect())
    for keep in (["a", "b", "c", "e"], ["a", "b"], ["c", "e"], []):
        own = docs.where(F.col("uuid").isin(keep)) if keep else docs.limit(0)
        assert rows(index.bm25(["x", "y", "x"], within=own)) == rows(search.bm25(own, ["x", "y", "x"]))


def test_slot_conflicts_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    at = lambda k: None if k is None else d("2024-01-01") + timedelta(days=k)
    rows = [(f"f{k:03}", f"s{rng.randrange(4)}", f"t{rng.randrange(3)}", "R", rng.choice([None, *range(60)]), None) for k in range(150)]
    rows = [(*r[:5], None if rng.random() < 0.1 else (r[4] or 0) + rng.randrange(6)) for r in rows]
    f = spark.createDataFrame([(*r[:4], at(r[4]), at(r[5])) for r in rows], "uuid string, source_node_uuid string, target_node_uuid string, name string, valid_at timestamp_ntz, invalid_at timestamp_ntz")
    inf = float("inf")
    span = {r[0]: (-inf if r[4] is None else r[4], inf if r[5] is None else r[5]) for r in rows}
    meet = lambda a, b: a[1] == b[1] and a[0] != b[0] and span[a[0]][0] < span[b[0]][1] and span[b[0]][0] < span[a[0]][1] and all(span[x[0]][0] < span[x[0]][1] for x in (a, b))
    root = {r[0]: r[0] for r in rows}
    while True:
        moved = {a[0]: min(root[a[0]], *[root[b[0]] for b in rows if meet(a, b)], root[a[0]]) for a in rows}
        if moved == root:
            break
        root = moved
    got = {r.uuid: (r.conflicts, r.cluster) for r in graph.slot_conflicts(f).collect()}
    assert got == {a[0]: (sum(meet(a, b) and a[2] != b[2] for b in rows), root[a[0]]) for a in rows}


def test_index_after_changes_is_one_built_anew(spark, tmp_path):
    import random

    rng = random.Random(7)
    words = ["x", "y", "z", "w"]
    text = lambda: [rng.choice(words) for _ in range(rng.randrange(6))]
    held, live = {}, search.LiveIndex(spark, f"file://{tmp_path}/live", merge_after=3)
    for version in range(5):
        change = {f"d{rng.randrange(12)}": None if rng.random() < 0.3 else text() for _ in range(5)}
        held |= change
        live.apply(version, spark.createDataFrame([(k, v, v is None) for k, v in change.items()], "uuid string, tokens array<string>, deleted boolean"))
        live.apply(version, spark.createDataFrame([("d0", ["x"] * 9, False)], "uuid string, tokens array<string>, deleted boolean"))  # a repeated version
        rows = lambda df: sorted((r.uuid, round(r.score, 9)) for r in df.collect())
        anew = spark.createDataFrame([(k, v) for k, v in held.items() if v is not None], "uuid string, tokens array<string>")
        if version in (1, 2, 4):
            assert rows(live.bm25(["x", "y", "x"])) == rows(search.bm25(anew, ["x", "y", "x"])), version
    assert live._numbers("base=") == [2] and live._parts() == (["base=2"], [3, 4])


def test_search_tokens_are_filled_in(spark):
    rows = [("1", "a", "b", "WORKS_AT", "Ann works", None), ("2", "a", "z", "LIKES", "爱猫", None), ("3", "a", "b", "R", "kept", ["old"])]
    f = spark.createDataFrame(rows, "uuid string, source_node_uuid string, target_node_uuid string, name string, fact string, tokens array<string>")
    names = spark.createDataFrame([("a", "Ann Lee"), ("b", "Acme")], "uuid string, name string")
    got = {r.uuid: r.tokens for r in search.search_tokens(f, names).collect()}
    assert got == {"1": ["works", "at", "ann", "works", "ann", "lee", "acme"], "2": ["likes", "爱猫", "ann", "lee"], "3": ["old"]}
    assert {r.uuid: r.tokens for r in search.search_tokens(f.drop("tokens")).collect()}["3"] == ["r", "kept"]


def test_nearest_vectors_by_signatures(spark):
    from factloom.operators import nearest
    from factloom.plans.queries import QUERIES

    got = QUERIES["vector_recall"](spark, "/root/testdata/sf0.1").collect()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").count()
    assert len(got) == rows // 50 and sum(r.met for r in got) >= 0.95 * sum(r.wanted for r in got) and all(r.wanted == 50 for r in got)
    assert sum(r.cosines for r in got) < 0.5 * rows * len(got)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.1]), (7, [1.0, 0.0])], "uuid long, embedding array<double>")
    own = nearest.with_signature(df, 2)
    asked = own.where("uuid in (1, 3)").withColumnRenamed("uuid", "query")
    found = [(r.query, r.uuid, r.position) for r in nearest.nearest(own, asked, 3, share=1.0).orderBy("position").collect()]
    assert found == [(1, 1, 1), (1, 7, 2), (1, 6, 3)] and nearest.nearest(own.limit(0), asked, 3).count() == 0
    bits = lambda v: [b for w in nearest.signature(v) for b in f"{w % 2**64:064b}"[::-1]]
    side = (nearest.planes(2).T @ [0.3, -0.7] > 0).astype(int)
    assert [int(b) for b in bits([0.3, -0.7])] == side.tolist()


def test_nearest_vectors_meet_in_blocks(spark):
    import numpy as np

    from factloom.operators import nearest

    drawn = np.random.default_rng(3).normal(size=(90, 8)).round(1)
    drawn[40:70] = drawn[0]  # a large group of copies
    own = nearest.with_signature(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn)], "uuid long, embedding array<double>"), 8).cache()
    asked = own.where("uuid % 10 = 0").withColumnRenamed("uuid", "query")
    units = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    cosines = np.round(units @ units.T, 9)
    want = {(q, int(u), p) for q in range(0, 90, 10) for p, u in enumerate(np.lexsort((np.arange(90), -cosines[q]))[:7], 1)}
    whole = nearest.nearest(own, asked, 7, share=1.0, in_rows=13, in_queries=4).collect()
    assert {(r.query, r.uuid, r.position) for r in whole} == want and {r.taken for r in whole} == {90}
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(nearest.nearest(own, asked, 7, in_rows=13, in_queries=4)) == plain(nearest.nearest(own, asked, 7))


def test_facts_and_entities_are_read_once(spark):
    from factloom.plans import queries
    from factloom.sources.project import Graph

    sf = "/root/testdata/sf0.001"
    reads = lambda df: sum("lineitem.parquet" in f for f in df.inputFiles())
    for name in ("graph_view_nodes", "retract_preview", "end_preview"):
        assert reads(queries.QUERIES[name](spark, sf)) == 0, name  # what several steps need was written once
    plan = queries._cited(Graph(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1  # episodes come with the lines


def test_tokens_of_long_texts_are_packed_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from factloom.functions import text as X

    texts = [None, "", "爱猫 Ann"] + ["ab cd " * 400] * 4 * X.TEXTS_AT_ONCE
    tracemalloc.start()
    got = X.tokenize.func(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.slice(0, 4).to_pylist() == [X.tokens_of(t) for t in texts[:4]] and len(got) == len(texts)
    assert X.tokenize.func(pa.array([], pa.string())).to_pylist() == [] and peak < 60 * 800 * 2 * X.TEXTS_AT_ONCE


def test_many_order_lines_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """No scan's task groups its lines: between scan and grouping there is a shuffle over tasks in proportion to the lines; rows are the same."""
    from factloom.sources import project

    folder = "/root/testdata/sf0.001"
    read = lambda g: (sorted(r.uuid for r in g.entities.collect()), sorted((r.uuid, r.valid_at) for r in g.supplies.collect()))
    want = read(project.Graph(spark, folder))
    monkeypatch.setattr(project, "LINES_A_TASK", 500)
    g = project.Graph(spark, folder)
    assert g.tasks == -(-g.table("lineitem").count() // 500) > 4
    for rows in (g.entities, g.supplies, g.lines):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert f", {g.tasks}" in "".join(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert read(g) == want


def test_many_order_lines_are_dealt_before_they_meet_orders(spark, monkeypatch):
    """Also where a shuffle has more partitions than the lines need: those would be put together up to a size."""
    from factloom.sources import project

    monkeypatch.setattr(project, "LINES_A_TASK", 500)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        g = project.Graph(spark, "/root/testdata/sf0.001")
        assert 4 < -(-g.table("lineitem").count() // 500) < 100
        plan = g.lines._jdf.queryExecution().optimizedPlan().toString()
        assert "".join(plan.split()).count("RepartitionByExpression") == 2 and plan.count("], 100") == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_an_index_reads_each_text_once(spark, tmp_path):
    """And its postings are counted in the task that has the text: no shuffle, no second pass for the lengths."""
    read = spark.sparkContext.accumulator(0)

    def split(text):
        read.add(1)
        return None if text is None else text.split()

    docs = spark.createDataFrame([(1, "x y x"), (2, ""), (3, None), (4, "z y")], "uuid long, text string")
    docs = docs.select("uuid", F.udf(split, "array<string>")("text").alias("tokens"))
    assert "Exchange" not in search.postings(docs, "uuid", "tokens")._jdf.queryExecution().executedPlan().toString()
    index = search.Index(spark, f"file://{tmp_path}/once").write(docs)
    assert read.value == 4
    assert sorted(index.postings().select("uuid", "dl", "term", "tf").collect()) == [(1, 3, "x", 2), (1, 3, "y", 1), (4, 2, "y", 1), (4, 2, "z", 1)]
    assert sorted((r.uuid, r.dl) for r in index.lengths().where("uuid <> 3").collect()) == [(1, 3), (2, 0), (4, 2)] and index.stats().first().n_docs == 4


def test_terms_are_counted_a_few_texts_at_a_time(monkeypatch):
    import random
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(3)
    lists = [None, [], ["a", None, "a"], *[[rng.choice("abcdeé") for _ in range(rng.randrange(12))] for _ in range(60)]]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(len(lists))]), pa.array(lists, pa.list_(pa.string()))], ["uuid", "tokens"])
    want = sorted((f"d{i}", len(t), w, n) for i, t in enumerate(lists) if t for w, n in Counter(x for x in t if x is not None).items())
    for most in (1, 7, 10**6):
        monkeypatch.setattr(search, "TOKENS_AT_ONCE", most)
        got = [r for b in search._count_terms(iter([batch.slice(0, 20), batch.slice(20), batch.slice(0, 0)])) for r in b.to_pylist()]
        flat = [(k, d, r["term"], n) for r in got for k, d, n in zip(r["keys"], r["dls"], r["tfs"], strict=True)]
        assert sorted(x for x in flat if x[2] is not None) == want
        assert [x[:2] for x in flat if x[2] is None] == [(f"d{i}", None if t is None else len(t)) for i, t in enumerate(lists)]
