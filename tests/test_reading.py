from datetime import datetime, timedelta

from factloom.functions.text import mentions
from factloom.ingest.fold import Entity, Episode, State, fold, hashed
from factloom.ingest.job import empty_state, fold_groups, next_state
from factloom.ingest.reading import Known
from factloom.streaming.ingest import StateTable, start

START = datetime(2024, 1, 1)
SCHEMA = "uuid string, group_id string, content string, valid_at timestamp_ntz, created_at timestamp_ntz"
TEXTS = ["Alice works at Acme", "Bob works at Globex", "She left", "Acme grows", "He joined Initech", "they both like Initech"]


def make_reader():
    def reader(text, told):
        """Reads "she" and "he" as the person whom a known fact is about: it can say nothing without what is known."""
        if text.startswith("they"):
            raise ValueError("whom?")
        found = {"entities": [], "facts": [], "invalidations": []}
        who = {"She": "Alice", "He": "Bob"}.get(text.split()[0])
        if who:
            mine = [f for f in told["known_facts"] if f["source_name"] == who and f["relation"] == "WORKS_AT"]
            found["invalidations"] = [{"source_name": who, "target_name": f["target_name"], "relation": "WORKS_AT", "invalid_at": None} for f in mine]
            if "joined" in text:
                new = text.split()[-1]
                found["entities"] = [{"name": who}, {"name": new, "labels": ["Firm"], "summary": "after " + ",".join(sorted(e["name"] for e in told["known_entities"]))}]
                found["facts"] = [{"source_name": who, "target_name": new, "relation": "WORKS_AT", "fact": f"{who} works at {new}"}]
        elif "works" in text:
            a, b = text.split(" works at ")
            found["entities"] = [{"name": x, "labels": ["Thing"]} for x in (a, b)]
            found["facts"] = [{"source_name": a, "target_name": b, "relation": "WORKS_AT", "fact": text}]
        return found

    return reader


def notes(spark):
    rows = [(str(k), "g", t, START + timedelta(days=k), START + timedelta(days=k)) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def check(rows):
    facts = {r.uuid: r for r in rows if r.kind == "fact"}
    end = lambda u: facts[u].row.split('"invalid_at": ')[1].split(",")[0].strip('"')
    assert {u: end(u)[:10] for u in facts} == {"0/f0": "2024-01-03", "1/f0": "2024-01-05", "4/f0": "null"}
    assert any("after Acme,Alice,Bob,Globex" in r.row for r in rows if r.kind == "entity")


def test_a_reader_that_needs_the_context_in_batch_and_stream(spark, tmp_path):
    reader = make_reader()
    changes = fold_groups(notes(spark).select("*"), empty_state(spark), reader=reader) if "payload" in notes(spark).columns else fold_groups(notes(spark).selectExpr("*", "cast(null as string) AS payload"), empty_state(spark), reader=reader)
    rows = changes.collect()
    check(rows)
    assert {r.uuid: r.status for r in rows if r.kind == "episode"} == {"0": "processed", "1": "processed", "2": "processed", "3": "processed", "4": "processed", "5": "failed"}
    table, source = StateTable(spark, f"file://{tmp_path}/state"), tmp_path / "in"
    for part in ("uuid < '2'", "uuid >= '2'"):
        notes(spark).where(part).coalesce(1).write.mode("append").parquet(str(source))
        start(spark.readStream.schema(SCHEMA).parquet(str(source)), table, f"file://{tmp_path}/log", f"file://{tmp_path}/check", reader=reader).awaitTermination(200)
    held = table.read().selectExpr("kind", "group_id", "row", "get_json_object(row, '$.uuid') AS uuid").collect()
    check(held)
    plain = lambda rows: sorted((r.kind, r.row) for r in rows)
    assert plain(held) == plain(next_state(empty_state(spark), changes).collect())


def test_names_found_by_token_are_those_found_by_looking_at_all():
    names = ["Acme", "Acme Corp", "AI", "GPT4", "阿里巴巴", "猫A", "Ann-Lee", "O'Neil", "3M", "C++", "..", "Łódź", "x"]
    state = State()
    for k, n in enumerate(names):
        state.entities[n.lower()] = Entity(str(k), n)
    known = Known(state, hashed)
    known.update()
    for text in ["the acme corp. of ANN-LEE", "said ai GPT4模型", "在阿里巴巴工作 黑猫A", "o'neil and 3M use C++ ..", "łódź x", "nothing", "", "Acmes"]:
        assert {e.name for e in known.named(text)} == {n for n in names if mentions(text.lower(), n.lower())}, text
    assert [e.name for e in known.named("acme corp acme")] == ["Acme Corp", "Acme"]


def test_what_is_told_has_bounds_and_only_live_facts():
    state = State()
    said = [{"source_name": "Hub", "target_name": f"T{k}", "relation": "uses", "fact": f"hub uses t{k}", "invalid_at": START + timedelta(days=1) if k % 2 else None, "valid_at": START} for k in range(300)]
    fold(state, [Episode("e", "x", START, START, [{"name": n, "labels": ["L"]} for n in ["Hub", *(f"T{k}" for k in range(300))]], said)])
    told = Known(state, hashed).told("Hub and T7, T12", START + timedelta(days=9), START + timedelta(days=9))
    assert [e["name"] for e in told["known_entities"][:3]] == ["Hub", "T12", "T7"] or [e["name"] for e in told["known_entities"][:3]] == ["T12", "Hub", "T7"]
    assert len(told["known_entities"]) == 3 + 50 and len(told["known_facts"]) == 50 and all(int(f["target_name"][1:]) % 2 == 0 for f in told["known_facts"])


def test_a_group_s_notes_are_read_as_a_stream(spark):
    def rows_held(content, told):
        """Says how many notes the largest table of notes in this worker has."""
        import gc

        import pandas as pd

        held = [len(x) for x in gc.get_objects() if isinstance(x, pd.DataFrame) and "content" in x.columns] if content.endswith("last") else [0]
        return {"entities": [{"name": f"Held {max(held)}", "labels": ["Thing"]}], "facts": [], "invalidations": []}

    rows = [(f"n{k:02}", "g", f"note {k} last" if k == 59 else f"note {k}") for k in range(60)]
    own = spark.createDataFrame(rows, "uuid string, group_id string, content string").selectExpr("*", "timestamp_ntz'2024-01-01' AS valid_at", "timestamp_ntz'2024-01-01' AS created_at", "cast(null as string) AS payload")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10")
    try:
        found = fold_groups(own, empty_state(spark), reader=rows_held).where("kind = 'entity'").selectExpr("get_json_object(row, '$.name') AS name").collect()
    finally:
        spark.conf.unset(key)
    assert {r.name for r in found} == {"Held 0", "Held 10"}
