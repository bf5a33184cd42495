"""The fold as a Spark job: groups in parallel, each group's notes in order."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import idempotency_key
from factloom.ingest.extract import extraction
from factloom.ingest.fold import Embed, Entity, Episode, Fact, Judge, Outcome, State, fold, hashed, opposites
from factloom.ingest.reading import Known, Reader
from factloom.operators.ranking import shared_folder

#: Rows that a task hands over at once.
ROWS_AT_ONCE = 2000
#: Texts whose vectors by the built-in embedder are kept; forgetting them only costs time.
KEPT_VECTORS = 50_000
CHANGES = "kind string, group_id string, uuid string, row string, status string"


as_json = json.JSONEncoder(ensure_ascii=False).encode
sorted_json = json.JSONEncoder(sort_keys=True).encode


def _time(value) -> datetime | None:
    if value is None or value is pd.NaT:
        return None
    if type(value) is datetime:
        return value
    return value.to_pydatetime() if type(value) is pd.Timestamp else datetime.fromisoformat(value) if isinstance(value, str) else pd.Timestamp(value).to_pydatetime()


def _text(value: datetime | None) -> str | None:
    return None if value is None else value.isoformat(timespec="milliseconds")


def _floats(vector) -> list[float] | None:
    return None if vector is None else vector.tolist() if isinstance(vector, array) and vector.typecode == "d" else [float(x) for x in vector]


def entity_row(e: Entity, group: str) -> dict:
    return {"uuid": e.uuid, "group_id": group, "name": e.name, "labels": e.labels, "summary": e.summary, "attributes": sorted_json(e.marks), "created_at": _text(e.created), "name_embedding": _floats(e.vector)}


def fact_row(f: Fact, group: str) -> dict:
    return {
        "uuid": f.uuid, "group_id": group, "source_node_uuid": f.source, "target_node_uuid": f.target, "name": f.name, "fact": f.text, "episodes": f.episodes,
        "valid_at": _text(f.valid), "invalid_at": _text(f.invalid), "created_at": _text(f.created), "expired_at": _text(f.expired), "attributes": sorted_json(f.marks), "fact_embedding": _floats(f.vector),
    }


def entity_of(raw: str) -> Entity:
    r = json.loads(raw)
    return Entity(r["uuid"], r["name"], r.get("labels") or [], r.get("summary") or "", json.loads(r.get("attributes") or "{}"), _time(r.get("created_at")), r.get("name_embedding"))


def fact_of(raw: str) -> Fact:
    r = json.loads(raw)
    times = (_time(r.get(k)) for k in ("valid_at", "invalid_at", "created_at", "expired_at"))
    return Fact(r["uuid"], r["source_node_uuid"], r["target_node_uuid"], r["name"], r["fact"], r.get("episodes") or [], *times, json.loads(r.get("attributes") or "{}"), r.get("fact_embedding"))


def read_row(state: State, kind: str, raw: str) -> None:
    if kind == "entity":
        e = entity_of(raw)
        state.entities[e.name.lower()] = e
    elif kind == "fact":
        state.add(fact_of(raw))
    elif kind == "key":
        state.keys.add(json.loads(raw)["key"])


def read_state(rows: pd.DataFrame) -> State:
    state = State()
    for kind, raw in zip(rows["kind"], rows["row"], strict=True):
        read_row(state, kind, raw)
    return state


def said_by(note, found: dict | None = None) -> tuple[list[dict], list[dict], list[dict]]:
    """(entities, statements, endings) of a note's payload, or of what a reader found."""
    found = json.loads(note.payload or "{}") if found is None else found
    for r in found.get("facts", []) + found.get("invalidations", []):
        for k in ("valid_at", "invalid_at"):
            r[k] = _time(r.get(k))
    return found.get("entities", []), found.get("facts", []), found.get("invalidations", [])


class Folding:
    """A group's notes on their way into its state, one at a time, and the entities and facts that they made or changed.

    With a reader, each note is read when its turn comes, by one who is told what
    the notes before it have made known; a note that cannot be read has failed.
    """

    def __init__(self, state: State, group: str, judge: Judge, embed: Embed = hashed, reader: Reader | None = None):
        self.state, self.group, self.judge, self.embed, self.reader = state, group, judge, embed, reader
        self.known = Known(state, embed) if reader is not None else None
        self.entities: dict[str, Entity] = {}
        self.facts: dict[str, Fact] = {}
        self.shared: set[str] = set()

    def share(self, id: str, name: str, created: datetime) -> None:
        """An entity is known from here on that other parts of the group name too; what becomes of it is told elsewhere."""
        self.shared.add(id)
        held = self.state.entities.setdefault(name.lower(), Entity(id, name, created=created))
        if held.uuid != id:
            raise ValueError(f"{name} is {held.uuid}, not {id}")

    def apply(self, n) -> list[tuple]:
        """The rows of a note's outcome and of its key."""
        note = Episode(n.uuid, n.content or "", _time(n.valid_at), _time(n.created_at), key=n.key)
        try:
            if self.known is None:
                found = None
            elif n.key is not None and n.key in self.state.keys:
                found = {}  # a duplicate is not read
            else:
                found = self.reader(note.content, self.known.told(note.content, note.valid, note.created))
            note.entities, note.facts, note.ends = said_by(n, found)
            outcome: Outcome = fold(self.state, [note], self.judge, embed=self.embed)[0]
        except Exception as error:
            outcome = Outcome(status="failed", error=str(error)[:500])
        if self.known is not None:
            self.known.changed(outcome.reinforced + outcome.invalidated)
        counts = {"facts": len(outcome.facts), "reinforced": len(outcome.reinforced), "invalidated": len(outcome.invalidated), "entities": len(outcome.entities), **{f"dropped_{k}": v for k, v in outcome.dropped.items()}, "error": outcome.error}
        rows = [("episode", self.group, n.uuid, json.dumps(counts), outcome.status)]
        if outcome.status == "processed":
            rows.append(("key", self.group, n.key, json.dumps({"key": n.key}), outcome.status))
        self.facts.update((f.uuid, f) for f in outcome.facts + outcome.reinforced + outcome.invalidated)
        self.entities.update((e.uuid, e) for e in outcome.entities)
        return rows

    def changed(self) -> Iterator[tuple]:
        """The rows of the entities and facts, as they are after all notes."""
        for e in (e for e in self.entities.values() if e.uuid not in self.shared):
            yield "entity", self.group, e.uuid, as_json(entity_row(e, self.group)), ""
        for f in self.facts.values():
            yield "fact", self.group, f.uuid, as_json(fact_row(f, self.group)), ""


def apply_notes(state: State, notes: pd.DataFrame, group: str, judge: Judge, embed: Embed = hashed, reader: Reader | None = None) -> tuple[list[tuple], list[Entity], list[Fact]]:
    """Folds a group's notes by (created_at, uuid): the rows of episodes and keys, and the entities and facts that were made or changed."""
    folding = Folding(state, group, judge, embed, reader)
    rows = [row for n in notes.sort_values(["created_at", "uuid"]).itertuples() for row in folding.apply(n)]
    return rows, list(folding.entities.values()), list(folding.facts.values())


def payloads(content: Column) -> Column:
    """What the built-in extractor finds, as JSON, in whole-stage code."""
    return F.to_json(extraction(content))


def batched(embed: Callable[[list[str]], list], batch: int = 256) -> Callable[[Column], Column]:
    """An embedder over lists of texts, such as a remote service, as a column function: whole batches, one client a task."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out = part.tolist(), []
            for k in range(0, len(texts), batch):
                found = embed([t or "" for t in texts[k : k + batch]])
                if len(found) != len(texts[k : k + batch]):
                    raise ValueError("an embedder gives one vector for each text")
                out += found
            yield pd.Series(out, index=part.index, dtype=object)

    return run


def with_payload(episodes: DataFrame, extractor: Callable[[Column], Column] = payloads) -> DataFrame:
    """Adds payload: what an extractor (a text column to JSON) finds; it needs no state, so every row runs in parallel."""
    return episodes.withColumn("payload", extractor(F.col("content")))


SAID = "struct<entities:array<struct<name:string>>,facts:array<struct<fact:string>>>"


def staged_vectors(episodes: DataFrame, embed: Embed) -> tuple[DataFrame, int | None]:
    """(group_id, text, vector) of every statement and name in episodes(group_id, payload), and the vectors' length.

    Each distinct text is embedded once, in batches and in parallel, and written
    to the shared folder; vectors of more than one length, or none, raise before
    anything else is written.
    """
    said = F.from_json("payload", SAID)
    texts = F.concat(F.coalesce(F.transform(said["facts"], lambda f: F.trim(f["fact"])), F.array()), F.coalesce(F.transform(said["entities"], lambda e: F.trim(e["name"])), F.array()))
    wanted = episodes.select("group_id", F.explode(texts).alias("text")).where("text <> ''").distinct()
    path = shared_folder(episodes.sparkSession, "vectors")
    wanted.select("text").distinct().select("text", batched(embed)("text").alias("vector")).write.parquet(path)
    vectors = episodes.sparkSession.read.schema("text string, vector array<double>").parquet(path)
    least, most = vectors.agg(F.min(F.coalesce(F.size("vector"), F.lit(0))), F.max(F.size("vector"))).first()
    if least != most or least == 0:
        raise ValueError(f"vectors of {least} to {most} numbers: an embedder gives one length")
    return wanted.join(vectors, "text"), most


def fold_groups(episodes: DataFrame, state: DataFrame, judge: Judge = opposites, embed: Embed | None = None, reader: Reader | None = None) -> DataFrame:
    """(kind, group_id, uuid, row, status): all rows that the notes made or changed, and each note's outcome.

    episodes(uuid, group_id, content, valid_at, created_at, payload) are applied
    by (created_at, uuid) within their group; state(kind, group_id, row) has the
    group's entities, facts and keys as JSON. The order within a group carries
    meaning, so a group is one task; groups run in parallel. Spark sorts a group's
    state and notes, and the task reads them as a stream: what it holds is the
    group's state, not its notes nor their outcomes.

    With an embedder, which may be a remote service, the job has two phases: all
    texts are embedded first, see staged_vectors(), and only then are notes
    folded, so that one that fails has changed nothing. Rows are given their
    vectors; those of another length, of an older model, that a note touches are
    embedded again. Without, texts are compared by the built-in embedder.

    With a reader, payloads are not needed: it reads each note in its turn, told
    the known entities and facts that the note is about, see Known.
    """
    dims = None
    if embed is not None:
        staged, dims = staged_vectors(episodes, embed) if reader is None else (None, None)
    if embed is not None and reader is None:  # what a reader will say is not known yet: it is embedded note by note
        state = state.select("kind", "group_id", "row").unionByName(staged.select(F.lit("vector").alias("kind"), "group_id", F.to_json(F.struct("text", "vector")).alias("row")))
    keyed = episodes.withColumn("key", idempotency_key(F.col("content"), F.col("valid_at")))
    own = keyed.select("group_id", "created_at", "uuid", "content", "valid_at", "payload", "key")
    held = state.select("group_id", "kind", "row").where("kind is not null")
    return folded(own.unionByName(held, allowMissingColumns=True), judge, embed, reader, dims)


def folded(rows: DataFrame, judge: Judge, embed: Embed | None = None, reader: Reader | None = None, dims: int | None = None, tasks: int | None = None) -> DataFrame:
    """CHANGES by notes (kind is null) and the rows of state, vectors and shared entities of their groups.

    Rows with a part are folded by group and part; an entity that parts share is
    known after the note that made it, whose created_at and uuid its row has.
    """

    def started(group: str, given: dict) -> Folding:
        state = State()
        state.dims = dims

        def vectors(texts: list[str]) -> list:
            rest = [t for t in dict.fromkeys(texts) if t not in given]
            if embed is None and len(given) + len(rest) > KEPT_VECTORS:
                given.clear()
                rest = list(dict.fromkeys(texts))
            given.update(zip(rest, (array("d", v) for v in (embed or hashed)(rest)), strict=True) if rest else ())
            return [given[t] for t in texts]

        return Folding(state, group, judge, vectors, reader)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = lambda rows: pd.DataFrame(rows, columns=["kind", "group_id", "uuid", "row", "status"])
        rows: list[tuple] = []
        for row in changes(n for frame in frames for n in frame.itertuples(index=False)):
            rows.append(row)
            if len(rows) >= ROWS_AT_ONCE:
                yield packed(rows)
                rows = []
        yield packed(rows)

    def changes(sorted_: Iterator) -> Iterator[tuple]:
        folding, at, given = None, None, {}
        for n in sorted_:
            if folding is None or at != (n.group_id, n.part):
                if folding is not None:
                    yield from folding.changed()
                given = given if embed is None else {}  # a group's own vectors; those by the built-in embedder are anyone's
                folding, at = started(n.group_id, given), (n.group_id, n.part)
            if n.kind == "vector":
                said = json.loads(n.row)
                given[said["text"]] = array("d", said["vector"])
            elif n.kind == "shared":
                folding.share(**json.loads(n.row), created=_time(n.created_at))
            elif n.kind is not None:
                read_row(folding.state, n.kind, n.row)
            else:
                yield from folding.apply(n)
        if folding is not None:
            yield from folding.changed()

    for name in ("kind", "row", "part"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit("" if name == "part" else None).cast("string"))
    rows = rows.withColumn("turn", (F.col("kind").isNull() | (F.col("kind") == "shared")).cast("int"))
    order = [F.col(c).asc_nulls_last() for c in ("created_at", "uuid")]
    dealt = rows.repartition(*([tasks] if tasks else []), "group_id", "part").sortWithinPartitions("group_id", "part", "turn", *order, F.col("kind").asc_nulls_first())
    return dealt.mapInPandas(run, CHANGES)


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], "kind string, group_id string, row string")


def latest_rows(rows: DataFrame) -> DataFrame:
    """Of rows(kind, group_id, row, n) the one with the largest n of each kind and id."""
    ids = F.when(F.col("kind") == "key", F.get_json_object("row", "$.key")).otherwise(F.get_json_object("row", "$.uuid"))
    return rows.withColumn("id", ids).groupBy("kind", "group_id", "id").agg(F.max_by("row", "n").alias("row")).select("kind", "group_id", "row")


def next_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after changes: the latest row of each kind and id."""
    old = state.select("kind", "group_id", "row", F.lit(0).alias("n"))
    return latest_rows(old.unionByName(changes.where("kind <> 'episode'").select("kind", "group_id", "row", F.lit(1).alias("n"))))


def rows_of(changes: DataFrame, kind: str, schema) -> DataFrame:
    """The rows of one kind as columns of a table's schema."""
    own = changes.where(F.col("kind") == kind)
    return own.select(F.from_json("row", schema, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}).alias("r")).select("r.*")
