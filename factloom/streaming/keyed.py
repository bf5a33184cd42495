"""Notes as a stream with keyed state: a note reads and writes the slots that it touches, in the executors' state stores."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from factloom.functions.text import idempotency_key, relation_of
from factloom.ingest.fold import Embed, Fact, Judge, State, hashed, opposites
from factloom.ingest.job import CHANGES, apply_notes, entity_of, entity_row, fact_of, fact_row, latest_rows, payloads, said_by, with_payload

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _slot(source: str, relation: str | None) -> str:
    return f"{source}\x00{relation_of(relation)}"


def _pair(a: str, b: str) -> str:
    return "\x00".join(sorted((a, b)))


def _low(name: str | None) -> str:
    return (name or "").strip().lower()


class Folding(StatefulProcessor):
    """A group's graph as maps in the state store; a batch loads the entities and slots that its notes name, and no others.

    entities: lower-case name to row. slots: source and relation to the numbers of
    its facts. pairs: two ends to the slots between them. facts: number to row. keys:
    the keys of notes. A fact's number is its place among the group's facts, so
    that those that are loaded keep their order.
    """

    def __init__(self, judge: Judge = opposites, embed: Embed = hashed):
        self.judge, self.embed = judge, embed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "facts bigint, changes bigint")
        self.entities = handle.getMapState("entities", "name string", "row string")
        self.slots = handle.getMapState("slots", "slot string", "numbers array<bigint>")
        self.pairs = handle.getMapState("pairs", "pair string", "slots array<string>")
        self.facts = handle.getMapState("facts", "number bigint", "row string")
        self.keys = handle.getMapState("keys", "key string", "seen boolean")

    @staticmethod
    def _get(state, key):
        return state.getValue((key,))[0] if state.containsKey((key,)) else None

    def _load(self, notes: pd.DataFrame) -> tuple[State, dict[str, int]]:
        """The part of the state that notes may read, with the number of each fact in it."""
        state, names, said = State(), set(), []
        for n in notes.itertuples():
            entities, facts, ends = said_by(n)
            said += facts + ends
            names |= {_low(e.get("name")) for e in entities} | {_low(r.get(k)) for r in facts + ends for k in ("source_name", "target_name")}
            if n.key is not None and self.keys.containsKey((n.key,)):
                state.keys.add(n.key)
        for name in sorted(names - {""}):
            raw = self._get(self.entities, name)
            if raw is not None:
                state.entities[name] = entity_of(raw)
        slots = set()
        for r in said:
            src, tgt = (state.entities.get(_low(r.get(k))) for k in ("source_name", "target_name"))
            if src is not None and tgt is not None:  # an end that is new has no facts yet
                slots |= {_slot(src.uuid, r.get("relation")), *(self._get(self.pairs, _pair(src.uuid, tgt.uuid)) or [])}
            elif src is not None:
                slots.add(_slot(src.uuid, r.get("relation")))
        numbers = sorted({int(k) for s in sorted(slots) for k in self._get(self.slots, s) or []})
        numbered = {}
        for k in numbers:
            f = fact_of(self._get(self.facts, k))
            state.add(f)
            numbered[f.uuid] = k
        return state, numbered

    def _keep(self, facts: list[Fact], numbered: dict[str, int], group: str, count: int) -> int:
        """Writes changed facts, and new ones with the next numbers and the slots and pairs that lead to them."""
        added: dict[str, list[int]] = {}
        for f in sorted(facts, key=lambda f: f.place):
            number = numbered.get(f.uuid)
            if number is None:
                number, count = count, count + 1
                slot, pair = _slot(f.source, f.name), _pair(f.source, f.target)
                added.setdefault(slot, []).append(number)
                known = list(self._get(self.pairs, pair) or [])
                if slot not in known:
                    self.pairs.updateValue((pair,), ([*known, slot],))
            self.facts.updateValue((number,), (json.dumps(fact_row(f, group), ensure_ascii=False),))
        for slot, new in added.items():
            self.slots.updateValue((slot,), ([int(k) for k in self._get(self.slots, slot) or []] + new,))
        return count

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group, notes = key[0], pd.concat(list(rows))
        state, numbered = self._load(notes)
        count, changes = self.counts.get() if self.counts.exists() else (0, 0)
        out, entities, facts = apply_notes(state, notes, group, self.judge, self.embed)
        count = self._keep(facts, numbered, group, count)
        self.counts.update((count, changes + 1))
        for e in entities:
            self.entities.updateValue((e.name.strip().lower(),), (json.dumps(entity_row(e, group), ensure_ascii=False),))
        for kind, _, seen, _, _ in out:
            if kind == "key":
                self.keys.updateValue((seen,), (True,))
        out += [("entity", group, e.uuid, json.dumps(entity_row(e, group), ensure_ascii=False), "") for e in entities]
        out += [("fact", group, f.uuid, json.dumps(fact_row(f, group), ensure_ascii=False), "") for f in facts]
        yield pd.DataFrame([(*r, changes) for r in out], columns=["kind", "group_id", "uuid", "row", "status", "n"])

    def close(self) -> None:
        pass


def folded(notes: DataFrame, judge: Judge = opposites, extractor=payloads, embed: Embed = hashed) -> DataFrame:
    """The stream of changes (kind, group_id, uuid, row, status, n) of a stream notes(uuid, group_id, content, valid_at, created_at).

    n counts a group's batches: of the rows of one id the one with the largest n is
    current. Notes are applied by (created_at, uuid) within a batch, and by what they
    say about time across batches; no watermark drops late ones, and no state is
    forgotten. A batch costs what its notes touch, not what the group holds.
    """
    notes.sparkSession.conf.set(PROVIDER, ROCKS)  # the only store with maps as state
    own = with_payload(notes, extractor).withColumn("key", idempotency_key(F.col("content"), F.col("valid_at")))
    own = own.select("uuid", "group_id", "content", "valid_at", "created_at", "payload", "key")
    return own.groupBy("group_id").transformWithStateInPandas(Folding(judge, embed), f"{CHANGES}, n long", "Append", "None")


def start_keyed(notes: DataFrame, log: str, checkpoint: str, judge: Judge = opposites, extractor=payloads, embed: Embed = hashed, available_now: bool = True) -> StreamingQuery:
    """A query that appends changes to a log of Parquet files; each batch is there whole or not at all, after a restart too."""
    writer = folded(notes, judge, extractor, embed).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    """The state (kind, group_id, row) that the log of a query has so far."""
    rows = spark.read.schema(f"{CHANGES}, n long").parquet(log)
    return latest_rows(rows.where("kind <> 'episode'").select("kind", "group_id", "row", "n"))


def drain(query: StreamingQuery, seconds: float = 60) -> bool:
    """Lets a query finish what has come in, for some seconds at most, then stops it; whether it had nothing left to do."""
    until = time.monotonic() + seconds
    while query.isActive and time.monotonic() < until:
        now = query.status
        if not (now["isDataAvailable"] or now["isTriggerActive"] or now["message"].startswith("Initializing")):
            break
        time.sleep(0.2)
    done = not query.isActive or not (query.status["isDataAvailable"] or query.status["isTriggerActive"])
    query.stop()
    return done
