"""The ordered fold of a group's notes into its entities and facts; no Spark here.

A note (episode) comes with what was extracted from it: entities, statements and
terminations. fold() applies the notes of one group in order to the group's
state and returns the state; what a note changed is in its Outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np

from factloom.functions.text import SINGLE_VALUED, is_literal_name, mentions, relation_of
from factloom.functions.vectors import cosine_of, hash_vector
from factloom.ingest.shelf import Shelf

DAY, TICK = timedelta(days=1), timedelta(milliseconds=1)
#: Texts this near are a paraphrase of one statement; repeats within one note must be nearer.
PARAPHRASE, REPEAT = 0.92, 0.95
REASON_CHARS, DIMS = 120, 64

Judge = Callable[[dict, Sequence[dict]], object]
Embed = Callable[[list[str]], Sequence[Sequence[float]]]


@dataclass
class Entity:
    uuid: str
    name: str
    labels: list[str] = field(default_factory=list)
    summary: str = ""
    marks: dict = field(default_factory=dict)
    created: datetime | None = None
    vector: Sequence[float] | None = None


@dataclass
class Fact:
    uuid: str
    source: str
    target: str
    name: str
    text: str
    episodes: list[str]
    valid: datetime | None = None
    invalid: datetime | None = None
    created: datetime | None = None
    expired: datetime | None = None
    marks: dict = field(default_factory=dict)
    vector: Sequence[float] | None = None
    place: int = -1

    @property
    def withdrawn(self) -> bool:
        if self.invalid is None:
            return self.expired is not None
        return self.valid is not None and self.invalid <= self.valid

    def covers(self, t: datetime) -> bool:
        return (self.valid is None or self.valid <= t) and (self.invalid is None or t < self.invalid)

    def active(self, at: datetime, as_of: datetime) -> bool:
        if self.created is not None and self.created > as_of or self.valid is not None and self.valid > at:
            return False
        if self.invalid is not None:
            known = self.expired or self.created
            return not (self.invalid <= at and (known is None or known <= as_of))
        return not (self.expired is not None and self.expired <= as_of)

    def live(self, now: datetime) -> bool:
        return self.active(now, now) or (self.valid is not None and self.valid > now and self.active(self.valid, now))


@dataclass
class Episode:
    uuid: str
    content: str
    valid: datetime
    created: datetime
    entities: list[dict] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)
    ends: list[dict] = field(default_factory=list)
    key: str | None = None
    status: str = "pending"


class State:
    """A group's entities by lower-case name, its facts on shelves, and the keys of its notes.

    A shelf has the facts of a slot (source and relation), of a pair of ends, or of
    a statement (slot and target), and finds those of a window without a look at
    the others. A statement touches one of each, so what it costs follows the facts
    that hold around its window, not those that its entities or its slot ever had.
    """

    def __init__(self) -> None:
        self.entities: dict[str, Entity] = {}
        self.facts: list[Fact] = []
        self.shelves: dict[object, Shelf] = {}
        self.keys: set[str] = set()
        self.dims: int | None = None

    @staticmethod
    def kept_at(f: Fact) -> tuple:
        relation = relation_of(f.name)
        return (f.source, relation), frozenset((f.source, f.target)), (f.source, relation, f.target)

    def add(self, f: Fact) -> None:
        f.place = len(self.facts)
        self.facts.append(f)
        if f.vector and self.dims is None:
            self.dims = len(f.vector)
        for key in self.kept_at(f):
            if key not in self.shelves:
                self.shelves[key] = Shelf(self.facts)
            self.shelves[key].add(f.place)

    def revectored(self, f: Fact) -> None:
        shelf = self.shelves[self.kept_at(f)[2]]
        shelf.filled = min(shelf.filled, shelf.places.index(f.place)) if shelf.filled else 0

    def drop_last(self) -> None:
        f = self.facts[-1]
        for key in self.kept_at(f):
            self.shelves[key].drop_last()
        self.facts.pop()

    def moved(self, f: Fact) -> None:
        for key in self.kept_at(f):
            self.shelves[key].moved(f.place)

    def slot(self, source: str, relation: str) -> Shelf:
        return self.shelves.get((source, relation)) or Shelf(self.facts)

    def pair(self, ends: frozenset) -> Shelf:
        return self.shelves.get(ends) or Shelf(self.facts)

    def statement(self, source: str, relation: str, target: str) -> Shelf:
        return self.shelves.get((source, relation, target)) or Shelf(self.facts)


class Seen(Sequence):
    """Some facts by their places, each looked up when it is asked for."""

    def __init__(self, facts: list[Fact], places: np.ndarray, view: Callable[[Fact], object] = lambda f: f):
        self.facts, self.places, self.view = facts, places, view

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, k):
        return [self.view(self.facts[p]) for p in self.places[k].tolist()] if isinstance(k, slice) else self.view(self.facts[int(self.places[k])])


class Journal:
    """What a note has changed, so that one that fails leaves nothing behind."""

    def __init__(self, state: State) -> None:
        self.state = state
        self.before: dict[int, tuple[object, dict]] = {}
        self.named: list[str] = []
        self.first = len(state.facts)  # the place of the note's first own fact

    def touch(self, x: Entity | Fact) -> None:
        if id(x) not in self.before:
            self.before[id(x)] = (x, {**x.__dict__, "marks": dict(x.marks)})

    def undo(self) -> None:
        while len(self.state.facts) > self.first:
            self.state.drop_last()
        for x, held in self.before.values():
            x.__dict__.update(held)
            if isinstance(x, Fact) and 0 <= x.place < self.first:
                self.state.moved(x)
        for name in self.named:
            self.state.entities.pop(name, None)


@dataclass
class Claim:
    """A statement between two known entities, with its window."""

    src: Entity
    tgt: Entity
    relation: str
    text: str
    valid: datetime | None
    invalid: datetime | None
    dated: bool  # the start is only the note's date
    replaces: bool

    @property
    def ends(self) -> frozenset:
        return frozenset((self.src.uuid, self.tgt.uuid))

    @property
    def moment(self) -> datetime:
        return self.valid if self.valid is not None else self.invalid - TICK


@dataclass
class Outcome:
    status: str = "processed"
    entities: list[Entity] = field(default_factory=list)
    facts: list[Fact] = field(default_factory=list)
    reinforced: list[Fact] = field(default_factory=list)
    invalidated: list[Fact] = field(default_factory=list)
    dropped: dict[str, int] = field(default_factory=lambda: {"entities": 0, "facts": 0, "invalidations": 0})
    error: str | None = None


def sooner(*ends: datetime | None) -> datetime | None:
    return min((e for e in ends if e is not None), default=None)


def window(start: datetime | None, end: datetime | None, noted: datetime) -> tuple[datetime | None, datetime | None, bool]:
    """(valid, invalid, the start is only the note's date)."""
    if start is None:
        return (None, end, False) if end is not None and end <= noted else (noted, end, True)
    if end is None or end > start:
        return start, end, False
    return (start, start + DAY, False) if end == start else (None, end, False)


def never(statement: dict, shown: Sequence[dict]) -> list[int]:
    return []


def opposites(statement: dict, shown: Sequence[dict]) -> list[int]:
    """The built-in judge: one text joins or likes where the other has left or hates."""
    pairs = (("joins", "left"), ("likes", "hates"))
    against = [b for pair in pairs for a, b in (pair, pair[::-1]) if a in statement["fact"]]
    return [i for i, old in enumerate(shown) if any(b in old["fact"] for b in against)] if against else []


def verdict(answer: object, shown: Sequence[Fact]) -> tuple[list[Fact], list[Fact] | None]:
    """(ended, restated or None): from {"ended", "same"}, a list of places, or a boolean for all."""
    pick = lambda places: [shown[i] for i in dict.fromkeys(places or []) if isinstance(i, int) and not isinstance(i, bool) and 0 <= i < len(shown)]
    if isinstance(answer, dict):
        return pick(answer.get("ended")), pick(answer["same"]) if isinstance(answer.get("same"), list) else None
    if isinstance(answer, bool):
        return list(shown) if answer else [], None
    return pick(answer) if isinstance(answer, (list, tuple)) else [], None


def without(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    return places[~np.isin(places, others)] if len(places) and len(others) else places


def among(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    return places[np.isin(places, others)] if len(places) and len(others) else places[:0]


class Note:
    """One note on its way into a group's state."""

    def __init__(self, state: State, episode: Episode, judge: Judge, now: datetime, embed: Embed, journal: Journal | None = None):
        self.state, self.episode, self.judge, self.now, self.embed = state, episode, judge, now, embed
        self.journal = journal or Journal(state)
        self.out = Outcome()
        self.fresh: set[str] = set()
        self.met: set[str] = set()
        self.undated = abs(episode.valid - episode.created) < DAY
        self.vectors: dict[str, Sequence[float]] = {}
        self.supported: set[int] = set()
        self.closed: set[int] = set()

    # what is being said

    def stage(self, texts: Iterable[str]) -> None:
        """Embeds texts together; an embedder that fails, or does not give a vector for each, fails the note."""
        new = [t for t in dict.fromkeys(texts) if t not in self.vectors]
        if not new:
            return
        found = list(self.embed(new))
        if len(found) != len(new):
            raise ValueError("an embedder gives one vector for each text")
        self.vectors.update(zip(new, found, strict=True))

    def vector(self, text: str) -> Sequence[float]:
        if text not in self.vectors:
            self.stage([text])
        return self.vectors[text]

    def vector_of(self, f: Fact) -> Sequence[float]:
        if not f.vector:
            f.vector = self.vector(f.text)
        return f.vector

    def near(self, a: str, b: str, least: float) -> bool:
        return a == b or cosine_of(self.vector(a), self.vector(b)) >= least

    def alike(self, claim: Claim, places: np.ndarray) -> np.ndarray:
        """Which of some places of a statement's shelf say the same as a claim."""
        if not len(places):
            return np.zeros(0, bool)
        shelf = self.state.statement(claim.src.uuid, claim.relation, claim.tgt.uuid)
        return shelf.alike(places, claim.text, self.vector(claim.text), PARAPHRASE, self.vector_of)

    def repair(self) -> None:
        """All vectors of what the note has touched, of one length: those of another model's length are made anew.

        It comes last and writes nothing before every text is embedded; a length that
        still differs fails the note, which then has changed nothing.
        """
        facts, entities = [*self.out.facts, *self.out.reinforced, *self.out.invalidated], self.out.entities
        dims = self.state.dims or next((len(v) for v in self.vectors.values() if len(v)), None)
        stale = lambda x: dims is not None and bool(x.vector) and len(x.vector) != dims or not x.vector
        old = [(f, f.text) for f in facts if stale(f)] + [(e, e.name) for e in entities if stale(e)]
        if old:
            self.stage(text for _, text in old)
        for x, text in old:
            given = self.vectors[text]
            if dims is not None and len(given) and len(given) != dims:
                raise ValueError(f"the graph has vectors of {dims} numbers, the embedder gives {len(given)}")
            self.journal.touch(x)
            x.vector = given
            if isinstance(x, Fact):
                self.state.revectored(x)
        if self.state.dims is None:
            self.state.dims = dims

    def entity(self, name: str | None) -> Entity | None:
        return self.state.entities.get((name or "").strip().lower())

    def apply(self) -> Outcome:
        said, ended = self.episode.facts, self.episode.ends
        names = lambda rows: {(r.get(k) or "").strip().lower() for r in rows for k in ("source_name", "target_name")}
        endpoints = names(said)
        related = endpoints | names(ended)
        for given in self.episode.entities:
            self.meet(given, endpoints, related)
        self.plans: list[Claim] = []
        for s in said:
            src, tgt = self.entity(s.get("source_name")), self.entity(s.get("target_name"))
            if src is None or tgt is None:
                self.out.dropped["facts"] += 1
                continue
            relation = relation_of(s.get("relation"))
            text = (s.get("fact") or "").strip() or f"{src.name} {relation} {tgt.name}"
            self.plans.append(Claim(src, tgt, relation, text, *window(s.get("valid_at"), s.get("invalid_at"), self.episode.valid), bool(s.get("replaces_previous"))))
        self.forget_literals()
        self.stage([c.text for c in self.plans] + [e.name for e in self.out.entities if not e.vector])  # every vector before any change of a fact
        for e in ended:
            self.terminate(e, only_outdated=True)
        for claim in self.distinct():
            self.settle(claim)
        for e in ended:
            self.terminate(e)
        self.out.facts = self.state.facts[self.journal.first :]
        self.repair()
        return self.out

    def meet(self, given: dict, endpoints: set[str], related: set[str]) -> None:
        name = (given.get("name") or "").strip()
        if not name:
            return
        low, summary, labels = name.lower(), (given.get("summary") or "").strip(), list(given.get("labels") or [])
        known = self.state.entities.get(low)
        if known is None:
            if not (summary or labels or low in endpoints):
                return
            marks = {"createdByEpisode": self.episode.uuid} | ({"summaryByEpisode": self.episode.uuid} if summary else {})
            known = Entity(f"{self.episode.uuid}/e{len(self.fresh)}", name, labels, summary, marks, self.now)
            self.state.entities[low] = known
            self.journal.named.append(low)
            self.fresh.add(low)
        else:
            if low not in related and not mentions(self.episode.content, name):
                return
            self.journal.touch(known)
            known.labels = list(dict.fromkeys([*known.labels, *labels]))
            owner = known.marks.get("summaryByEpisode")
            if summary and owner != self.episode.uuid and (summary != known.summary or owner is not None):
                known.marks |= {"summaryByEpisode": self.episode.uuid, "previousSummary": known.summary}
            known.summary = summary or known.summary
        if known.uuid not in self.met:
            self.met.add(known.uuid)
            self.out.entities.append(known)

    def forget_literals(self) -> None:
        used = {e.uuid for c in self.plans for e in (c.src, c.tgt)}
        idle = [e for e in self.out.entities if e.uuid not in used and is_literal_name(e.name)]
        gone = {e.uuid for e in idle}
        self.out.entities = [e for e in self.out.entities if e.uuid not in gone]
        for e in idle:
            self.out.dropped["entities"] += 1
            if e.name.lower() in self.fresh:
                self.fresh.discard(e.name.lower())
                del self.state.entities[e.name.lower()]

    def distinct(self) -> list[Claim]:
        """Statements of the note without those it makes twice of one pair under two relation names."""
        kept: list[Claim] = []
        told: dict[tuple, list[Claim]] = {}
        for c in self.plans:
            rivals = told.setdefault((c.src.uuid, c.tgt.uuid, c.valid, c.invalid), [])
            if not any(k.relation != c.relation and self.near(k.text, c.text, REPEAT) for k in rivals):
                rivals.append(c)
                kept.append(c)
        return kept

    # changes

    def is_own(self, f: Fact) -> bool:
        return f.place >= self.journal.first

    def close(self, f: Fact, at: datetime, reason: str) -> None:
        again = f.place in self.closed
        self.journal.touch(f)
        before = f.marks.get("previousEnd") if again else f.invalid and f.invalid.isoformat()
        f.invalid = at
        if not self.is_own(f):
            f.expired = self.now
            f.marks = {k: v for k, v in f.marks.items() if k not in ("closedByEpisode", "previousEnd")}
            f.marks |= {"invalidatedBy": reason[:REASON_CHARS], "closedByEpisode": self.episode.uuid} | ({"previousEnd": before} if before else {})
            if not again:
                self.closed.add(f.place)
                self.out.invalidated.append(f)
        self.state.moved(f)

    def ends_where(self, f: Fact, at: datetime) -> datetime | None:
        """Where a change at `at` ends f; None if f begins later or is over by then."""
        if f.invalid is not None and f.invalid <= at or f.valid is not None and f.valid > at:
            return None
        if f.valid is None or f.valid < at:
            return at
        end = max(self.episode.valid, f.valid + TICK) if self.episode.valid > f.valid else f.valid + TICK
        return None if f.invalid is not None and f.invalid <= end else end

    def support(self, f: Fact, end: datetime | None, text: str) -> None:
        if not self.is_own(f):
            self.journal.touch(f)
            if self.episode.uuid not in f.episodes:
                f.episodes = [*f.episodes, self.episode.uuid]
            if f.place not in self.supported:
                self.supported.add(f.place)
                self.out.reinforced.append(f)
        if end is not None and f.invalid is None and (f.valid is None or end > f.valid):
            self.close(f, end, f"ended per: {text}")

    def settle(self, claim: Claim) -> None:
        """Finds what a statement means for its slot: support for a record that is there, or a new one.

        The cases are tried in order, and the first that names a record decides. What
        holds at the statement's moment, and what begins next, are all that is read.
        """
        facts, records = self.state.facts, self.state.statement(claim.src.uuid, claim.relation, claim.tgt.uuid)
        holding = records.holding(claim.moment, claim.dated)
        same = self.alike(claim, holding)
        place = int(holding[same.argmax()]) if same.any() else self.begun_sooner(claim, records)
        if place is None:
            ended, shown, named = self.asked(claim)
            stored = holding[(holding < self.journal.first) & ~same]  # true then, in other words
            apart = without(stored, ended)
            told = without(among(apart, shown), named) if named is not None else apart[:0]
            rest = without(apart, told)
            if not len(rest):
                self.record(claim, records, ended, told)
                return
            place = int(rest[0])
        self.support(facts[place], claim.invalid, claim.text)

    def begun_sooner(self, claim: Claim, records: Shelf) -> int | None:
        """The next record, with its start moved back, if it says the same and the slot has not turned in between."""
        place = records.following(claim.valid) if claim.valid is not None else None
        if place is None:
            return None
        later = self.state.facts[place]
        if claim.invalid is not None and claim.invalid < later.valid or not self.alike(claim, np.array([place]))[0]:
            return None
        if self.state.slot(claim.src.uuid, claim.relation).ends_within(claim.valid, later.valid, place):
            return None
        self.journal.touch(later)
        later.valid = claim.valid
        later.marks = {k: v for k, v in later.marks.items() if k != "startFromEpisode"} | self.start_mark(claim)
        self.state.moved(later)
        return place

    def start_mark(self, claim: Claim) -> dict:
        return {"startFromEpisode": True} if claim.dated and self.undated else {}

    def record(self, claim: Claim, records: Shelf, ended: np.ndarray, beside: np.ndarray) -> None:
        """A new fact; what it replaces ends where it begins, and it ends where something later begins."""
        facts = self.state.facts
        place = records.following(claim.valid) if claim.valid is not None else None
        end = sooner(claim.invalid, facts[place].valid if place is not None else None, records.least_end(beside))
        for old in (facts[k] for k in ended.tolist()):
            if old.valid is not None and old.valid > claim.valid:
                end = sooner(end, old.valid)
            elif (at := self.ends_where(old, claim.valid)) is not None:
                end = sooner(end, old.invalid)
                self.close(old, at, f"superseded by: {claim.text}")
        marks = ({"replacesPrevious": True} if claim.replaces else {}) | self.start_mark(claim)
        uuid = f"{self.episode.uuid}/f{len(facts) - self.journal.first}"
        vector = self.vector(claim.text)
        self.state.add(Fact(uuid, claim.src.uuid, claim.tgt.uuid, claim.relation, claim.text, [self.episode.uuid], claim.valid, end, self.now, None, marks, vector))

    def asked(self, claim: Claim) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ended, shown, same): places of what the judge says of the stored facts that a statement may end or repeat.

        It is shown facts of the same pair, and where the slot has one value at a
        time, its other values; none that says the same, and none that is over.
        """
        none = np.empty(0, np.int64)
        if claim.valid is None:
            return none, none, None
        single = claim.replaces or claim.relation in SINGLE_VALUED
        state, target = self.state, claim.tgt.uuid
        pair = state.pair(claim.ends).open_to(claim.valid, self.now)
        others = state.slot(claim.src.uuid, claim.relation).open_to(claim.valid, self.now, newer=not single, other_than=target)
        own = state.statement(claim.src.uuid, claim.relation, target).open_to(claim.valid, self.now)
        again = own[self.alike(claim, own)]
        pair = without(pair, again)
        shown = np.union1d(pair, others) if len(pair) and len(others) else pair if len(pair) else others
        shown = shown[shown < self.journal.first]
        if not len(shown):
            return none, none, None
        question = {"source_name": claim.src.name, "target_name": claim.tgt.name, "fact": claim.text, "relation": claim.relation, "valid_at": claim.valid, "replaces_previous": claim.replaces}
        view = Seen(state.facts, shown, lambda f: {"fact": f.text, "valid_at": f.valid, "invalid_at": f.invalid})
        ended, same = verdict(self.judge(question, view), Seen(state.facts, shown))
        places = lambda found: np.array([f.place for f in found], np.int64)
        return places(ended), shown, None if same is None else places(same)

    def terminate(self, said: dict, only_outdated: bool = False) -> None:
        """An end that the text states: it closes what still held then, and never makes a fact."""
        src, tgt = self.entity(said.get("source_name")), self.entity(said.get("target_name"))
        if src is None or tgt is None:
            self.out.dropped["invalidations"] += not only_outdated
            return
        stated, pair = said.get("invalid_at"), frozenset((src.uuid, tgt.uuid))
        end = stated or self.episode.valid
        reason = said.get("reason") or self.episode.content[:REASON_CHARS]
        relation = relation_of(said["relation"]) if said.get("relation") else None
        stint = any(c.ends == pair and c.relation == relation and c.invalid is not None and stated is not None and c.invalid <= stated for c in self.plans)
        outdates = stated is not None and relation is not None and not stint
        for f in Seen(self.state.facts, self.state.pair(pair).ending_or_outdated(end)):
            if relation is not None and relation_of(f.name) != relation or f.withdrawn:
                continue
            if self.is_own(f) and not (f.valid is not None and f.valid < end):
                continue
            if outdates and f.marks.get("startFromEpisode") and f.valid is not None and end < f.valid:
                self.close(f, f.valid, f"outdated when written; {reason}")
                f.marks["outdatedWhenWritten"] = True
            elif not only_outdated and (at := self.ends_where(f, end)) is not None:
                self.close(f, at, reason)


def hashed(texts: list[str]) -> list[list[float]]:
    """The built-in embedder."""
    return [hash_vector(t, DIMS) for t in texts]


def fold(state: State, episodes: Iterable[Episode], judge: Judge = opposites, now: datetime | None = None, embed: Embed = hashed) -> list[Outcome]:
    """Applies notes in the order given. A note whose key was seen is a duplicate; one that fails changes nothing."""
    outcomes = []
    for e in episodes:
        if e.key is not None and e.key in state.keys:
            outcomes.append(Outcome(status="duplicate"))
            continue
        journal = Journal(state)
        try:
            outcome = Note(state, e, judge, now or e.created, embed, journal).apply()
        except Exception as error:  # the note is kept as failed, for a retry
            journal.undo()
            outcomes.append(Outcome(status="failed", error=str(error)[:500]))
            continue
        if e.key is not None:
            state.keys.add(e.key)
        outcomes.append(outcome)
    return outcomes
