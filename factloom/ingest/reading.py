"""What a reader of notes is told about a group, inside the fold: the entities that a text names or is near to, and their facts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import numpy as np

from factloom.functions.text import is_unspaced, mentions, tokens_of
from factloom.ingest.context import FACT_ENTITIES, FACTS, NAMED, RANKED, READ_CHARS
from factloom.ingest.fold import Embed, Entity, Fact, State
from factloom.ingest.shelf import Shelf

#: Reads a text, told (reference_time, known_entities, known_facts), and gives {entities, facts, invalidations}.
Reader = Callable[[str, dict], dict]


class Known:
    """A group's entities by the first token of their names and by their vectors, and its facts by their ends; kept up as the fold goes on."""

    def __init__(self, state: State, embed: Embed):
        self.state, self.embed = state, embed
        self.by_token: dict[str, list[str]] = {}
        self.loose: list[str] = []  # names that no token of a text need begin
        self.seen: dict[str, int] = {}
        self.names: list[str] = []
        self.nodes: dict[str, Shelf] = {}
        self.facts = 0

    def update(self) -> None:
        """Takes in the entities and facts that are new since the last note, and drops what a failed one has left."""
        state = self.state
        for f in state.facts[self.facts :]:
            for end in {f.source, f.target}:
                self.nodes.setdefault(end, Shelf(state.facts)).add(f.place)
        self.facts = len(state.facts)
        for low, e in state.entities.items():
            if low not in self.seen:
                self.seen[low] = len(self.names)
                self.names.append(low)
                first = next(iter(tokens_of(e.name)), "")
                # A single character of a script without spaces is no token inside a longer word.
                home = self.loose if len(first) < 2 and (not first or is_unspaced(first)) else self.by_token.setdefault(first, [])
                home.append(low)

    def changed(self, facts: list[Fact]) -> None:
        for f in facts:
            for end in {f.source, f.target}:
                if end in self.nodes and f.place < self.facts:
                    self.nodes[end].moved(f.place)

    def named(self, text: str) -> list[Entity]:
        """The entities that a text names, the longest name first."""
        low = text.lower()
        maybe = dict.fromkeys(n for t in dict.fromkeys(tokens_of(text)) for n in self.by_token.get(t, ()))
        found = [n for n in sorted([*maybe, *self.loose], key=self.seen.get) if n in self.state.entities and mentions(low, n)]
        return [self.state.entities[n] for n in sorted(found, key=lambda n: -len(self.state.entities[n].name))[:NAMED]]

    def near(self, text: str, but: set[str]) -> list[Entity]:
        """The other entities: all where they are few, else those whose name vectors are nearest to the text's beginning."""
        own = self.state.entities
        if len(own) - len(but) <= RANKED:
            return [e for e in own.values() if e.uuid not in but]
        q = np.asarray(self.embed([text[:READ_CHARS]])[0], float)
        rows = [e for e in own.values() if e.vector is not None and len(e.vector) == len(q) and e.uuid not in but]
        if not rows or not np.linalg.norm(q):
            return []
        vectors = np.array([e.vector for e in rows], float)
        norms = np.linalg.norm(vectors, axis=1)
        cosines = np.divide(vectors @ q, norms * np.linalg.norm(q), out=np.zeros(len(rows)), where=norms > 0)
        return [rows[k] for k in np.argsort(-cosines, kind="stable")[:RANKED]]

    def told(self, text: str, at: datetime, now: datetime) -> dict:
        """What a reader is told before it reads a text."""
        self.update()
        named = self.named(text)
        relevant = named + self.near(text, {e.uuid for e in named})
        name = {e.uuid: e.name for e in self.state.entities.values()}
        facts: dict[int, Fact] = {}
        for e in relevant[:FACT_ENTITIES]:
            shelf = self.nodes.get(e.uuid)
            for place in shelf.open_to(now, now).tolist() if shelf is not None else ():
                if len(facts) < FACTS and self.state.facts[place].live(now):
                    facts.setdefault(place, self.state.facts[place])
        known = [{"source_name": name.get(f.source, ""), "target_name": name.get(f.target, ""), "relation": f.name, "fact": f.text, "valid_at": f.valid} for f in facts.values()]
        return {"reference_time": at, "known_entities": [{"name": e.name, "summary": e.summary} for e in relevant], "known_facts": known}
