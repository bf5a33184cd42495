"""An index of facts by their windows, for the fold: which hold at an instant, which begin next, which end in between."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import numpy as np

from factloom.functions.vectors import cosine_of

#: Up to so many facts a shelf keeps none but their places.
SMALL = 24
#: Facts whose least start and greatest end are kept together, so that a search passes over them at once.
BLOCK = 256
NEVER, EVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
EPOCH = datetime(1970, 1, 1)
FIELDS = ("start", "end", "created", "known", "target", "gone", "replaces", "dated", "key")


def micros(t: datetime | None, missing: int) -> int:
    if t is None:
        return missing
    d = t - EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def numbers(f) -> tuple[int, ...]:
    """A fact as numbers, in the order of FIELDS: its window, when it was learned and when its end was, and its marks."""
    known = f.expired or f.created
    return (
        micros(f.valid, NEVER), micros(f.invalid, EVER), micros(f.created, NEVER), micros(known, NEVER), hash(f.target),
        f.withdrawn, bool(f.marks.get("replacesPrevious")), bool(f.marks.get("startFromEpisode")), hash(f.text),
    )


class Shelf:
    """The places of some facts in a list, in the order in which they came, and beyond SMALL of them their numbers as columns.

    Columns are searched block by block: of each block the least start and the
    greatest end, start and instant of knowledge are kept, so that a search for
    what holds now costs little more than what it finds, however many facts
    are over. Below, the facts themselves are asked.
    """

    def __init__(self, facts: list):
        self.facts, self.places = facts, []
        self.columns: dict[str, np.ndarray] | None = None
        self.vectors: np.ndarray | None = None  # of length one, row for row; rows up to self.filled are there
        self.filled = 0

    def __len__(self) -> int:
        return len(self.places)

    def add(self, place: int) -> None:
        self.places.append(place)
        if self.columns is not None:
            self._grow()
            self._set(len(self.places) - 1)
        elif len(self.places) > SMALL:
            self.columns = {}
            self._grow()
            for row in range(len(self.places)):
                self._set(row, zone=False)
            for block in range(0, len(self.places), BLOCK):
                self._zone(block // BLOCK)

    def drop_last(self) -> None:
        self.places.pop()
        self.filled = min(self.filled, len(self.places))
        if self.columns is not None and self.places:
            self._zone((len(self.places) - 1) // BLOCK)

    def moved(self, place: int) -> None:
        """Takes in that the fact at a place has changed."""
        if self.columns is not None:
            self._set(int(np.searchsorted(self.columns["place"][: len(self.places)], place)))

    def _grow(self) -> None:
        n = len(self.places)
        held = len(self.columns["place"]) if self.columns else 0
        if n <= held:
            return
        size = max(BLOCK, 2 * held, -(-n // BLOCK) * BLOCK)
        kinds = {"gone": bool, "replaces": bool, "dated": bool}
        for name in ("place", *FIELDS):
            column = np.zeros(size, kinds.get(name, np.int64))
            if held:
                column[:held] = self.columns[name]
            self.columns[name] = column
        zones = np.full((4, size // BLOCK), NEVER)
        if held:
            zones[:, : self.zones.shape[1]] = self.zones
        self.zones = zones

    def _set(self, row: int, zone: bool = True) -> None:
        place = self.places[row]
        self.columns["place"][row] = place
        for name, value in zip(FIELDS, numbers(self.facts[place]), strict=True):
            self.columns[name][row] = value
        if zone:
            self._zone(row // BLOCK)

    def _zone(self, block: int) -> None:
        rows = slice(block * BLOCK, min((block + 1) * BLOCK, len(self.places)))
        c = self.columns
        self.zones[:, block] = c["start"][rows].min(), c["start"][rows].max(), c["end"][rows].max(), c["known"][rows].max()

    def _rows(self, zones: Callable[..., np.ndarray], test: Callable[[dict], np.ndarray]) -> np.ndarray:
        """The rows that pass a test, of the blocks whose zones (least start, last start, last end, last knowledge) may hold some."""
        n = len(self.places)
        some = np.flatnonzero(zones(*self.zones[:, : -(-n // BLOCK)]))
        if len(some) * 2 > n // BLOCK:
            return np.flatnonzero(test({k: v[:n] for k, v in self.columns.items()}))
        out = []
        for block in some.tolist():
            rows = slice(block * BLOCK, min((block + 1) * BLOCK, n))
            out.append(np.flatnonzero(test({k: v[rows] for k, v in self.columns.items()})) + rows.start)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _plain(self, test: Callable[[object], bool]) -> np.ndarray:
        return np.array([k for k in self.places if test(self.facts[k])], np.int64)

    def holding(self, t: datetime, ending: bool = False) -> np.ndarray:
        """Places of the facts, none withdrawn, that are true at an instant or, if asked, end just there."""
        if self.columns is None:
            return self._plain(lambda f: not f.withdrawn and (f.covers(t) or ending and f.invalid == t))
        at = micros(t, 0)
        rows = self._rows(lambda first, _s, end, _k: (first <= at) & (end >= at) | (end == at), lambda c: ~c["gone"] & ((c["start"] <= at) & (at < c["end"]) | ending & (c["end"] == at)))
        return self.columns["place"][rows]

    def following(self, t: datetime) -> int | None:
        """The place of the first fact, none withdrawn, that begins after an instant."""
        if self.columns is None:
            begun = [k for k in self.places if not self.facts[k].withdrawn and self.facts[k].valid is not None and self.facts[k].valid > t]
            return min(begun, key=lambda k: self.facts[k].valid, default=None)
        at = micros(t, 0)
        rows = self._rows(lambda _f, last, _e, _k: last > at, lambda c: ~c["gone"] & (c["start"] > at))
        return int(self.columns["place"][rows[np.argmin(self.columns["start"][rows])]]) if len(rows) else None

    def least_end(self, places: np.ndarray) -> datetime | None:
        """The first end of the facts at some places."""
        if self.columns is None or len(places) <= SMALL:
            return min((self.facts[k].invalid for k in places.tolist() if self.facts[k].invalid is not None), default=None)
        rows = np.searchsorted(self.columns["place"][: len(self.places)], places)
        return self.facts[int(places[self.columns["end"][rows].argmin()])].invalid

    def ends_within(self, after: datetime, upto: datetime, but: int) -> bool:
        """Whether a fact other than one ends after an instant and no later than another."""
        if self.columns is None:
            return any(k != but and self.facts[k].invalid is not None and after < self.facts[k].invalid <= upto for k in self.places)
        a, b = micros(after, 0), micros(upto, 0)
        rows = self._rows(lambda _f, _s, end, _k: end > a, lambda c: (c["end"] > a) & (c["end"] <= b))
        return bool((self.columns["place"][rows] != but).any())

    def open_to(self, t: datetime, now: datetime, newer: bool = False, other_than: str | None = None) -> np.ndarray:
        """Places of the facts, none withdrawn, that are live now or true at t; newer: of those, the ones flagged as replacing that begin after t."""
        if self.columns is None:
            fits = lambda f: not newer or bool(f.marks.get("replacesPrevious")) and f.valid is not None and f.valid > t
            return self._plain(lambda f: not f.withdrawn and f.target != other_than and (f.live(now) or f.covers(t)) and fits(f))
        at, here = micros(t, 0), micros(now, 0)
        lacks = None if other_than is None else hash(other_than)

        def test(c: dict) -> np.ndarray:
            live = (c["created"] <= here) & ((c["start"] > here) | (c["end"] > here) | (c["known"] > here))
            out = ~c["gone"] & (live | (c["start"] <= at) & (at < c["end"]))
            if newer:
                out &= c["replaces"] & (c["start"] > at)
            return out if lacks is None else out & (c["target"] != lacks)

        least = min(at, here)
        rows = self._rows(lambda _f, last, end, known: (last > at) if newer else (end > least) | (last > here) | (known > here), test)
        return self.columns["place"][rows]

    def ending_or_outdated(self, t: datetime) -> np.ndarray:
        """Places of the facts, none withdrawn, that an end at t may concern: true then, or dated by a later note."""
        if self.columns is None:
            return self._plain(lambda f: not f.withdrawn and (f.covers(t) or bool(f.marks.get("startFromEpisode")) and f.valid is not None and f.valid > t))
        at = micros(t, 0)
        rows = self._rows(lambda first, last, end, _k: (first <= at) & (end > at) | (last > at), lambda c: ~c["gone"] & ((c["start"] <= at) & (at < c["end"]) | c["dated"] & (c["start"] > at)))
        return self.columns["place"][rows]

    def alike(self, places: np.ndarray, text: str, vector, least: float, vector_of: Callable[[object], list[float]]) -> np.ndarray:
        """Which of some places hold a fact of the same text, or of a vector this near."""
        if self.columns is None or len(places) <= SMALL:
            return np.array([self.facts[k].text == text or cosine_of(vector_of(self.facts[k]), vector) >= least for k in places.tolist()], bool)
        n, q = len(self.places), np.asarray(vector, float)
        if self.vectors is None or self.vectors.shape[1] != len(q):
            self.vectors, self.filled = np.zeros((len(self.columns["place"]), len(q))), 0
        elif len(self.vectors) < n:
            self.vectors = np.concatenate([self.vectors, np.zeros((len(self.columns["place"]) - len(self.vectors), len(q)))])
        for row in range(self.filled, n):
            own = np.asarray(vector_of(self.facts[self.places[row]]), float)
            m = min(len(own), len(q))
            # A vector of another length is compared over the length that both have.
            norm = np.linalg.norm(own[:m]) * np.linalg.norm(q[:m]) / (np.linalg.norm(q) or 1) if m else 0.0
            self.vectors[row] = 0
            self.vectors[row, :m] = own[:m] / norm if norm else 0
        self.filled = n
        rows = np.searchsorted(self.columns["place"][:n], places)
        norm = np.linalg.norm(q)
        near = self.vectors[rows] @ (q / norm if norm else q) >= least
        same = self.columns["key"][rows] == hash(text)
        for k in np.flatnonzero(same & ~near).tolist():
            near[k] = self.facts[int(places[k])].text == text
        return near
