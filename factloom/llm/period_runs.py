"""Periodic runs of words: aligned blocks searched across a text, and exact extension of what they find."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, table
from factloom.llm.resample import SQL_CRC_TABLE, sql_crc32

#: A run has at least LEAST_LENGTH words, and LEAST_PERIODS times its period.
LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: The least block. A run of a period below it holds an aligned block and the block's next copy, as LEAST_LENGTH >= 2 * BLOCK - 1 + period for periods below BLOCK.
BLOCK = 8
#: Words compared at first when a match is extended; then twice as many, and so on.
STEP = 64
#: Names handed to the automaton at once.
WINDOW = 1 << 16

Run = tuple[int, int, int]  # start, length, period


def _gaps(words: np.ndarray) -> np.ndarray:
    """How many words further on each word comes up again; beyond the end where it doesn't."""
    order = np.argsort(words, kind="stable")
    gap = np.full(len(words), len(words) + 1)
    again = words[order[1:]] == words[order[:-1]]
    gap[order[:-1][again]] = np.diff(order)[again]
    return gap


class _Names:
    """Numbers for the stretches of 1, 2, 4, ... words at every place: equal ones for equal stretches, and only for those."""

    def __init__(self, words: np.ndarray):
        self.size, self.at = 1, words.astype(np.int64)

    def of(self, size: int) -> np.ndarray:
        """For stretches of this size, which never falls from call to call."""
        while self.size < size:
            left, right = self.at[: -self.size], self.at[self.size :]
            self.at = np.unique(left * (right.max(initial=0) + 1) + right, return_inverse=True)[1]
            self.size *= 2
        return self.at


def _windows(firsts: np.ndarray, low: int, high: int, last: int) -> Iterator[tuple[int, int]]:
    """Ranges of the places that lie low to high words after one of firsts, up to last."""
    begins, ends = firsts + low, np.minimum(firsts + high, last) + 1
    new = np.flatnonzero(np.r_[True, begins[1:] > ends[:-1]])
    yield from zip(begins[new].tolist(), ends[np.r_[new[1:] - 1, len(ends) - 1]].tolist(), strict=True)


def _seeds(names: _Names, gap: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances): aligned blocks of this size and how far off copies of them begin, at distances that go with the size.

    Those are 1 to 2 * block - 1 for the least block and from block on for others.
    A block each of whose words does not come up again within that is no key. A key
    is a block as BLOCK numbers of its equal parts, and the text is searched as
    sequences of such numbers, one for each place modulo the parts' size: keys of
    that length cannot make the automaton fall back along chains of their own
    repetitions, which in a text of one word would be as long as the block.
    """
    low, high, n = (1 if block == BLOCK else block), 2 * block - 1, len(gap)
    some = (gap[: n // block * block].reshape(-1, block) <= high).all(axis=1)
    firsts = np.flatnonzero(some) * block
    firsts = firsts[firsts + low + block <= n]
    if not len(firsts):
        return firsts, firsts
    part = block // BLOCK
    name = names.of(part)
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys, kind = np.unique(np.stack([name[firsts + k * part] for k in range(BLOCK)], axis=1), axis=0, return_inverse=True)
    for k, key in enumerate(keys.tolist()):
        found.add_word(tuple(key), k)
    found.make_automaton()
    hits, ids = [], []
    for begin, end in _windows(firsts, low, high, n - block):
        for first in range(begin, min(begin + part, end)):
            for at in range(first, end, WINDOW * part):  # a bounded number of names at once, with those that its last blocks reach over
                stop = min(at + WINDOW * part, end) + (BLOCK - 1) * part
                for k, what in found.iter(tuple(name[at:stop:part].tolist())):
                    hits.append(at + (k - BLOCK + 1) * part)
                    ids.append(what)
    # Copies of each kind of block in order of place; of each block, those at fitting distances.
    span = n + 1
    key = np.unique(np.array(ids, np.int64) * span + np.array(hits, np.int64))
    kind = kind.reshape(-1) * span
    first = np.searchsorted(key, kind + firsts + low)
    last = np.searchsorted(key, kind + np.minimum(firsts + high, n), side="right")
    count = np.maximum(last - first, 0)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    places = np.repeat(firsts, count)
    return places, key[at] % span - places


def _reach(words: np.ndarray, at: int, block: int, d: int) -> tuple[int, int]:
    """The widest [start, end) around a matched block in which each word equals the one d further on."""
    start, size = at, STEP
    while start:
        low = max(0, start - size)
        off = np.flatnonzero(words[low:start] != words[low + d : start + d])
        if len(off):
            start = low + int(off[-1]) + 1
            break
        start, size = low, size * 2
    end, size, most = at + block, STEP, len(words) - d
    while end < most:
        high = min(most, end + size)
        off = np.flatnonzero(words[end:high] != words[end + d : high + d])
        if len(off):
            end += int(off[0])
            break
        end, size = high, size * 2
    return start, end


def _unknown(places: np.ndarray, distances: np.ndarray, runs: list[Run], block: int) -> tuple[np.ndarray, np.ndarray]:
    """The matches, in order of place, that do not lie in a known run at a multiple of its period."""
    new = np.ones(len(places), bool)
    for start, length, period in runs if len(places) else []:
        some = slice(*np.searchsorted(places, (start, start + length)))
        new[some] &= (distances[some] % period != 0) | (places[some] + distances[some] + block > start + length)
    return places[new], distances[new]


def find_runs(words: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a sequence of integers, by start and then period.

    A run is a stretch with a smallest period that no neighbour extends, of at least
    LEAST_LENGTH words and LEAST_PERIODS periods. With B the largest power of two
    up to the period, or BLOCK, it holds an aligned block of B words and a copy of
    it one period on, since 2 * B - 1 + period is no more than its length. So for
    each B the aligned blocks are keys of an automaton, the text is searched for
    them, and each copy at a distance that goes with B is extended to both sides,
    word for word. Copies within a run that is known, at a multiple of its period,
    would give that run again and are left out, and so is a stretch that an earlier
    copy at the same distance was extended to.
    """
    n = len(words)
    runs: list[Run] = []
    if n < LEAST_LENGTH:
        return runs
    gap, names = _gaps(words), _Names(words)
    block = BLOCK
    while block == BLOCK or LEAST_PERIODS * block <= n:
        places, distances = _seeds(names, gap, block)
        # Only among the distances of the least block is one a multiple of another.
        for some, d in [(distances == d, d) for d in range(1, 2 * block)] if block == BLOCK else [(distances * LEAST_PERIODS <= n, None)]:
            here, apart = _unknown(places[some], distances[some], runs if d is None else [r for r in runs if d % r[2] == 0], block)
            order = np.lexsort((here, apart))
            done, last = 0, 0
            for at, d in zip(here[order].tolist(), apart[order].tolist(), strict=True):
                if d == last and at + block <= done:
                    continue
                (start, done), last = _reach(words, at, block, d), d
                if done - start + d >= max(LEAST_LENGTH, LEAST_PERIODS * d):
                    runs.append((start, done - start + d, d))
        block *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def remade(n: int, doc_id: int | None) -> np.ndarray | None:
    """Where the words of a document come from if its id makes it periodic from some word on; null ids change nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the bounds of each text's; null is empty. Words stand between ASCII white space."""
    cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat = cut.flatten()
    word = pc.not_equal(flat, "")
    before = np.r_[0, np.cumsum(word.to_numpy(zero_copy_only=False))]
    ends = np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy())]
    return flat.filter(word), before[ends]


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: all but those that a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _scan(make: bool, full: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = split_words(batch.column(1))
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy()
            rows = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own, source = ids[a:b], remade(b - a, doc_id) if make else None
                own = own if source is None else own[source]
                runs = find_runs(own)
                kept = own[collapsed(len(own), runs)] if runs else own
                text = " ".join(coded.dictionary.take(pa.array(kept)).to_pylist() if runs or source is not None else words.slice(a, b - a).to_pylist())
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                listed = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                row = (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, listed, digest)
                rows.append((*row, [{"start": s, "length": length, "period": q} for s, length, q in runs], text) if full else row)
            schema = pa.schema(_arrow(full))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)

    return scan


def _arrow(full: bool) -> list[tuple[str, pa.DataType]]:
    fields = [(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in NAMES]
    if full:
        fields += [("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())]
    return fields


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, full: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 and, if full, runs and collapsed.

    runs has all runs of find_runs() over the text's words, which are what stands
    between ASCII white space, numbered from 0. start, length and period are of the
    run with the greatest length / period, of equals the first and then that of the
    smallest period; null without a run. collapsed is the text without the words
    that any run holds after its first period, joined by one space. With planted,
    a tenth of the documents, by their ids, is made periodic first, see remade().

    A scan without a shuffle: each row is judged by itself, in memory that grows
    with the longest text and not with its runs. Null and empty texts, and texts of
    white space, have no words, no runs and the digest of the empty text. Rows with
    null ids are never remade. Repeated rows each give a row; other columns are
    ignored; an empty table gives none.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in NAMES)
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if full else ""
    return own.mapInArrow(_scan(planted, full), kinds + more)


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs(table(spark, sf_dir, "documents"), planted=True, full=False)


OP11_SQL = f"""
WITH {SQL_CRC_TABLE},
split AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {sql_crc32("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, crc_table),
cut AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AND doc_id IS NOT NULL AS made, (h // 10) % greatest(len(w), 1) AS a FROM split),
sized AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut),
d AS MATERIALIZED (SELECT key, doc_id, n, CASE WHEN made THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM sized),
words AS MATERIALIZED (SELECT key, n, unnest(w) AS w, unnest(range(0, n)) AS i FROM d),
same AS (SELECT x.key, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.key = y.key AND x.w = y.w AND y.i > x.i AND {LEAST_PERIODS} * (y.i - x.i) <= x.n),
stretch AS (
  SELECT key, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY key, q ORDER BY i) AS island FROM same) GROUP BY key, q, island HAVING count(*) + q >= greatest({LEAST_LENGTH}, {LEAST_PERIODS} * q)
),
runs AS (SELECT key, start, length, min(q) AS period FROM stretch GROUP BY key, start, length),
best AS (
  SELECT key, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS listed,
         min_by(struct_pack(s := start, l := length, q := period), struct_pack(a := -length::DOUBLE / period::DOUBLE, b := start, c := period)) AS r FROM runs GROUP BY key
),
gone AS (SELECT DISTINCT key, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT key, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (key, i) GROUP BY key)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.l AS length, r.q AS period, 1000 * r.l // r.q AS exponent_milli,
       coalesce(listed, sha256('')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (key) LEFT JOIN kept USING (key)
"""
