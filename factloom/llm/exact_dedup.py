"""Exact deduplication by counting quotient filters and byte verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import LOWER_BYTES, bound_batches, join_groups, join_keys, lower_ascii, materialise, table, with_row_key, without_rows

#: The top bits of a fingerprint are its quotient, the rest its remainder.
QUOTIENT_BITS = 24
REMAINDER_BITS = 64 - QUOTIENT_BITS
#: Rows that one merging task is meant to get; more rows give more ranges.
ROWS_PER_RANGE = 1 << 19
LEAST_RANGES = 16


class CountingQuotientFilter:
    """A quotient filter with counts that holds whole fingerprints.

    A fingerprint's quotient names its run and is not stored with it; the run
    holds the remainders in ascending order. quotients has the occupied runs,
    lengths their number of remainders, counts how often each was added. As
    quotient and remainder together are the whole fingerprint, two filters merge
    without loss: runs of the same quotient are merged by sorted remainders, and
    counts of equal ones are added.
    """

    def __init__(self, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.lengths, self.remainders, self.counts = quotients, lengths, remainders, counts

    @classmethod
    def _of_sorted(cls, prints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        quotients, lengths = np.unique(prints >> np.uint64(REMAINDER_BITS), return_counts=True)
        return cls(quotients.astype(np.uint32), lengths.astype(np.uint32), prints & np.uint64((1 << REMAINDER_BITS) - 1), counts.astype(np.int64))

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order].astype(np.uint64), counts[order]
        if not len(prints):
            return cls._of_sorted(prints, counts)
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        return cls._of_sorted(prints[first], np.add.reduceat(counts, first))

    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.quotients.astype(np.uint64) << np.uint64(REMAINDER_BITS), self.lengths) | self.remainders

    @classmethod
    def _two(cls, one: CountingQuotientFilter, two: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters as one, in a single pass over the two sorted rows of fingerprints: each goes to its place behind those of the other that are smaller."""
        a, b = one.fingerprints(), two.fingerprints()
        at_a = np.arange(len(a)) + np.searchsorted(b, a, side="left")
        at_b = np.arange(len(b)) + np.searchsorted(a, b, side="right")
        prints, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
        prints[at_a], prints[at_b] = a, b
        counts[at_a], counts[at_b] = one.counts, two.counts
        if not len(prints):
            return cls._of_sorted(prints, counts)
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        return cls._of_sorted(prints[first], np.add.reduceat(counts, first))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All filters as one: pairs of them, then pairs of pairs, and so on."""
        while len(filters) > 1:
            filters = [cls._two(*filters[k : k + 2]) if k + 1 < len(filters) else filters[k] for k in range(0, len(filters), 2)]
        return filters[0] if filters else cls.build(np.empty(0, np.uint64), np.empty(0, np.int64))

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was added: its run by the quotient, its place by the remainder."""
        run = np.searchsorted(self.quotients, fingerprint >> REMAINDER_BITS)
        if run == len(self.quotients) or int(self.quotients[run]) != fingerprint >> REMAINDER_BITS:
            return 0
        begin = int(self.lengths[:run].sum(dtype=np.int64))
        held = self.remainders[begin : begin + int(self.lengths[run])]
        at = int(np.searchsorted(held, np.uint64(fingerprint & ((1 << REMAINDER_BITS) - 1))))
        return int(self.counts[begin + at]) if at < len(held) and int(held[at]) == fingerprint & ((1 << REMAINDER_BITS) - 1) else 0

    def split(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut by the top bits of the quotients."""
        part = self.quotients >> np.uint32(QUOTIENT_BITS - bits) if bits else np.zeros_like(self.quotients)
        ends = np.r_[0, np.cumsum(self.lengths, dtype=np.int64)]
        for k in np.unique(part):
            a, b = np.searchsorted(part, [k, k + 1])
            x, y = ends[a], ends[b]
            yield int(k), CountingQuotientFilter(self.quotients[a:b], self.lengths[a:b], self.remainders[x:y], self.counts[x:y])

    def to_bytes(self) -> bytes:
        """Remainders take five bytes; only counts above one are stored, with their places."""
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
        many = np.flatnonzero(self.counts > 1)
        head = np.array([len(self.quotients), len(self.remainders), len(many)], "<u8")
        return b"".join(x.tobytes() for x in (head, self.quotients.astype("<u4"), self.lengths.astype("<u4"), np.ascontiguousarray(packed), many.astype("<u4"), self.counts[many].astype("<u8")))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        runs, n, many = (int(x) for x in np.frombuffer(raw, "<u8", 3))
        at = 24
        quotients = np.frombuffer(raw, "<u4", runs, at)
        lengths = np.frombuffer(raw, "<u4", runs, at := at + 4 * runs)
        step = REMAINDER_BITS // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :step] = np.frombuffer(raw, np.uint8, n * step, at := at + 4 * runs).reshape(n, step)
        places = np.frombuffer(raw, "<u4", many, at := at + n * step)
        counts = np.ones(n, np.int64)
        counts[places] = np.frombuffer(raw, "<u8", many, at + 4 * many)
        return cls(quotients, lengths, wide.view("<u8").ravel(), counts)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256((t or b"").translate(LOWER_BYTES)).digest() for t in batch.column(2).cast(pa.binary()).to_pylist()]
        prints = np.frombuffer(b"".join(s[:8] for s in shas), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(prints, pa.int64()), pa.array(shas, pa.binary())], ["rid", "doc_id", "fp", "sha"])


def _build(bits: int):
    """One filter for a partition, made of its batches as they come, in parts by the top bits of the quotients."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[CountingQuotientFilter] = []
        for frame in frames:
            held.append(CountingQuotientFilter.build(frame["fp"].to_numpy().view(np.uint64), frame["copies"].to_numpy()))
            while len(held) > 1 and len(held[-2].remainders) <= 2 * len(held[-1].remainders):
                held[-2:] = [CountingQuotientFilter.merge(held[-2:])]
        rows = [(k, part.to_bytes()) for k, part in CountingQuotientFilter.merge(held).split(bits)]
        yield pd.DataFrame(rows, columns=["range", "filter"])

    return run


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in frame["filter"]])
    many = whole.counts > 1
    return pd.DataFrame({"fp": whole.fingerprints()[many].view(np.int64), "n": whole.counts[many]})


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in prints(fp, copies).

    Each partition builds one filter and sends it in ranges of quotients; a range
    is merged by one task. A hot fingerprint takes one slot of each partition's
    filter. The number of ranges follows rows, so that a range stays of one size.
    """
    bits = min(QUOTIENT_BITS, max(LEAST_RANGES, -(-rows // ROWS_PER_RANGE)).bit_length())
    blocks = prints.select("fp", "copies").mapInPandas(_build(bits), "range int, filter binary")
    return blocks.groupBy("range").applyInPandas(_merge, "fp long, n long")


def _judged(own: DataFrame) -> DataFrame:
    """own(rid, doc_id, text) as (rid, doc_id, keep_id, group_size, kept, text_sha256)."""
    bound_batches(own.sparkSession)
    prints = materialise(own.mapInArrow(_digest, "rid long, doc_id long, fp long, sha binary"), "digests")
    many = materialise(repeated_fingerprints(prints.withColumn("copies", F.lit(1).cast("long")), prints.count()), "repeated")
    suspects = materialise(join_groups(prints, many, "fp", "n", "inner").select("rid", "doc_id", "sha"), "suspects")
    known = F.coalesce("doc_id", F.lit(0)).alias("known"), F.col("doc_id").isNull().alias("none")
    wanted = suspects.select(F.struct(*known).alias("key")).distinct()
    routed = join_keys(own.select("doc_id", "text", F.struct(*known).alias("key")), wanted, "key", "left_semi")
    groups = (
        routed.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
        .groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    groups = materialise(groups, "groups")
    first = join_groups(suspects, groups, "sha", "group_size", "inner").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("rid").alias("keep_rid"))
    joined = join_groups(prints.select("rid", "doc_id", "sha"), materialise(groups.join(first, "sha"), "kept"), "sha", "group_size")
    alone = F.col("group_size").isNull()
    return joined.select(
        "rid", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are the same after lower-casing A-Z; of a
    group the largest id stays. The text's fingerprint goes into its partition's
    counting quotient filter; rows whose fingerprint has a merged count above one
    have their text moved, and those are grouped by the text itself, so that bytes
    decide. Up to BROADCAST_KEYS such rows, which are counted, no other text
    moves; beyond, the texts are dealt by their ids to find them. The grouping is
    summed before the shuffle: a text that a third of all rows share moves once
    per task, and its rows find their group by a broadcast of the hot ones.

    Null text is the empty text. Null ids form no key of their own: such a row is
    kept only if its group has no other id, and keep_id is then null. Of rows that
    repeat both id and text one is kept. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(own).drop("rid")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops, all columns kept. Rows are told apart by a key of their own, not by their ids."""
    keyed, key = with_row_key(docs)
    judged = _judged(keyed.select(F.col(key).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return without_rows(keyed, key, materialise(judged.where("not kept").select("rid"), "gone"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
