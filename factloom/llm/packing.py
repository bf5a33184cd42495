"""Packing of documents into sequences by best-two-fit, over counts of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, materialise, number_rows, table
from factloom.llm.tokens import encoder, with_end

SEQUENCE = 2048
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SCHEMA = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def _cut(name: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        for batch in batches:
            ids, ends = with_end(*coder.encode_batch(batch.column(2)), end_id)
            sizes = np.diff(ends, prepend=0)
            pieces = -(-sizes // most)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            over = (sizes - (pieces - 1) * most)[doc]  # the first piece takes what is over
            start = np.where(piece == 0, 0, over + (piece - 1) * most)
            length = np.where(piece == 0, over, most)
            raw = memoryview(ids.astype("<u4")).cast("B")
            begin = 4 * ((ends - sizes)[doc] + start)
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            at = pa.array(doc)
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def best_two_fit(counts: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """[(times, lengths of one sequence)]: how sequences of at most `most` tokens are filled.

    A sequence is filled greedily with the longest piece that fits until none
    does. While it has a gap, its smallest piece gives way to two unpacked pieces
    if some two fit the gap it leaves and fill it more tightly; the tightest two
    are taken. The same filling is used as often as the counts allow at once, so
    the work depends on the distinct lengths, of which there are at most `most`,
    not on the number of pieces.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    sizes = sorted(left)
    out = []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            sizes.pop(bisect_left(sizes, n))

    def give(n: int) -> None:
        if not left[n]:
            insort(sizes, n)
        left[n] += 1

    def two(gap: int, over: int) -> tuple[int, int] | None:
        """The two unpacked lengths with the largest sum in (over, gap]."""
        best, found = over, None
        i, j = 0, bisect_right(sizes, gap) - 1
        while i <= j:
            total = sizes[i] + sizes[j]
            if total > gap or (i == j and left[sizes[i]] < 2):
                j -= 1
                continue
            if total > best:
                best, found = total, (sizes[j], sizes[i])
                if best == gap:
                    break
            i += 1
        return found

    while sizes:
        bin_, room = [], most
        while room and (k := bisect_right(sizes, room)):
            n = sizes[k - 1]
            bin_.append(n)
            take(n)
            room -= n
        while room and sizes:
            small = bin_[-1]
            pair = two(room + small, small)
            if not pair:
                break
            bin_.pop()
            for n in pair:
                take(n)
            give(small)
            bin_.extend(pair)
            bin_.sort(reverse=True)
            room = most - sum(bin_)
        need = Counter(bin_)
        more = min(left[n] // c for n, c in need.items())
        for n, c in need.items():
            if more:
                left[n] -= more * c
                if not left[n]:
                    sizes.pop(bisect_left(sizes, n))
        out.append((1 + more, bin_))
    return out


def _runs(patterns: list[tuple[int, list[int]]], wide: int) -> np.ndarray:
    """Rows (length x wide + first rank, first sequence, copies in a sequence, offset), sorted."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for n, c in sorted(Counter(lengths).items(), reverse=True):
            rows.append((n * wide + used[n], sequence, c, offset))
            used[n] += times * c
            offset += n * c
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, end_id: int = END_ID, most: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only documents of more than `most` ids
    are cut, the first piece taking what is over. The pieces' lengths are counted
    (at most `most` rows, the only thing the driver sees), best_two_fit() plans
    sequences over these counts, and every piece finds its place from its number
    among the pieces of its length. That numbering deals each length over many
    tasks. The plan has a row per filling and length: its size is bounded by the
    distinct lengths, whatever the number of documents.

    Null and empty texts are one end id. Repeated rows and null ids are packed
    like others. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    pieces = materialise(own.mapInArrow(_cut(name, end_id, most), SCHEMA), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = 1 << 48
    plan = spark.sparkContext.broadcast(_runs(best_two_fit(counts, most), wide))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = plan.value
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            at = np.searchsorted(runs[:, 0], length * wide + rank, side="right") - 1
            into = length * wide + rank - runs[at, 0]
            f = f.drop(columns=["rank", "row"])
            f["sequence_id"] = runs[at, 1] + into // runs[at, 2]
            f["offset"] = runs[at, 3] + into % runs[at, 2] * length
            yield f

    ranked = number_rows(pieces, ["length"], ["row", "piece"], "rank", ["row", "piece"])
    columns = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
