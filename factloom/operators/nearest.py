"""Nearest vectors without a cosine for every row: signatures of random projections, and exact cosines of the rows they leave."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from factloom.operators.ranking import shared_checkpoint

#: Planes of a signature, which is as many bits; the seed that they are drawn with; the share of rows whose cosine is taken.
PLANES, SEED, SHARE = 256, 42, 0.4
WORD = 64
#: Rows and queries that meet in one task, and queries whose cosines are held at once.
ROWS, ASKED, AT_ONCE = 16_384, 8_192, 64
#: Cosines are equal if they are to so many places; what may lie between two of them before that.
DIGITS, SLACK = 9, 1e-8


def planes(dims: int, many: int = PLANES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims, many))


def _bits(vectors: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """The side of each plane on which each vector lies, as words of 64 bits."""
    packed = np.packbits(vectors @ drawn > 0, axis=1, bitorder="little")
    return packed.view("<i8")


def signature(vector: list[float], many: int = PLANES, seed: int = SEED) -> list[int]:
    return _bits(np.array([vector], float), planes(len(vector), many, seed))[0].tolist()


def with_signature(rows: DataFrame, dims: int, vector: str = "embedding", many: int = PLANES, seed: int = SEED) -> DataFrame:
    """rows with signature, to be written once: a word for each 64 planes; null for vectors that are null or of another length."""
    if many % WORD:
        raise ValueError(f"a signature has whole words of {WORD} planes")

    @F.pandas_udf("array<bigint>")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drawn = planes(dims, many, seed)
        for part in parts:
            fits = part.map(lambda v: v is not None and len(v) == dims and all(x is not None for x in v)).to_numpy(bool)
            found = iter(_bits(np.stack(part[fits].to_numpy()).astype(float), drawn)) if fits.any() else iter(())
            yield pd.Series([next(found) if fit else None for fit in fits], index=part.index, dtype=object)

    return rows.withColumn("signature", sign(F.col(vector)))


def _cells(rows: DataFrame, queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, in_rows: int, in_queries: int) -> DataFrame:
    """run(block of rows, block of queries) for every pair of blocks; a block is dealt by the hash of the id, and is bounded however many rows there are."""
    none = to_arrow_schema(schema).empty_table()
    across, down = (max(1, -(-part.count() // most)) for part, most in ((rows, in_rows), (queries, in_queries)))
    block = lambda id_, blocks: F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = rows.withColumn("__r", block("__key", across)).withColumn("__c", every(down))
    asked = queries.withColumn("__c", block("query", down)).withColumn("__r", every(across))
    return own.groupBy("__r", "__c").cogroup(asked.groupBy("__r", "__c")).applyInArrow(lambda a, b: run(a, b) if a.num_rows and b.num_rows else none, schema)


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), kind).reshape(len(flat), -1)


def _signed(column: pa.ChunkedArray) -> np.ndarray:
    return np.asfortranarray(_numbers(column, np.int64).view(np.uint64))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; those of length 0 stay, and their cosines are 0."""
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1)


def _apart(own: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """On how many planes' sides the signatures of own differ from that of one query."""
    out = np.zeros(len(own), np.int64)
    for word in range(own.shape[1]):
        out += np.bitwise_count(own[:, word] ^ asked[word])
    return out


def _distances(rows: pa.Table, queries: pa.Table) -> pa.Table:
    """(query, counts): for each query, how many of the rows are 0, 1, 2, ... planes apart."""
    own, asked = _signed(rows["signature"]), _signed(queries["signature"])
    counts = [np.bincount(_apart(own, one)) for one in asked]
    return pa.table({"query": queries["query"], "counts": pa.array(counts, pa.list_(pa.int64()))})


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """(query, __key, cosine, n): the block's k best rows of each query, and in the first of them how many cosines stood for choice."""
        rows = rows.sort_by("__key")  # equal cosines are in the order of the key
        found, asked_by, cosines, sizes = [], [], [], []
        own, asked = _units(_numbers(rows["vector"], float)), _units(_numbers(queries["vector"], float))
        cuts = queries["cut"].to_numpy() if "cut" in queries.column_names else None
        if cuts is not None:
            signed, wanted = _signed(rows["signature"]), _signed(queries["signature"])
        for at in range(0, len(asked), AT_ONCE):
            for q, near in enumerate(asked[at : at + AT_ONCE] @ own.T, at):
                if cuts is None:
                    places, n = None, len(near)
                else:
                    places = np.flatnonzero(_apart(signed, wanted[q]) <= cuts[q])
                    near, n = near[places], len(places)
                if not n:
                    continue
                order = np.where(np.isnan(near), np.inf, near)  # as in a descending sort of Spark
                least = np.partition(order, n - k)[n - k] if n > k else -np.inf
                some = np.flatnonzero(order >= least - SLACK)
                some = some[np.argsort(-np.round(order[some], DIGITS), kind="stable")[:k]]
                found.append(some if places is None else places[some])
                asked_by.append(np.full(len(some), q))
                cosines.append(np.round(near[some], DIGITS))
                sizes.append(np.where(np.arange(len(some)) == 0, n, 0))
        joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        return pa.table({
            "query": queries["query"].take(pa.array(joined(asked_by, np.int64))), "__key": rows["__key"].take(pa.array(joined(found, np.int64))),
            "cosine": pa.array(joined(cosines, float)), "n": pa.array(joined(sizes, np.int64)),
        })

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, share: float = SHARE, key: str = "uuid", vector: str = "embedding", in_rows: int = ROWS, in_queries: int = ASKED) -> DataFrame:
    """(query, key, cosine, taken, position): for each of queries(query, vector, signature) the k rows of greatest cosine among the share of rows whose signatures are least apart; taken is how many these are.

    Blocks of rows meet blocks of queries, so that no task holds more than one of
    each, however many queries there are. A first pass reads signatures alone, 32
    bytes a row, and counts for each query how many rows are how far apart, PLANES
    + 1 numbers; the least distance that leaves the share, and k rows at least, is
    the query's cut. A second pass takes the cosine of the rows within the cut,
    ties of it included, and each pair of blocks gives the k best. A share of 1 is
    exact, and needs no first pass. All pairs are met, which is quadratic where
    the queries grow with the rows. Rows with a null signature are left out, and
    queries too. Equal cosines, to DIGITS places, are in the order of the key.
    """
    own = rows.where("signature is not null").select(F.col(key).alias("__key"), F.col(vector).alias("vector"), "signature")
    asked = queries.where("signature is not null").select("query", F.col(vector).alias("vector"), "signature")
    schema = lambda *more: StructType([asked.schema["query"], *more])
    if share < 1:
        counted = _cells(own.drop("vector"), asked.drop("vector"), _distances, schema(StructField("counts", ArrayType(LongType()))), in_rows, in_queries)
        each = counted.repartition("query").select("query", F.posexplode("counts").alias("d", "n")).where("n > 0")
        totals = each.groupBy("query", "d").agg(F.sum("n").alias("n"))  # PLANES + 1 rows a query
        upto, whole = Window.partitionBy("query").orderBy("d"), Window.partitionBy("query")
        within = totals.withColumn("__upto", F.sum("n").over(upto)).withColumn("__all", F.sum("n").over(whole))
        enough = F.col("__upto") >= F.least(F.greatest(F.ceil(F.col("__all") * share), F.lit(k)), F.col("__all"))
        asked = shared_checkpoint(asked.join(within.where(enough).groupBy("query").agg(F.min("d").alias("cut")), "query"))
    else:
        own, asked = own.drop("signature"), asked.drop("signature")
    met = _cells(own, asked, _best(k), schema(own.schema["__key"], StructField("cosine", DoubleType()), StructField("n", LongType())), in_rows, in_queries)
    best, whole = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "__key"), Window.partitionBy("query")
    placed = met.withColumn("taken", F.sum("n").over(whole)).withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
    return shared_checkpoint(placed.select("query", F.col("__key").alias(key), "cosine", "taken", "position"))  # met once, however often it is read


def recall(found: DataFrame, exact: DataFrame, key: str = "uuid") -> DataFrame:
    """(query, wanted, met): of the rows that an exact search gives, how many were found."""
    hit = found.select("query", key, F.lit(1).alias("__hit"))
    return exact.join(hit, ["query", key], "left").groupBy("query").agg(F.count(F.lit(1)).alias("wanted"), F.count("__hit").alias("met"))
