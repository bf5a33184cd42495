"""Sharding by a k-d tree over metadata with distributed weighted medians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, join_groups, materialise, number_in_order, number_rows, table

SHARDS = 24
DIMENSIONS = ("lang", "source", "n_chars")
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: A row's key in its node has digits of so many bits: the coordinate, two of the text's hash, one of the row's. A median is found digit by digit.
DIGIT_BITS, DIGITS = 15, 4
BINS = 1 << DIGIT_BITS


def _is_text(docs: DataFrame, name: str) -> bool:
    return dict(docs.dtypes)[name] in ("string", "binary")


def _number(docs: DataFrame, name: str) -> Column:
    """A column as a number that keeps its order; null is 0. Texts stay texts, with null before all others."""
    kind = dict(docs.dtypes)[name]
    if _is_text(docs, name):
        held = F.hex(F.col(name)) if kind == "binary" else F.col(name)
        return F.when(held.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), held))
    if kind == "date" or kind.startswith("timestamp"):
        return F.coalesce(F.unix_seconds(F.col(name).cast("timestamp")).cast("double"), F.lit(0.0))
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))


def _digit(k: int) -> Column:
    """Digit k of a row's key in its node."""
    if k == 0:
        return F.element_at("at", F.col("dim"))
    held = F.shiftrightunsigned("text_hash", 64 - DIGIT_BITS * k) if k < DIGITS - 1 else F.col("row_hash")
    return held.bitwiseAND(BINS - 1).cast("int")


def _medians(rows: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """nodes(node, shards, first) with dim, key and whole: where each node of more than one shard is cut.

    The dimension is the one in which the node is widest, against the whole
    table. The cut is the weighted quantile at the share of the left shards: per
    digit, the bytes of each of the BINS values are summed up over the cluster,
    and the value in which the quantile lies is opened in the next digit. Rows
    that share the last bin go to the nearer side together.
    """
    inner = rows.join(F.broadcast(nodes.where("shards > 1")), "node")
    width = [(F.max(F.element_at("at", d + 1)) - F.min(F.element_at("at", d + 1))).alias(f"w{d}") for d in range(dims)]
    sums = inner.groupBy("node", "shards", "first").agg(F.sum("size").alias("bytes"), *width)
    widest = F.greatest(*[F.struct(F.col(f"w{d}").alias("w"), F.lit(-d).alias("d")) for d in range(dims)]) if dims > 1 else F.struct(F.lit(0).alias("w"), F.lit(0).alias("d"))
    cuts = sums.select("node", (1 - widest["d"]).cast("int").alias("dim"), (F.col("bytes") * F.floor(F.col("shards") / 2) / F.col("shards")).alias("want"), F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("key"))
    cuts = materialise(cuts, "cuts")
    for k in range(DIGITS):
        held = rows.join(F.broadcast(cuts), "node")
        same = F.lit(0).cast("long")
        for j in range(k):
            same = same * BINS + _digit(j)
        bins = held.where(same == F.col("key")).groupBy("node", "dim", "want", "before", "key", _digit(k).alias("digit")).agg(F.sum("size").cast("double").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        first = F.row_number().over(Window.partitionBy("node").orderBy("digit"))
        reach = bins.withColumn("upto", F.col("before") + upto).where(F.col("upto") >= F.col("want"))
        cut = reach.withColumn("nth", first).where("nth = 1")
        cuts = materialise(
            cut.select("node", "dim", "want", (F.col("upto") - F.col("bytes")).alias("before"), (F.col("key") * BINS + F.col("digit")).alias("key"), ((F.col("want") - F.col("upto") + F.col("bytes")) * 2 >= F.col("bytes")).alias("whole")).drop(*([] if k == DIGITS - 1 else ["whole"])),
            "cuts",
        )
    return nodes.join(cuts.select("node", "dim", "key", "whole"), "node")


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_split.

    The law is `bytes`: shards take nearly the same sizes, a size being the
    text's UTF-8 bytes plus 8. Either the number of shards or the bytes that each
    should have at most is given. The tree begins with all rows and is cut, level
    by level, at the weighted median of the widest of the metadata dimensions
    until each leaf is one shard; where an odd number of shards is left, at the
    quantile that gives each side its share. A text dimension counts by the ranks
    of its distinct values. Copies of a text take the least coordinates of them
    all. Ties in a dimension are ordered by the text's hash and then by that of
    the id, and the cut is where the quantile falls: so copies stay in one shard,
    but for the one group of each cut that it may fall into, whatever its size.
    group_split marks the rows of those groups, at most one less than shards.

    Where a row goes, its slot too, depends on ids, texts and dimensions alone, not on
    files or partitions; rows that repeat all of these are interchangeable. slot
    numbers a shard's rows from 0 without gaps; grown_shard is null under this
    law. Null texts take 8 bytes; null ids, repeated rows and nulls in dimensions
    are placed like others; dimensions that docs lacks are left out. An empty
    table gives no rows. All state is in tables of one row a document or BINS rows
    a node; the driver gets only the totals.
    """
    spark = docs.sparkSession
    present = [d for d in dims if d in docs.columns]
    named = [f"d{k}" for k in range(len(present))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"),
        *[_number(docs, d).alias(n) for d, n in zip(present, named, strict=True)],
    )
    # Rows that are the same in all of this are told apart by numbers.
    own = own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("copies")).select("*", F.explode(F.expr("sequence(1L, copies)")).alias("nth")).drop("copies")
    own = materialise(own, "sizes")
    for d, n in zip(present, named, strict=True):
        if _is_text(docs, d):
            values = own.groupBy(n).agg(F.count(F.lit(1)).alias("held"))
            ranks = materialise(number_in_order(values, [n], "at_rank"), "ranks")
            ranked = materialise(join_groups(own, ranks, n, "held", "inner").drop("held", n).withColumn(n, F.col("at_rank").cast("double")).drop("at_rank"), "sizes")
            discard(spark, own)
            own = ranked
    totals = own.agg(F.sum("size").alias("total"), *[f(n).alias(f"{w}_{n}") for n in named for f, w in ((F.min, "lo"), (F.max, "hi"))]).first()
    total = totals["total"] or 0
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    scaled = [F.floor((F.col(n) - F.lit(totals[f"lo_{n}"] or 0.0)) * F.lit((BINS - 1) / ((totals[f"hi_{n}"] or 0.0) - (totals[f"lo_{n}"] or 0.0) or 1.0))).cast("int") for n in named]
    dims_n = max(1, len(named))
    placed = materialise(own.withColumn("at", F.array(*scaled or [F.lit(0)])).withColumn("text_key", F.struct("t1", "t2")).drop(*named, "t1", "t2"), "placed")
    discard(spark, own)
    together = placed.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.array(*[F.min(F.element_at("at", d + 1)) for d in range(dims_n)]).alias("group_at")).where("copies > 1")
    together = materialise(together, "together")
    placed = join_groups(placed, together, "text_key", "copies").select(
        "doc_id", "nth", "size", "text_crc32", "text_key", F.lit(1).cast("long").alias("node"), F.coalesce("group_at", "at").alias("at"),
        F.xxhash64("text_key").alias("text_hash"), F.xxhash64(F.lit("row"), "doc_id", "text_key", "nth").alias("row_hash"),
    )
    rows = materialise(placed, "rows")
    nodes = spark.createDataFrame([(1, shards, 0)], "node long, shards int, first int")
    for _ in range(max(0, (shards - 1).bit_length())):
        cuts = materialise(_medians(rows, nodes, dims_n), "medians")
        key = F.lit(0).cast("long")
        for k in range(DIGITS):
            key = key * BINS + _digit(k)
        right = (key > F.col("key")) | ((key == F.col("key")) & ~F.col("whole"))
        moved = rows.join(F.broadcast(cuts.select("node", "dim", "key", "whole")), "node", "left").withColumn("node", F.when(F.col("key").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("long")))
        after = materialise(moved.select(*rows.columns), "rows")
        discard(spark, rows)
        rows = after
        half = F.floor(F.col("shards") / 2).cast("int")
        children = nodes.where("shards > 1").select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), half.alias("shards"), F.col("first").alias("first")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("shards") - half).alias("shards"), (F.col("first") + half).alias("first")),
        )).alias("n")).select("n.*")
        nodes = materialise(children.unionByName(nodes.where("shards = 1")), "nodes")
    out = rows.join(F.broadcast(nodes.select("node", F.col("first").alias("shard"))), "node")  # a row a shard
    out = materialise(out.select("doc_id", "nth", "size", "text_crc32", "text_key", "text_hash", "shard"), "shards")
    discard(spark, rows)
    split = out.groupBy("text_key").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).where("lo <> hi").select("text_key", F.lit(True).alias("cut"))  # at most one a cut
    out = number_rows(out.join(F.broadcast(split), "text_key", "left"), ["shard"], ["doc_id", "text_hash", "text_key", "nth"], "slot", ["doc_id", "text_hash", "nth"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("cut", F.lit(False)).alias("group_split"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))
