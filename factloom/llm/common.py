"""What the text operators share: scratch tables, gapless numbering, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Row keys (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Files (a path and a number each) that are broadcast at most.
BROADCAST_FILES = 100_000
#: Bytes of one Arrow batch handed to Python, whatever the length of the texts.
ARROW_BATCH_BYTES = 4 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Maps the bytes A-Z to a-z; safe on UTF-8, whose other bytes are above 0x7F.
LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes unless the session has a tighter bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).removesuffix("b")
    if not held.isdigit() or int(held) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


_HELD: dict[str, Callable[[], object]] = {}


def holds(name: str, forget: Callable[[], object]) -> None:
    """Says that this worker process now keeps a memory called name, and drops the others.

    Workers are used again by other operators' tasks; without this, each would
    go on to hold what every operator before has remembered.
    """
    others = [_HELD.pop(k) for k in list(_HELD) if k != name]
    _HELD[name] = forget
    for other in others:
        other()
    if others:
        give_back()


def give_back() -> None:
    """Hands memory that is free but kept in reserve back to the system, where that is possible."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset, as in
    local tests, a temporary folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        root = held.rsplit("/", 1)[0] if held else None
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="factloom-scratch-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Cuts the lineage; a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by materialise()."""
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/factloom-" in folder:
            hadoop = jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how far hot groups are spread."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row that is the same in every scan, and the key's name, which no other column has.

    Rows of Parquet files are known by their file and their place in it: nothing
    is copied. The files are numbered in a table of one row each. Where docs is not
    a plain scan of files, or of more files than a broadcast should hold, the rows
    are written once with a number.
    """
    name = f"__row_{uuid.uuid4().hex}"
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{name}f"), F.col("_metadata.row_index").alias(f"{name}i")) if plain else None
    except AnalysisException:  # files without places of rows
        placed = None
    if placed is not None:
        files = placed.select(f"{name}f").distinct()
        files = materialise(files.withColumn(f"{name}n", F.row_number().over(Window.orderBy(f"{name}f")) - 1), "files")
        if files.count() <= BROADCAST_FILES:
            key = F.col(f"{name}n").cast("long") * F.lit(1 << 36) + F.col(f"{name}i")
            return placed.join(F.broadcast(files), f"{name}f").withColumn(name, key).drop(f"{name}f", f"{name}i", f"{name}n"), name
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def join_keys(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """rows joined left_semi or left_anti with keys(on): few keys, which are counted, are broadcast, so that rows stay where they are."""
    keys = keys.select(on)
    return rows.join(F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys, on, how)


def without_rows(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of with_row_key() that gone(rid) does not name, without the key."""
    return join_keys(keyed, gone.select(F.col("rid").alias(key)), key, "left_anti").drop(key)


def join_groups(rows: DataFrame, groups: DataFrame, on: str, weight: str, how: str = "left") -> DataFrame:
    """rows joined (left, inner or left_semi) with groups, which has each value of on once and says how many rows it has there.

    Groups of more than a share of all rows, of which there can be only a few for
    each shuffle partition, are broadcast, so that no hot group is one task's; the
    others are joined by a shuffle. rows should be a table: it is read twice.
    """
    spark = rows.sparkSession
    share = (rows.count() // (2 * width(spark))) + 1
    hot = groups.where(F.col(weight) >= share)
    some = [r[0] for r in hot.select(on).limit(1).collect()]
    rest = groups.where(F.coalesce(F.col(weight) < share, F.lit(True)))
    if not some:
        return rows.join(rest, on, how)
    mark = hot.select(on)
    one = rows.join(F.broadcast(hot), on, "inner" if how == "left" else how)
    two = rows.join(F.broadcast(mark), on, "left_anti").join(rest, on, how)
    return one.unionByName(two)


def number_in_order(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds out: 0, 1, 2, ... over the whole table in the order of some columns, which break all ties.

    A range sort, and the counts of its partitions summed up: no task has all rows.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    dealt = materialise(sorted_.withColumn("__part", F.shiftrightunsigned(at, 33)).withColumn("__at", at.bitwiseAND((1 << 33) - 1)), "ordered")
    before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows")).select("__part", F.coalesce(before, F.lit(0)).alias("__first"))  # a row a partition
    return dealt.join(F.broadcast(firsts), "__part").withColumn(out, F.col("__at") + F.col("__first")).drop("__part", "__at", "__first")


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str, spread: list[str]) -> DataFrame:
    """Adds out: 0, 1, 2, ... within each group, without one task per group.

    Rows of a group are dealt by a hash of the columns in spread over as many
    buckets as the session has shuffle partitions; each bucket is numbered by
    itself and the buckets' counts, at most groups x buckets rows, are summed up
    to give every bucket its first number. The numbering is a function of the
    rows' values where order breaks all ties.
    """
    spark = df.sparkSession
    n = width(spark)
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*spread), F.lit(n)))
    key = [*group, "__bucket"]
    firsts = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__first", F.sum("__rows").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*[F.col(c).alias(f"__k_{c}") for c in key], F.coalesce("__first", F.lit(0)).alias("__first"))
    )
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    same = [df[c].eqNullSafe(firsts[f"__k_{c}"]) for c in key]
    numbered = df.withColumn(out, at.cast("long")).join(firsts, same)
    return numbered.withColumn(out, F.col(out) + F.col("__first")).drop("__bucket", "__first", *[f"__k_{c}" for c in key])


def connected_components(edges: DataFrame, rounds: int = 128) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node.

    Hook and contract: in each round every node hooks onto its least neighbour
    when that is smaller, chains of hooks are shortened by pointer doubling, and
    the edges are rewritten between the roots. Stars, such as thousands of copies
    around one document, vanish in the first round, so that no hub stays. Of the
    least nodes that are left after a round, only such can be left after the next
    as took all their neighbours with them, at least one each: two rounds halve
    the nodes of a component, and 128 are enough for 2**63 of them. Nodes
    may be of any type that can be ordered. Each round's tables are checkpointed
    in the shared folder; nothing but counts goes to the driver. Null ends and
    self-loops add no link; a node that has only a self-loop is its own component.
    """
    scratch_root(edges.sparkSession)
    clean = edges.select("a", "b").where("a is not null and b is not null")
    nodes = clean.select(F.col("a").alias("node")).union(clean.select("b")).distinct()
    todo = clean.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if todo.isEmpty():
            break
        hook = todo.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).checkpoint()
        while True:  # pointer doubling: a root that hooks itself passes its own root on
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            longer = hook.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")).checkpoint()
            hook = longer.select("node", "root")
            if longer.where("moved").isEmpty():
                break
        maps.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        todo = (
            todo.join(left, "a", "left")
            .join(right, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
            .checkpoint()
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = nodes.select("node", F.col("node").alias("component"))
    for hook in maps:
        step = hook.select(F.col("node").alias("component"), F.col("root").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
