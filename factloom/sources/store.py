"""The versioned append log: keyed upserts, deletions, snapshots and migration over Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from factloom.schema import ENTITIES, EPISODES, FACTS

TABLES = {"episodes": EPISODES, "entities": ENTITIES, "facts": FACTS}
#: Columns that a later version of a row does not change, and those that it changes only where it has a value.
FIXED = {
    "episodes": ("group_id", "source", "source_description", "content", "valid_at", "created_at"),
    "entities": ("uuid", "group_id", "created_at"),
    "facts": ("group_id", "source_node_uuid", "target_node_uuid", "created_at"),
}
FILLED = {"entities": ("name_embedding",), "facts": ("fact_embedding",)}
#: A filled column that is kept only beside the value it was made from.
MADE_FROM = {"fact_embedding": "fact"}


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The current rows of an append log: the last version of each key, deletions left out.

    max_by over a struct is summed before the shuffle, so a key with many versions
    moves once per task.
    """
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    out = last.select(key, "row.*")
    return out.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in rest else out


def merged(log: DataFrame, key: str, order: list[str], fixed: tuple[str, ...] = (), filled: tuple[str, ...] = (), made_from: dict[str, str] | None = None) -> DataFrame:
    """The current rows of an append log, each column by its own rule: the first value (fixed), the last that is not null (filled), or the last.

    A deletion ends a row: what is written after it is a new one. A filled column
    that is made from another, such as the vector of a text, is null once that
    one has changed without it. All rules are max_by and min_by, which are summed
    before the shuffle, so that a key with many versions moves once a task.
    """
    at = F.struct(*order)
    own = log
    if "deleted" in log.columns:
        gone = log.where("deleted").groupBy(key).agg(F.max(at).alias("__gone"))
        own = log.join(gone, key, "left").where(F.col("__gone").isNull() | (at > F.col("__gone"))).drop("deleted", "__gone")
    made_from = {c: f for c, f in (made_from or {}).items() if c in filled and c in own.columns}
    rest = [c for c in own.columns if c != key]
    firsts = [c for c in rest if c in fixed]
    kept = [c for c in rest if c in filled and c not in fixed]
    lasts = [c for c in rest if c not in firsts and c not in kept]
    sums = [F.min_by(F.struct(*firsts), at).alias("__first")] if firsts else []
    sums += [F.max_by(F.struct(*lasts), at).alias("__last")] if lasts else []
    for c in kept:
        value = F.struct(F.col(c).alias("v"), F.col(made_from[c]).alias("of")) if c in made_from else F.struct(F.col(c).alias("v"))
        sums.append(F.max_by(value, F.when(F.col(c).isNotNull(), at)).alias(f"__kept_{c}"))
    out = own.groupBy(key).agg(*sums)
    value = lambda c: F.col(f"__first.{c}") if c in firsts else F.col(f"__last.{c}") if c in lasts else F.when(F.col(f"__kept_{c}.of").eqNullSafe(F.col(f"__last.{made_from[c]}")), F.col(f"__kept_{c}.v")) if c in made_from else F.col(f"__kept_{c}.v")
    return out.select(key, *[value(c).alias(c) for c in rest])


def entity_map(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """(old_uuid, uuid): entities of the same group and name, whatever its case, are one; the stored id stays."""
    own = incoming.select(F.col("group_id").alias("g"), F.lower("name").alias("n"), F.col("uuid").alias("old_uuid"))
    held = current.groupBy(F.col("group_id").alias("g"), F.lower("name").alias("n")).agg(F.min("uuid").alias("held"))
    first = own.groupBy("g", "n").agg(F.min("old_uuid").alias("first"))
    return own.join(held, ["g", "n"], "left").join(first, ["g", "n"]).select("old_uuid", F.coalesce("held", "first").alias("uuid"))


class Conflict(RuntimeError):
    """Others committed first, again and again."""


class Store:
    """Episodes, entities and facts as append-only Parquet logs under one folder.

    A commit writes the files of one version for all tables, in folders of its own
    attempt, and then a marker that names the attempt; readers see only versions
    that have their marker, so a batch appears whole or not at all. The marker is
    created only where there is none: of two writers of one version the first one's
    files count, and the other knows. A marker without content, left by a writer
    that died, takes its number and no more. commit() is for versions that the
    caller numbers (a batch id), where repeating one is harmless; transact() numbers
    them itself and does the work again when another writer was faster.
    """

    tables, parted = TABLES, ("group_id",)

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _taken(self) -> dict[int, int]:
        """All numbers that have a marker, with its length."""
        p, fs = self._fs(f"{self.path}/_commits")
        names = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []
        return {int(n): size for n, size in names if n.isdigit()}

    def versions(self) -> list[int]:
        return sorted(v for v, size in self._taken().items() if size)

    def _attempt(self, version: int) -> str:
        p, fs = self._fs(f"{self.path}/_commits/{version}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, version: int, attempt: str) -> bool:
        """Creates a version's marker; False if it is there."""
        p, fs = self._fs(f"{self.path}/_commits/{version}")
        fs.mkdirs(p.getParent())
        if fs.getUri().getScheme() == "file" and not self.spark._jvm.java.io.File(p.toUri().getPath()).createNewFile():  # which the file system does at once
            return False
        try:
            out = fs.create(p, fs.getUri().getScheme() == "file")
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        out.write(bytearray(attempt.encode()))
        out.close()
        return True

    def _write(self, version: int, rows: dict[str, DataFrame]) -> str:
        attempt = uuid.uuid4().hex
        for name, df in rows.items():
            own = df if "deleted" in df.columns else df.withColumn("deleted", F.lit(False))
            own = own.withColumn("seq", F.lit(version).cast("long"))
            own.write.mode("overwrite").partitionBy(*self.parted).parquet(f"{self.path}/{name}/v={version}-{attempt}")
        return attempt

    def commit(self, version: int, **rows: DataFrame) -> bool:
        """Appends changed rows (deleted rows have deleted true) as one version; False, and nothing new, if it is there."""
        return version not in self._taken() and self._publish(version, self._write(version, rows))

    def transact(self, make: Callable[[int], dict[str, DataFrame] | None], tries: int = 5) -> int | None:
        """Commits make(head), the rows that follow from the state up to version head, as the next version, and gives its number.

        When another writer took that number, the work is done again from the state
        that this one left; nothing of the lost attempt is seen. None from make
        commits nothing.
        """
        for _ in range(tries):
            taken = self._taken()
            head = max((v for v, size in taken.items() if size), default=-1)
            rows = make(head)
            if rows is None:
                return None
            version = max(taken, default=-1) + 1
            attempt = self._write(version, rows)
            if max((v for v, size in self._taken().items() if size), default=-1) == head and self._publish(version, attempt):
                return version
        raise Conflict(f"{tries} attempts were overtaken")

    def log(self, name: str, upto: int | None = None) -> DataFrame:
        """All versions of a table, or those up to one: the state at any commit can be read again."""
        wanted = [v for v in self.versions() if upto is None or v <= upto]
        paths = [p for p in (f"{self.path}/{name}/v={v}-{self._attempt(v)}" for v in wanted) if self._exists(p)]
        schema = StructType([*self.tables[name], StructField("deleted", BooleanType()), StructField("seq", LongType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths).select(*[f.name for f in schema])

    def read(self, name: str, group: str | None = None, upto: int | None = None) -> DataFrame:
        """The current rows of a table, merged column by column; entities are unique by group and name, whatever its case."""
        log = self.log(name, upto)
        log = log if group is None else log.where(F.col("group_id") == group)
        rules = {"order": ["seq"], "fixed": FIXED[name], "filled": FILLED.get(name, ()), "made_from": MADE_FROM}
        if name == "entities":
            return merged(log.withColumn("__key", F.concat_ws("\x00", "group_id", F.lower("name"))), "__key", **rules).drop("__key", "seq")
        return merged(log, "uuid", **rules).drop("seq")

    def reset(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def health(self) -> dict:
        facts = self.read("facts").select(F.count(F.lit(1)).alias("n"), F.max(F.size("fact_embedding")).alias("dims")).first()
        return {"facts": facts["n"], "dims": facts["dims"] or 0}

    def episodes(self, group: str | None = None) -> DataFrame:
        return self.read("episodes", group).orderBy("created_at", "uuid")

    def entities(self, group: str | None = None) -> DataFrame:
        return self.read("entities", group).orderBy("created_at", "uuid")

    def facts(self, group: str | None = None) -> DataFrame:
        """Facts whose ends name entities by the id that stayed, also where a fact cites one that lost to an equal name."""
        log = self.log("entities").withColumn("__key", F.concat_ws("\x00", "group_id", F.lower("name")))
        first = log.groupBy("__key").agg(F.min_by("uuid", "seq").alias("__uuid"))
        lost = log.select("uuid", "__key").distinct().join(first, "__key").where("uuid <> __uuid").select(F.col("uuid").alias("__lost"), "__uuid")
        own = self.read("facts", group)
        for end in ("source_node_uuid", "target_node_uuid"):
            own = own.join(lost, F.col(end) == F.col("__lost"), "left").withColumn(end, F.coalesce("__uuid", end)).drop("__lost", "__uuid")
        return own.orderBy("created_at", "uuid")

    def dump_document(self, path: str) -> None:
        """A JSON snapshot as a single document: one task writes it line by line, and no row holds it whole."""
        lines = None
        for k, name in enumerate(TABLES):
            own = self.read(name)
            rows = own.select(F.lit(2 * k + 1).alias("part"), F.col("uuid").alias("at"), F.to_json(F.struct(*own.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("text"))
            w = Window.orderBy("part", "at")
            head = self.spark.createDataFrame([(2 * k, "", ("{" if not k else ", ") + f'"{name}": [')], "part int, at string, text string")
            last = self.spark.createDataFrame([(2 * k + 1, "\uffff", "]")], "part int, at string, text string")
            every = head.unionByName(rows).unionByName(last)
            lines = every if lines is None else lines.unionByName(every)
        lines = lines.unionByName(self.spark.createDataFrame([(2 * len(TABLES), "", "}")], "part int, at string, text string"))
        before = F.lag("part").over(w)
        comma = (F.col("part") % 2 == 1) & (before == F.col("part")) & (F.col("at") != "\uffff")
        text = lines.select("part", "at", F.concat(F.when(comma, ",").otherwise(""), "text").alias("value"))
        text.coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)

    def dump(self, path: str) -> None:
        """A JSON snapshot: a folder of lines per table."""
        for name in TABLES:
            self.read(name).write.mode("overwrite").json(f"{path}/{name}")

    def load(self, path: str, version: int = 0) -> None:
        self.commit(version, **{n: self.spark.read.schema(s).json(f"{path}/{n}") for n, s in TABLES.items()})


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a single JSON document {episodes: [...], entities: [...], facts: [...]}."""
    whole = StructType([StructField(n, ArrayType(s)) for n, s in TABLES.items()])
    doc = spark.read.schema(whole).option("multiLine", True).json(path)
    return {n: doc.select(F.explode(n).alias("r")).select("r.*") for n in TABLES}


def migrate(source: dict[str, DataFrame], target: Store, version: int) -> dict[str, int]:
    """Moves a snapshot into a store: names merge with stored entities, facts follow, dangling ones are left out.

    Running it again changes nothing: rows keep their ids.
    """
    ids = entity_map(source["entities"], target.read("entities"))
    merged = source["entities"].withColumnRenamed("uuid", "old_uuid").join(ids, "old_uuid")
    entities = merged.select(*[f.name for f in ENTITIES]).dropDuplicates(["uuid"])
    s, t = (ids.select(F.col("old_uuid").alias(f"__{k}"), F.col("uuid").alias(f"__{k}n")) for k in "st")
    facts = source["facts"].join(s, F.col("source_node_uuid") == F.col("__s")).join(t, F.col("target_node_uuid") == F.col("__t"))
    facts = facts.withColumn("source_node_uuid", F.col("__sn")).withColumn("target_node_uuid", F.col("__tn")).select(*[f.name for f in FACTS])
    target.commit(version, episodes=source["episodes"], entities=entities, facts=facts)
    counts = {"episodes": source["episodes"].count(), "entities": entities.count(), "facts": facts.count()}
    return counts | {"skipped": source["facts"].count() - counts["facts"]}
