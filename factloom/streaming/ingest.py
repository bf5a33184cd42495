"""Notes as a stream: the same fold, batch by batch, with every batch committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.ingest.fold import Embed, Judge, opposites
from factloom.ingest.reading import Reader
from factloom.ingest.job import empty_state, fold_groups, latest_rows, payloads, with_payload


#: Batches after which the changes are folded into one base.
COMPACT_AFTER = 20


class StateTable:
    """A group's folded state as a base and the changes of each batch since; a version is there or it is not.

    A batch writes what it changed, and reads the state of its own groups alone:
    its cost follows the batch, not the state. Every COMPACT_AFTER versions a new
    base is written beside the old files, which stay for readers of older versions.
    """

    def __init__(self, spark: SparkSession, path: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, prefix: str) -> list[int]:
        p, fs = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[0]))

    def versions(self) -> list[int]:
        return self._numbers("v=")

    def read(self, before: int | None = None, groups: DataFrame | None = None) -> DataFrame:
        """The state after the versions before one, or after all; of some groups(group_id) only, if they are given."""
        upto = [v for v in self.versions() if before is None or v < before]
        bases = [v for v in self._numbers("base=") if upto and v <= upto[-1]]
        out = self.spark.read.parquet(f"{self.path}/base={bases[-1]}") if bases else empty_state(self.spark)
        later = [v for v in upto if not bases or v > bases[-1]]
        keep = (lambda df: df) if groups is None else (lambda df: df.join(groups.select("group_id").distinct(), "group_id", "left_semi"))
        out = keep(out).select("kind", "group_id", "row", F.lit(-1).alias("n"))
        for v in later:
            out = out.unionByName(keep(self.spark.read.parquet(f"{self.path}/v={v}")).select("kind", "group_id", "row", F.lit(v).alias("n")))
        return latest_rows(out) if later else out.drop("n")

    def write(self, version: int, changes: DataFrame) -> None:
        """The rows that a batch changed, and now and then a base."""
        changes.where("kind <> 'episode'").select("kind", "group_id", "row").write.mode("overwrite").parquet(f"{self.path}/v={version}")
        since = [v for v in self.versions() if v > max(self._numbers("base=") or [-1])]
        if len(since) >= self.compact_after:
            self.read(version + 1).write.mode("overwrite").parquet(f"{self.path}/base={version}")


def ingest_batch(table: StateTable, notes: DataFrame, version: int, log: str, judge: Judge = opposites, extractor=payloads, embed: Embed | None = None, reader: Reader | None = None) -> None:
    """Folds one batch into the state as a version; doing it again gives the same files."""
    if version in table.versions():
        return
    held = table.read(version, notes)
    fold_groups(with_payload(notes, extractor), held, judge, embed, reader).write.mode("overwrite").parquet(f"{log}/v={version}")
    table.write(version, table.spark.read.parquet(f"{log}/v={version}"))


def start(notes: DataFrame, table: StateTable, log: str, checkpoint: str, judge: Judge = opposites, extractor=payloads, available_now: bool = True, embed: Embed | None = None, reader: Reader | None = None) -> StreamingQuery:
    """A streaming query over notes(uuid, group_id, content, valid_at, created_at).

    Late notes are folded by what they say about time, so no watermark drops
    them. The batch id is the version: after a crash the batch is folded again
    from the version before it.
    """
    writer = notes.writeStream.foreachBatch(lambda df, n: ingest_batch(table, df, n, log, judge, extractor, embed, reader)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and window, batch or stream; in a stream rows later than the watermark are past."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if own.isStreaming else own
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
