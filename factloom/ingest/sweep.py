"""Failed and waiting episodes of a store, fed to the fold again and committed, once or on a schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.ingest.job import rows_of
from factloom.ingest.lifecycle import SWEEP, refed, to_feed
from factloom.operators.ranking import shared_checkpoint
from factloom.operators.stats import MOST_ATTEMPTS
from factloom.schema import ENTITIES, FACTS
from factloom.sources.store import Store

JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}


def state_of(store: Store, groups: DataFrame, upto: int | None = None) -> DataFrame:
    """What the fold reads of some groups(group_id): entities, facts and the keys of processed episodes as rows of JSON."""
    own = groups.select("group_id").distinct()
    part = lambda name, kind: store.read(name, upto=upto).join(own, "group_id", "left_semi").select(F.lit(kind).alias("kind"), "group_id", "created_at", "uuid", F.to_json(F.struct("*"), JSON).alias("row"))
    done = store.read("episodes", upto=upto).where("coalesce(status, 'processed') = 'processed' and content_hash is not null").join(own, "group_id", "left_semi")
    keys = done.select(F.lit("key").alias("kind"), "group_id", F.to_json(F.struct(F.col("content_hash").alias("key"))).alias("row"))
    rows = part("entities", "entity").unionByName(part("facts", "fact")).orderBy("created_at", "uuid").drop("created_at", "uuid")
    return rows.unionByName(keys)


def sweep(store: Store, attempts: int = MOST_ATTEMPTS, limit: int | None = SWEEP, recover: bool = False) -> int | None:
    """One pass: at most limit failed episodes below their attempts, on recovery all that wait, folded and committed with their status as one version.

    Gives the version, or None where there was nothing to feed. When another writer
    commits meanwhile, the pass is done again from what that one left.
    """

    def make(head: int) -> dict[str, DataFrame] | None:
        episodes = store.read("episodes", upto=head)
        again = shared_checkpoint(to_feed(episodes, attempts, limit, recover))
        if again.isEmpty():
            return None
        changes, after = refed(episodes, state_of(store, again, head), attempts, limit, recover)
        changes = shared_checkpoint(changes)
        outcomes = changes.where("kind = 'episode'").select("uuid")
        return {"episodes": after.join(outcomes, "uuid", "left_semi"), "entities": rows_of(changes, "entity", ENTITIES), "facts": rows_of(changes, "fact", FACTS)}

    return store.transact(make)


def sweeping(store: Store, checkpoint: str, every: str = "30 seconds", attempts: int = MOST_ATTEMPTS, limit: int | None = SWEEP) -> StreamingQuery:
    """A query that sweeps on a schedule until it is stopped; passes never overlap."""
    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda _ticks, _batch: sweep(store, attempts, limit) and None
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
