"""From a text that arrives to an episode's status, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import idempotency_key
from factloom.operators.stats import MOST_ATTEMPTS, retry_candidates

ERROR_CHARS, SWEEP = 500, 5


def stored_key(episodes: DataFrame) -> DataFrame:
    """episodes with key: the stored one; one from before keys carried a day gets the day of its episode."""
    bare = ~F.col("content_hash").contains("@") & ~F.col("content_hash").startswith("key:")
    return episodes.withColumn("key", F.when(bare, F.concat("content_hash", F.lit("@"), F.date_format("valid_at", "yyyy-MM-dd"))).otherwise(F.col("content_hash")))


def save(incoming: DataFrame, episodes: DataFrame) -> DataFrame:
    """What becomes of incoming(uuid, group_id, content, valid_at, created_at, explicit_key): one row each, with key, outcome and episode.

    The first stored episode with the same key that was processed makes a text a
    duplicate; else the first one that failed or waits is taken again: retry or
    pending. Forgotten episodes do not count. Texts that arrive together under one
    key: the first is new and the others wait for it.
    """
    asked = incoming.withColumn("key", idempotency_key(F.col("content"), F.col("valid_at"), F.col("explicit_key")))
    status = F.coalesce("status", F.lit("processed"))
    old = stored_key(episodes.withColumn("__status", status).where("__status <> 'forgotten'"))
    order = F.struct((F.col("__status") != "processed").alias("open"), F.col("created_at"), F.col("uuid"))
    first = old.groupBy("group_id", "key").agg(F.min_by(F.struct("uuid", "__status"), order).alias("held"))
    w = Window.partitionBy("group_id", "key").orderBy("created_at", "uuid")
    placed = asked.join(first, ["group_id", "key"], "left").withColumn("__n", F.row_number().over(w)).withColumn("__first", F.first("uuid").over(w))
    outcome = (
        F.when(F.col("held.__status") == "processed", "duplicate").when(F.col("held.__status") == "failed", "retry").when(F.col("held").isNotNull(), "pending")
        .when(F.col("__n") == 1, "new").otherwise("pending")
    )
    return placed.select("uuid", "group_id", "key", outcome.alias("outcome"), F.coalesce("held.uuid", "__first").alias("episode"))


def finished(episodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """episodes after outcomes(uuid, status, error) of an attempt: counted, with the error's first characters, or none."""
    done = outcomes.select("uuid", F.col("status").alias("__status"), F.substring("error", 1, ERROR_CHARS).alias("__error"))
    tried = F.col("__status").isNotNull()
    return (
        episodes.join(done, "uuid", "left")
        .withColumn("attempts", F.when(tried, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")))
        .withColumn("status", F.coalesce("__status", "status"))
        .withColumn("error", F.when(tried, F.when(F.col("__status") == "failed", F.col("__error"))).otherwise(F.col("error")))
        .drop("__status", "__error")
    )


def to_feed(episodes: DataFrame, attempts: int = MOST_ATTEMPTS, limit: int | None = SWEEP, recover: bool = False) -> DataFrame:
    """The episodes that a pass feeds to the fold again: failed ones below their attempts, the oldest first, at most limit; on recovery all that wait as well."""
    found = retry_candidates(episodes, attempts, limit).withColumn("why", F.lit("retry"))
    return found.unionByName(episodes.where(F.col("status") == "pending").withColumn("why", F.lit("recover"))) if recover else found


def refed(episodes: DataFrame, state: DataFrame, attempts: int = MOST_ATTEMPTS, limit: int | None = SWEEP, recover: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes of folding to_feed(), the episodes after it)."""
    from factloom.ingest.job import fold_groups, with_payload

    again = to_feed(episodes, attempts, limit, recover)
    changes = fold_groups(with_payload(again), state)
    outcomes = changes.where("kind = 'episode'").select("uuid", "status", F.get_json_object("row", "$.error").alias("error"))
    return changes, finished(episodes, outcomes)


def job_counts(jobs: DataFrame, group: str | None = None) -> DataFrame:
    """One row: jobs that wait and jobs that run, of all groups or of one."""
    own = jobs if group is None else jobs.where(F.col("group_id") == group)
    return own.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))
