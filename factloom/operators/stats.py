"""Group-level aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.temporal import is_active

MOST_ATTEMPTS = 3


def group_stats(episodes: DataFrame, entities: DataFrame, facts: DataFrame, now, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """A row per group: episodes by status, given-up ones, entities, facts, active and historical facts."""
    status = F.coalesce("status", F.lit("processed"))
    e = episodes.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("episodes"), *[F.count_if(status == s).alias(s) for s in ("pending", "processed", "failed", "forgotten")],
        F.count_if((status == "failed") & (F.col("attempts") >= attempts)).alias("given_up"), F.max("created_at").alias("last_episode"),
    )
    n = entities.groupBy("group_id").agg(F.count(F.lit(1)).alias("entities"))
    f = facts.groupBy("group_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if(is_active(now, now)).alias("active"))
    out = e.join(n, "group_id", "full").join(f, "group_id", "full")
    counts = [c for c in out.columns if c not in ("group_id", "last_episode")]
    return out.fillna(0, counts).withColumn("historical", F.col("facts") - F.col("active"))


def failed_counts(episodes: DataFrame, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    failed = episodes.where(F.col("status") == "failed")
    return failed.agg(F.count(F.lit(1)).alias("failed"), F.count_if(F.col("attempts") >= attempts).alias("given_up"))


def all_groups(*tables: DataFrame) -> DataFrame:
    ids = [t.select("group_id").distinct() for t in tables]
    out = ids[0]
    for more in ids[1:]:
        out = out.union(more)
    return out.distinct()


def common_length(rows: DataFrame, vector: str, order: str) -> DataFrame:
    """The most common vector length; among equals the one seen first."""
    own = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return own.orderBy(F.col("n").desc(), "first").limit(1).select("dims", "n")


def retrieval_metrics(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row: queries, passes, hit rate in the first k, forbidden hits.

    results(query_id, rank, text); gold(query_id, expect array, forbid array). A
    query passes if every expected string is in some result of the first k and no
    forbidden one is; one that expects nothing passes if it has no result.
    """
    top = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list("text").alias("texts"))
    joined = gold.join(top, "query_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    hit = F.forall("expect", lambda e: F.exists("texts", lambda t: t.contains(e)))
    bad = F.exists("forbid", lambda e: F.exists("texts", lambda t: t.contains(e)))
    wants = F.size("expect") > 0
    passed = F.when(wants, hit & ~bad).otherwise((F.size("texts") == 0) & ~bad)
    return joined.agg(F.count(F.lit(1)).alias("queries"), F.count_if(passed).alias("passed"), F.count_if(wants & hit).alias("hits"), F.count_if(bad).alias("forbidden"))


def recent_episodes(episodes: DataFrame, limit: int = 20) -> DataFrame:
    """The newest episodes of each group."""
    w = Window.partitionBy("group_id").orderBy(F.col("created_at").desc(), "uuid")
    return episodes.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def retry_candidates(episodes: DataFrame, attempts: int = MOST_ATTEMPTS, limit: int | None = None) -> DataFrame:
    found = episodes.where((F.col("status") == "failed") & (F.col("attempts") < attempts)).orderBy("created_at", "uuid")
    return found if limit is None else found.limit(limit)
