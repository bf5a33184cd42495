"""Lookups by id, id prefix and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A prefix has at least so many characters.
LEAST_PREFIX = 8
#: Ids that are written into the plan; more are joined.
LISTED_IDS = 1000


def by_uuid(rows: DataFrame, uuid: str) -> DataFrame:
    """The row with an id: an equality that reaches the scan."""
    return rows.where(F.col("uuid") == uuid).limit(1)


def by_uuids(rows: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """The rows with any of the ids: a short list is a pushed filter, ids(uuid) a semi-join."""
    if isinstance(ids, list):
        if len(ids) <= LISTED_IDS:
            return rows.where(F.col("uuid").isin(ids))
        ids = rows.sparkSession.createDataFrame([(i,) for i in set(ids)], "uuid string")
    return rows.join(ids.select("uuid").distinct(), "uuid", "left_semi")


def by_prefix(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, outcome, matches, uuid) for each of prefixes(prefix): found, not_found, ambiguous or too_short.

    Rows are met by their first LEAST_PREFIX characters, so a lookup of many
    prefixes is one equi-join and never compares all with all.
    """
    asked = prefixes.select("prefix", F.lower(F.trim("prefix")).alias("__p")).distinct()
    own = rows.select("uuid", F.lower("uuid").alias("__u"))
    head = F.substring("__p", 1, LEAST_PREFIX) == F.substring("__u", 1, LEAST_PREFIX)
    met = asked.where(F.length("__p") >= LEAST_PREFIX).join(own, head).where(F.col("__u").startswith(F.col("__p")))
    counted = met.groupBy("prefix").agg(F.count_distinct("uuid").alias("matches"), F.min("uuid").alias("uuid"))
    out = asked.join(counted, "prefix", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    outcome = F.when(F.length("__p") < LEAST_PREFIX, "too_short").when(F.col("matches") == 0, "not_found").when(F.col("matches") > 1, "ambiguous").otherwise("found")
    return out.select("prefix", outcome.alias("outcome"), "matches", F.when(F.col("matches") == 1, F.col("uuid")).alias("uuid"))


def naming(rows: DataFrame, text: str, columns: tuple[str, ...] = ("name", "summary")) -> DataFrame:
    """Rows that hold a text in any of the columns, whatever its case; an empty text holds for all."""
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return rows.where(hit)


def first_of_each(sources: list[DataFrame], key: str = "uuid") -> DataFrame:
    """All rows of the sources, each key from the first source that has it, with the source's number."""
    numbered = [s.withColumn("origin", F.lit(k)) for k, s in enumerate(sources)]
    both = numbered[0]
    for more in numbered[1:]:
        both = both.unionByName(more)
    rest = [F.col(c) for c in both.columns if c not in (key, "origin")]
    w = Window.partitionBy(key).orderBy("origin", *rest)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
