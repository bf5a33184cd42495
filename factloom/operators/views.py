"""What the reading surface shows: rows of facts, entities and episodes, cards and the graph view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import SRC, TGT, degrees, edges, entity_card, graph_counts, isolated, label_histogram, primary_label, timeline
from factloom.operators.ranking import shared_checkpoint, shared_table
from factloom.operators.temporal import ends_at, revised_later, validity_label, with_names

CARD_EPISODES, LINE_EPISODES, SHORT_ID, GRAPH_EDGES = 50, 3, 8, 500


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def fact_rows(facts: DataFrame, entities: DataFrame | None = None, missing: str | None = None) -> DataFrame:
    """Facts as they are shown: names beside ids, and the reason of an end from the attributes.

    Without entities, facts bring source_name and target_name.
    """
    named = facts if entities is None else with_names(facts, entities, missing)
    reason = F.get_json_object("attributes", "$.invalidatedBy") if "attributes" in facts.columns else F.lit(None).cast("string")
    return named.select(
        "uuid", F.col("name").alias("relation"), F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.col(SRC).alias("source_uuid"), F.col(TGT).alias("target_uuid"),
        "fact", "valid_at", "invalid_at", "created_at", "expired_at", _or_null(facts, "episodes", "array<string>"), _or_null(facts, "score", "double"), reason.alias("reason"),
    )


def graph_edges(facts: DataFrame, entities: DataFrame, at, as_of, history: bool = False, limit: int | None = None) -> DataFrame:
    """Drawable facts with their state, the end that was known then, and whether they were corrected later."""
    shown = edges(facts, entities, at, as_of, history, limit)
    return shown.withColumn("ends_at", ends_at(as_of)).withColumn("revised_later", revised_later(as_of))


def entity_rows(entities: DataFrame) -> DataFrame:
    return entities.select("uuid", "name", "labels", "summary", "created_at")


def episode_rows(episodes: DataFrame) -> DataFrame:
    """Episodes as they are shown; those without a status were processed."""
    texts = [_or_null(episodes, c, "string") for c in ("name", "source", "source_description")]
    return episodes.select("uuid", "group_id", *texts, "content", "valid_at", "created_at", F.coalesce("status", F.lit("processed")).alias("status"), _or_null(episodes, "error", "string"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def fact_line(now, zone: str = "UTC") -> Column:
    """One row of fact_rows() as a line: short id, ends and relation, text, window, and the episodes it came from."""
    line = F.concat(
        F.lit("["), F.substring("uuid", 1, SHORT_ID), F.lit("] "), F.col("source"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("target"),
        F.lit(' | "'), F.col("fact"), F.lit('" | '), validity_label(now, zone),
    )
    cited = F.coalesce("episodes", F.array().cast("array<string>"))
    short = F.array_join(F.transform(F.slice(cited, 1, LINE_EPISODES), lambda e: F.substring(e, 1, SHORT_ID)), ", ")
    more = F.size(cited) - LINE_EPISODES
    return F.when(F.size(cited) == 0, line).otherwise(F.concat(line, F.lit(" | ep "), short, F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")))


def facts_of_episode(facts: DataFrame, episode: str) -> DataFrame:
    """Facts that cite an episode: those it stated first, and those it reinforced."""
    own = facts.where(F.array_contains("episodes", episode))
    return own.withColumn("part", F.when(F.element_at("episodes", 1) == episode, "facts").otherwise("reinforced"))


def card_episodes(facts: DataFrame, episodes: DataFrame, as_of, limit: int = CARD_EPISODES) -> DataFrame:
    """The episodes that some facts cite and that were there at as_of, the newest first, at most limit, with truncated."""
    cited = facts.select(F.explode("episodes").alias("uuid")).distinct()
    found = episodes.join(cited, "uuid", "left_semi").where(F.col("created_at") <= F.lit(str(as_of)).cast("timestamp_ntz"))
    top = found.orderBy(F.col("valid_at").desc(), "uuid").limit(limit + 1)
    more = top.agg((F.count(F.lit(1)) > limit).alias("truncated"))  # one row
    return top.orderBy(F.col("valid_at").desc(), "uuid").limit(limit).crossJoin(F.broadcast(more))


@dataclass
class Card:
    """An entity with its facts at an instant, in a card's order, and the episodes that they come from."""

    entity: DataFrame  # one row, or none
    facts: DataFrame  # rows as they are shown, with state, ends_at, revised_later and position
    episodes: DataFrame  # rows as they are shown, with position and truncated


def card(facts: DataFrame, entities: DataFrame, episodes: DataFrame, uuid: str, at, as_of, limit: int = CARD_EPISODES) -> Card:
    """All that is known of one entity: facts that touch it by state, start and learning, and the newest episodes that these cite."""
    shown = entity_card(facts, entities, uuid, at, as_of)
    placed = shown.select("uuid", "state", "position", ends_at(as_of).alias("ends_at"), revised_later(as_of).alias("revised_later"))
    rows = fact_rows(shown.drop("source_name", "target_name", "state", "position"), entities, "").join(placed, "uuid")
    cited = card_episodes(shown, episodes, as_of, limit)
    order = Window.orderBy(F.col("valid_at").desc(), "uuid")  # limit rows at most
    numbered = cited.select("uuid", F.row_number().over(order).alias("position"), "truncated")
    notes = episode_rows(cited).join(numbered, "uuid")
    return Card(entity_rows(entities.where(F.col("uuid") == uuid)), rows, notes)


@dataclass
class GraphView:
    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame
    valid: DataFrame
    known: DataFrame
    counts: DataFrame


def graph_view(facts: DataFrame, entities: DataFrame, at, as_of, history: bool = False, limit: int = GRAPH_EDGES, with_isolated: bool = False) -> GraphView:
    """What a picture of one group shows: at most limit edges, their nodes with degrees, labels, instants and counts.

    Entities without a shown edge fill what limit leaves of the nodes, the latest
    learned first. counts says whether anything was cut off. The shown edges are
    at most limit rows, so their ends are broadcast. Entities, and the ids of
    drawable edges, are read by several of the results: they are written once.
    """
    entities = shared_table(entities, "entities")
    every = graph_edges(facts, entities, at, as_of, history)
    first = [(F.col("state") == "active").desc(), F.col("created_at").desc(), "uuid"]
    drawn = shared_table(every.select("uuid", "group_id", SRC, TGT, "state", "created_at"), "edges")
    placed = shared_checkpoint(drawn.orderBy(*first).limit(limit))
    degree = F.broadcast(shared_checkpoint(degrees(placed)))
    joined = entities.join(degree, "uuid")
    alone = isolated(entities, degree, as_of, limit) if with_isolated else entities.limit(0)
    nodes = joined.unionByName(alone.withColumn("degree", F.lit(0).cast("long")).select(*joined.columns))
    nodes = nodes.select("uuid", "name", "labels", "summary", "created_at", primary_label(F.col("labels")).alias("label"), "degree")
    drawable = drawn.groupBy("group_id").agg(F.count(F.lit(1)).alias("drawable"))
    lonely = isolated(entities, degree, as_of).groupBy("group_id").agg(F.count(F.lit(1)).alias("lonely"))
    room = F.greatest(F.lit(limit) - F.col("nodes"), F.lit(0))
    counts = graph_counts(facts, entities, placed).join(drawable, "group_id", "left").join(lonely, "group_id", "left").fillna(0, ["drawable", "lonely"])
    cut = F.col("drawable") > F.col("edges")
    if with_isolated:
        filled = F.least("lonely", room)
        counts = counts.withColumn("truncated", cut | (F.col("lonely") > filled)).withColumn("nodes", F.col("nodes") + filled)
    else:
        counts = counts.withColumn("truncated", cut)
    shown = every.orderBy(*first).limit(limit)
    return GraphView(nodes, shown, label_histogram(entities), timeline(facts, "valid_at", "invalid_at"), timeline(facts, "created_at", "expired_at"), counts.drop("drawable", "lonely"))

