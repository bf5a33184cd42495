"""What an extractor is told about a group before it reads a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.vectors import cosine
from factloom.operators.graph import SRC, TGT, adjacency
from factloom.operators.search import naming_entities
from factloom.operators.temporal import is_live

NAMED, RANKED, READ_CHARS = 200, 50, 2000
FACT_ENTITIES, FACTS = 30, 50


def known_entities(entities: DataFrame, content: str, vector: list[float] | None = None, named: int = NAMED, ranked: int = RANKED) -> DataFrame:
    """entities that a text names, the longest name first, then others, with position from 1.

    Others are all where they are few, else those whose name vector is nearest to
    the vector of the text's first READ_CHARS characters. Each part is a top-k, so
    a group of any size ends as at most named + ranked rows.
    """
    own = naming_entities(entities, content)
    first = own.orderBy(F.length("name").desc(), "uuid").limit(named)
    others = entities.join(first.select("uuid"), "uuid", "left_anti")
    few = others.limit(ranked + 1).count() <= ranked
    if few:
        rest = others.withColumn("__by", F.lit(0.0))
    elif vector is None or "name_embedding" not in entities.columns:
        rest = others.limit(0).withColumn("__by", F.lit(0.0))
    else:
        q = F.array(*[F.lit(float(x)) for x in vector])
        rest = others.where(F.size("name_embedding") > 0).withColumn("__by", cosine(F.col("name_embedding"), q)).orderBy(F.col("__by").desc(), "uuid").limit(ranked)
    both = first.withColumn("__part", F.lit(0)).withColumn("__by", F.length("name").cast("double")).unionByName(rest.withColumn("__part", F.lit(1)))
    order = Window.orderBy("__part", F.col("__by").desc(), "uuid")  # named + ranked rows at most
    return both.withColumn("position", F.row_number().over(order)).drop("__part", "__by")


def known_facts(facts: DataFrame, relevant: DataFrame, entities: DataFrame, now, most_entities: int = FACT_ENTITIES, most: int = FACTS) -> DataFrame:
    """Live facts around the first of relevant(uuid, position), each once, in the entities' order: names, relation, text, start.

    The few entities are broadcast to the facts; the result is a top-k.
    """
    first = relevant.where(F.col("position") <= most_entities).select(F.col("uuid").alias("node"), "position")
    met = adjacency(facts.where(is_live(now))).join(F.broadcast(first), "node")
    once = met.groupBy("uuid", SRC, TGT, "name", "fact", "valid_at", "created_at").agg(F.min("position").alias("position"))
    top = once.orderBy("position", "created_at", "uuid").limit(most)
    names = entities.select(F.col("uuid").alias("__id"), F.col("name").alias("__name"))
    for end, col in (("source", SRC), ("target", TGT)):
        top = names.join(F.broadcast(top), F.col(col) == F.col("__id"), "right").withColumn(f"{end}_name", F.coalesce("__name", F.lit(""))).drop("__id", "__name")
    return top.select("uuid", "position", "source_name", "target_name", F.col("name").alias("relation"), "fact", "valid_at")
