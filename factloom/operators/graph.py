"""Graph lookups: neighbours, distances, degrees, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ranking import global_rank
from factloom.operators.temporal import is_active, is_known, state, with_names

SRC, TGT = "source_node_uuid", "target_node_uuid"
#: Points that a timeline shows at most: evenly spread, with the first and the last.
TIMELINE_POINTS = 1000


def adjacency(facts: DataFrame) -> DataFrame:
    """A row for each end of each fact: node, other and the fact's columns; a self-loop gives one."""
    ends = F.array_distinct(F.array(F.struct(F.col(SRC).alias("node"), F.col(TGT).alias("other")), F.struct(F.col(TGT).alias("node"), F.col(SRC).alias("other"))))
    return facts.withColumn("__end", F.explode(ends)).select("*", "__end.node", "__end.other").drop("__end")


def facts_for_entity(facts: DataFrame, uuid: str) -> DataFrame:
    return facts.where((F.col(SRC) == uuid) | (F.col(TGT) == uuid))


def facts_between(facts: DataFrame, a: str, b: str, at, as_of) -> DataFrame:
    """Active facts between a pair, in either direction."""
    pair = ((F.col(SRC) == a) & (F.col(TGT) == b)) | ((F.col(SRC) == b) & (F.col(TGT) == a))
    return facts.where(pair & is_active(at, as_of))


def touching(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with either end among ids(uuid), each once; facts are read once."""
    own = ids.where("uuid is not null").select(F.col("uuid").alias("__s"), F.col("uuid").alias("__t")).distinct()
    met = facts.join(own.select("__s"), F.col(SRC) == F.col("__s"), "left").join(own.select("__t"), F.col(TGT) == F.col("__t"), "left")
    return met.where("__s is not null or __t is not null").drop("__s", "__t")


def neighbours(facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct ids one fact away from anchors(uuid), anchors left out."""
    own = anchors.select(F.col("uuid").alias("__id")).distinct()
    ends = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = facts.select(F.inline(F.array(ends(SRC, TGT), ends(TGT, SRC))))
    return both.join(own, F.col("a") == F.col("__id"), "left_semi").join(own, F.col("b") == F.col("__id"), "left_anti").select(F.col("b").alias("uuid")).distinct()


def graph_distance(facts: DataFrame, anchors: DataFrame, near: DataFrame) -> DataFrame:
    """facts with distance: 0 at an anchor, 1 at a neighbour of one, else null."""
    marks = anchors.select("uuid", F.lit(0).alias("d")).union(near.select("uuid", F.lit(1))).groupBy("uuid").agg(F.min("d").alias("d"))
    left = marks.select(F.col("uuid").alias("__s"), F.col("d").alias("__ds"))
    right = marks.select(F.col("uuid").alias("__t"), F.col("d").alias("__dt"))
    joined = facts.join(left, F.col(SRC) == F.col("__s"), "left").join(right, F.col(TGT) == F.col("__t"), "left")
    return joined.withColumn("distance", F.least("__ds", "__dt")).drop("__s", "__ds", "__t", "__dt")


def edges(facts: DataFrame, entities: DataFrame, at, as_of, history: bool = False, limit: int | None = None) -> DataFrame:
    """Drawable facts with their state, active ones first, then the latest learned; facts without both ends are left out."""
    names = entities.select(F.col("uuid").alias("__id"), F.col("name").alias("__n"))
    both = facts
    for end, col in (("source", SRC), ("target", TGT)):
        both = both.join(names, F.col(col) == F.col("__id")).withColumn(f"{end}_name", F.col("__n")).drop("__id", "__n")
    seen = both.withColumn("state", state(at, as_of)).where(F.col("state").isNotNull())
    seen = seen if history else seen.where(F.col("state") == "active")
    if limit is not None:
        seen = seen.orderBy((F.col("state") == "active").desc(), F.col("created_at").desc(), "uuid").limit(limit)
    return seen


def degrees(shown: DataFrame) -> DataFrame:
    """(uuid, degree): a self-loop counts twice."""
    return shown.select(F.explode(F.array(SRC, TGT)).alias("uuid")).groupBy("uuid").agg(F.count(F.lit(1)).alias("degree"))


def isolated(entities: DataFrame, degree: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """Entities known at as_of without a shown fact, the latest first; they fill what limit leaves."""
    rest = entities.join(degree.select("uuid"), "uuid", "left_anti").where(is_known(as_of))
    if limit is None:
        return rest
    room = max(0, limit - degree.count())
    return rest.orderBy(F.col("created_at").desc(), "uuid").limit(room)


def primary_label(labels: Column) -> Column:
    return F.coalesce(F.get(F.filter(labels, lambda x: x != "Entity"), F.lit(0)), F.lit("Entity"))


def label_histogram(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    return entities.groupBy(*(by or []), primary_label(F.col("labels")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def timeline(facts: DataFrame, first: str, second: str, points: int = TIMELINE_POINTS, group: str = "group_id") -> DataFrame:
    """(group_id, moment): the distinct instants of two columns, at most `points` a group, evenly spread.

    The distinct instants are counted first, so that only groups over the bound
    are numbered; ranks come from counts per day and ranks within a day.
    """
    at = facts.select(group, F.explode(F.array(first, second)).alias("moment")).where("moment is not null").distinct()
    day = at.withColumn("day", F.to_date("moment"))
    before = day.groupBy(group, "day").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("total", F.sum("n").over(Window.partitionBy(group))).drop("n")
    own = F.row_number().over(Window.partitionBy(group, "day").orderBy("moment")) - 1
    ranked = day.withColumn("own", own).join(before, [group, "day"]).withColumn("r", F.col("before") + F.col("own"))
    step = (F.col("total") - 1) / F.lit(points - 1)
    nearest = F.round(F.col("r") / step)
    hit = F.floor(nearest * step + 0.5) == F.col("r")
    near = F.floor((nearest - 1) * step + 0.5) == F.col("r")
    after = F.floor((nearest + 1) * step + 0.5) == F.col("r")
    return ranked.where((F.col("total") <= points) | hit | near | after).select(group, "moment")


def graph_counts(facts: DataFrame, entities: DataFrame, shown: DataFrame) -> DataFrame:
    """Per group: entities, facts, nodes, edges, hidden edges."""
    nodes = shown.select("group_id", F.explode(F.array(SRC, TGT)).alias("uuid")).groupBy("group_id").agg(F.count_distinct("uuid").alias("nodes"))
    out = entities.groupBy("group_id").agg(F.count(F.lit(1)).alias("entities"))
    out = out.join(facts.groupBy("group_id").agg(F.count(F.lit(1)).alias("facts")), "group_id", "full").join(shown.groupBy("group_id").agg(F.count(F.lit(1)).alias("edges")), "group_id", "full").join(nodes, "group_id", "full")
    out = out.fillna(0, ["entities", "facts", "edges", "nodes"])
    return out.withColumn("hidden_edges", F.col("facts") - F.col("edges"))


def entity_card(facts: DataFrame, entities: DataFrame, uuid: str, at, as_of) -> DataFrame:
    """The facts of one entity with state and end, in the order of a card: state, start (unknown last), learned."""
    order = F.when(F.col("state") == "active", 0).when(F.col("state") == "future", 1).when(F.col("state") == "ended", 2).otherwise(3)
    seen = with_names(facts_for_entity(facts, uuid), entities, "").withColumn("state", state(at, as_of)).where(F.col("state").isNotNull())
    return global_rank(seen, [order, F.col("valid_at").desc_nulls_last(), F.col("created_at").desc(), "uuid"], "position")


def same_slot_conflicts(facts: DataFrame) -> DataFrame:
    """Slots (source, relation) with more than one target at a time: (source, name, a, b), overlapping windows."""
    own = facts.select("uuid", SRC, TGT, "name", "valid_at", "invalid_at")
    other = own.select(F.col("uuid").alias("b"), F.col(SRC).alias("__s"), F.col(TGT).alias("__t"), F.col("name").alias("__n"), F.col("valid_at").alias("__v"), F.col("invalid_at").alias("__i"))
    overlap = (F.col("__v").isNull() | F.col("invalid_at").isNull() | (F.col("__v") < F.col("invalid_at"))) & (F.col("valid_at").isNull() | F.col("__i").isNull() | (F.col("valid_at") < F.col("__i")))
    met = own.join(other, (F.col(SRC) == F.col("__s")) & (F.col("name") == F.col("__n")) & (F.col(TGT) < F.col("__t")))
    return met.where(overlap).select(SRC, "name", F.col("uuid").alias("a"), "b")


def slot_conflicts(facts: DataFrame) -> DataFrame:
    """(uuid, conflicts, cluster): for each fact the facts of its slot with another target that hold at the same time, counted, not listed.

    A slot is a source and a relation. Of facts with windows [s, e), those that meet
    one's window are all that begin before its end less those that are over by its
    start; the same count within the target is taken off. cluster is the least id of
    the facts that a chain of meeting windows joins, whatever their targets: all that
    conflict with each other share it. A slot is sorted a few times, and no pair is
    made. Empty windows meet nothing, and are clusters of their own.
    """
    first, last = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    own = facts.select("uuid", SRC, TGT, "name", F.coalesce("valid_at", first).alias("s"), F.coalesce("invalid_at", last).alias("e"))
    real = own.where("s < e")

    def meeting(rows: DataFrame, by: list[str], out: str) -> DataFrame:
        """rows with out: how many others of the same group hold at some instant of each one's window."""
        starts = rows.select(*by, F.col("s").alias("t"), F.lit(1).alias("begun"), F.lit(0).alias("over"))
        ends = rows.select(*by, F.col("e").alias("t"), F.lit(0).alias("begun"), F.lit(1).alias("over"))
        moments = starts.unionByName(ends).groupBy(*by, "t").agg(F.sum("begun").alias("begun"), F.sum("over").alias("over"))
        before = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        at = moments.select(*by, "t", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("begun_before"), F.sum("over").over(upto).alias("over_by"))
        joined = rows.join(at.select(*by, F.col("t").alias("s"), "over_by"), [*by, "s"]).join(at.select(*by, F.col("t").alias("e"), "begun_before"), [*by, "e"])
        return joined.withColumn(out, F.col("begun_before") - F.col("over_by") - 1).drop("begun_before", "over_by")

    slot = [SRC, "name"]
    counted = meeting(meeting(real, slot, "__all"), [*slot, TGT], "__same")
    order = Window.partitionBy(*slot).orderBy("s", "e", "uuid")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (reached.isNull() | (F.col("s") >= reached)).cast("int")
    chained = counted.withColumn("__new", begins).withColumn("__chain", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    least = chained.groupBy(*slot, "__chain").agg(F.min("uuid").alias("cluster"))
    met = chained.join(least, [*slot, "__chain"]).select("uuid", (F.col("__all") - F.col("__same")).alias("conflicts"), "cluster")
    return met.unionByName(own.where("s >= e").select("uuid", F.lit(0).cast("long").alias("conflicts"), F.col("uuid").alias("cluster")))


def next_value(facts: DataFrame) -> DataFrame:
    """facts with next_at: the next later start in the slot of its source and relation."""
    starts = facts.where("valid_at is not null").select(SRC, "name", "valid_at").distinct()
    later = starts.withColumn("next_at", F.lead("valid_at").over(Window.partitionBy(SRC, "name").orderBy("valid_at")))
    return facts.join(later, [SRC, "name", "valid_at"], "left")
