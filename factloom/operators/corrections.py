"""Manual corrections, later values of a slot, and forgetting an episode, as set-valued jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import SINGLE_VALUED, normalise_relation
from factloom.operators.temporal import instant, is_retracted

REASON_CHARS = 120
# Attributes that belong to a closure.
CLOSURE_MARKS = ("invalidatedBy", "retracted", "reopenedAs", "closedBy", "closedAt", "closedByEpisode", "previousEnd", "outdatedWhenWritten")
EPISODE_MARKS = ("closedByEpisode", "previousEnd")


def _mark(name: str) -> Column:
    return F.get_json_object(F.coalesce("attributes", F.lit("{}")), f"$.{name}")


def _flag(name: str) -> Column:
    """Whether a mark is the boolean true; a text that says so is none."""
    return F.coalesce(F.from_json("attributes", f"`{name}` boolean")[name], F.lit(False))


def _marks(drop: tuple[str, ...], **more: Column) -> Column:
    """The attributes without some marks and with others, nulls left out; all other values stay as they are, whatever their type."""
    held = F.coalesce(F.from_json("attributes", "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))
    held = F.map_filter(held, lambda k, v: ~k.isin(*drop, *more))
    if not more:
        return F.to_json(held)
    added = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in more.items()])), "map<string,variant>")
    return F.to_json(F.map_concat(held, added))


def _said(reason: str | Column) -> Column:
    return F.substring(reason if isinstance(reason, Column) else F.lit(reason), 1, REASON_CHARS)


def _with_marks(facts: DataFrame) -> DataFrame:
    return facts if "attributes" in facts.columns else facts.withColumn("attributes", F.lit(None).cast("string"))


def _targets(facts: DataFrame, targets: DataFrame, value: str | None, reason: str) -> DataFrame:
    """facts with what targets(uuid, value, reason) ask of them, as __value and __reason.

    Of targets that repeat an id the earliest value counts, with its reason; a null
    value counts only where there is no other. Without a column reason all have
    the one given.
    """
    why = F.coalesce(F.col("reason"), F.lit(reason)) if "reason" in targets.columns else F.lit(reason)
    kind = dict(targets.dtypes)[value] if value else "timestamp_ntz"
    asked = targets.select("uuid", (F.col(value) if value else F.lit(None)).cast(kind).alias("v"), why.alias("r"))
    first = asked.groupBy("uuid").agg(F.min(F.struct(F.col("v").isNull().alias("none"), "v", "r")).alias("a"))
    return _with_marks(facts).join(first.select("uuid", F.col("a.v").alias("__value"), F.col("a.r").alias("__reason")), "uuid")


def end_facts(facts: DataFrame, targets: DataFrame, now, reason: str = "") -> DataFrame:
    """The changed rows of ending targets(uuid, at[, reason]): those that cannot end there are refused.

    Refused are retracted facts, facts that ended at or before `at` or in the
    past, and ends at or before the start. A null `at` is now. Adds outcome:
    ended, or conflict with the row as it was. A fact that is ended so is no
    episode's closure any more: those marks go, and the reason is written.
    """
    found = _targets(facts, targets, "at", reason).withColumn("__at", F.coalesce("__value", instant(now)))
    over = F.coalesce(F.col("invalid_at") <= F.greatest("__at", instant(now)), F.lit(False))
    refused = is_retracted() | over | F.coalesce(F.col("__at") <= F.col("valid_at"), F.lit(False))
    out = found.withColumn("outcome", F.when(refused, "conflict").otherwise("ended"))
    ended = F.col("outcome") == "ended"
    return (
        out.withColumn("invalid_at", F.when(ended, F.col("__at")).otherwise(F.col("invalid_at")))
        .withColumn("expired_at", F.when(ended, instant(now)).otherwise(F.col("expired_at")))
        .withColumn("attributes", F.when(ended, _marks(EPISODE_MARKS, invalidatedBy=_said(F.col("__reason")))).otherwise(F.col("attributes")))
        .drop("__at", "__value", "__reason")
    )


def retract_facts(facts: DataFrame, targets: DataFrame, now, reason: str = "") -> DataFrame:
    """The changed rows of withdrawing targets(uuid[, reason]): an empty window, learned now, with the reason; retracted ones give no row."""
    found = _targets(facts, targets, None, reason).where(~is_retracted())
    return (
        found.withColumn("invalid_at", F.col("valid_at"))
        .withColumn("expired_at", instant(now))
        .withColumn("attributes", _marks(EPISODE_MARKS, retracted=F.lit(True), invalidatedBy=_said(F.col("__reason"))))
        .withColumn("outcome", F.lit("retracted"))
        .drop("__value", "__reason")
    )


def _reopened(closed: DataFrame, end: str, why: str, now) -> DataFrame:
    """Two rows for each closed fact: the old one withdrawn, and a copy created now that ends at column end.

    Each names the other: the old row keeps its end and its reason as marks, the
    copy has none of the closure's.
    """
    both = closed.withColumn("__copy", F.concat(F.col("uuid"), F.lit("#"), F.date_format(instant(now), "yyyyMMddHHmmssSSS")))
    reason = _said(F.col(why))
    shown = F.substring(F.concat(F.lit("reopened as "), F.substring("__copy", 1, 8), F.lit(": "), reason), 1, REASON_CHARS)
    former = F.when(~is_retracted(), F.date_format("invalid_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    old = (
        both.withColumn("attributes", _marks((), retracted=F.lit(True), reopenedAs=F.col("__copy"), invalidatedBy=shown, closedBy=_mark("invalidatedBy"), closedAt=former))
        .withColumn("expired_at", F.when(is_retracted(), F.col("expired_at")).otherwise(instant(now)))
        .withColumn("invalid_at", F.when(is_retracted(), F.col("invalid_at")).otherwise(F.col("valid_at")))
        .withColumn("outcome", F.lit("withdrawn"))
    )
    copy = (
        both.withColumn("attributes", _marks((*CLOSURE_MARKS, "reopenedFrom", "reopenReason"), reopenedFrom=F.col("uuid"), reopenReason=reason))
        .withColumn("uuid", F.col("__copy"))
        .withColumn("invalid_at", F.col(end))
        .withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))
        .withColumn("created_at", instant(now))
        .withColumn("outcome", F.lit("reopened"))
    )
    return old.unionByName(copy).drop("__copy")


def reopen_facts(facts: DataFrame, targets: DataFrame, now, reason: str = "") -> DataFrame:
    """Two rows for each of targets(uuid, invalid_at[, reason]) that has ended or was retracted: the old one withdrawn, a copy created now.

    A target that was reopened before, that is open, or whose new end is not after
    its start, is refused: one row as it was, with outcome conflict.
    """
    found = _targets(facts, targets, "invalid_at", reason).withColumnRenamed("__value", "__end")
    shut = (is_retracted() | F.col("invalid_at").isNotNull()) & _mark("reopenedAs").isNull()
    fits = F.col("__end").isNull() | F.coalesce(F.col("__end") > F.col("valid_at"), F.lit(True))
    refused = found.where(~(shut & fits)).withColumn("outcome", F.lit("conflict"))
    return _reopened(found.where(shut & fits), "__end", "__reason", now).unionByName(refused).drop("__end", "__reason")


def forget_preview(facts: DataFrame, episode: str) -> DataFrame:
    """(uuid, change, remaining) for the facts that cite an episode: retracted where it is the only evidence, else unlinked."""
    cited = facts.where(F.array_contains("episodes", episode))
    rest = F.array_remove(F.col("episodes"), episode)
    return cited.select("uuid", F.when(F.size(rest) == 0, "retracted").otherwise("unlinked").alias("change"), F.size(rest).alias("remaining"))


def later_values(facts: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(uuid, next_at): where a later value of a one-valued slot begins, retracted facts and gone(uuid) left out.

    A slot is a source and a relation, whose spelling is normalised. It has one
    value at a time by its relation, or where either of two facts is flagged as
    replacing what was before: so a fact that is not asks only for flagged values.
    Starts and the instants that are asked for are sorted together once a slot,
    backwards, and the last start that was passed is kept: a known start asks for a
    start behind it, an unknown one for a start at or after the fact's end. A value
    that was written later with the same start counts too.
    """
    own = _with_marks(facts).withColumn("__rel", normalise_relation(F.col("name"))).withColumn("__flag", _flag("replacesPrevious"))
    own = own.withColumn("__one", F.col("__rel").isin(*SINGLE_VALUED))
    values = own.where(~is_retracted() & F.col("valid_at").isNotNull())
    if gone is not None:
        values = values.join(gone.select("uuid"), "uuid", "left_anti")
    slot = ["source_node_uuid", "__rel"]
    flagged = F.when(F.col("__flag"), F.col("created_at"))
    starts = values.groupBy(*slot, F.col("valid_at").alias("t")).agg(F.max("created_at").alias("last"), F.max(flagged).alias("flagged_last"), F.max("__flag").alias("flagged"))
    asked = own.select(*slot, F.col("uuid").cast("string").alias("uuid"), F.coalesce("valid_at", "invalid_at").alias("t"), F.when(F.col("valid_at").isNull(), 0).otherwise(2).alias("k"), (F.col("__one") | F.col("__flag")).alias("all"), "created_at")
    asked = asked.where("t is not null").join(starts.select(*slot, "t", "last", "flagged_last"), [*slot, "t"], "left")
    points = starts.select(*slot, "t", F.lit(1).alias("k"), "flagged")
    both = asked.withColumn("flagged", F.lit(None).cast("boolean")).unionByName(points, allowMissingColumns=True)
    passed = Window.partitionBy(*slot).orderBy(F.col("t").desc(), F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("k") == 1, F.col("t"))
    seen = both.withColumn("__any", F.last(start, ignorenulls=True).over(passed)).withColumn("__some", F.last(F.when(F.col("flagged"), start), ignorenulls=True).over(passed)).where("k <> 1")
    since = F.when(F.col("all"), F.col("last")).otherwise(F.col("flagged_last"))
    same = (F.col("k") == 2) & F.coalesce(since > F.col("created_at"), F.lit(False))
    after = F.when(F.col("all"), F.col("__any")).otherwise(F.col("__some"))
    kind = dict(facts.dtypes)["uuid"]
    return seen.select(F.col("uuid").cast(kind).alias("uuid"), F.when(same, F.col("t")).otherwise(after).alias("next_at")).where("next_at is not null")


@dataclass
class Forgotten:
    """The rows that forgetting an episode changes, and what it reports."""

    facts: DataFrame  # whole rows, with outcome: retracted, unlinked, withdrawn, reopened
    report: DataFrame  # (uuid, outcome): retracted, unlinked, reopened, still_closed, unmarked
    entities: DataFrame  # whole rows whose summary comes back
    orphaned: DataFrame  # (uuid): what the episode made and nothing uses
    episode: DataFrame  # the episode as forgotten, or outcome not_found or conflict


def forget_episode(facts: DataFrame, entities: DataFrame, episodes: DataFrame, episode: str, reason: str, now) -> Forgotten:
    """What forgetting an episode does to its group's facts(episodes, attributes, ...) and entities(attributes, ...).

    A fact that only it supports is retracted; one that others support as well
    loses it. A fact that it closed is opened again, up to the end it had before
    or to the next value of its slot, whichever is sooner; where another value
    that still stands took over by then, it stays closed. Closures from before such marks were
    written are only reported. A summary that it replaced comes back, and
    entities that it made and nothing uses any more are reported.

    Only the facts that the episode closed, a few, look for other values of their
    slots, by an equi-join on source and relation.
    """
    why = F.lit(f"forgotten episode {episode[:8]}: {reason[:REASON_CHARS]}"[:REASON_CHARS])
    outdated = _flag("outdatedWhenWritten") & is_retracted()
    cited, rest = F.array_contains("episodes", episode), F.array_remove("episodes", episode)
    own = facts.withColumn("__cited", F.coalesce(cited, F.lit(False))).withColumn("__only", F.coalesce(cited, F.lit(False)) & (F.size(rest) == 0)).withColumn("__outdated", outdated).withColumn("__gone", is_retracted())
    own = own.withColumn("__closed", F.col("invalid_at").isNotNull() & (~F.col("__gone") | F.col("__outdated")) & _mark("reopenedAs").isNull()).withColumn("__by", _mark("closedByEpisode"))

    sole = own.where("__only and (not __gone or __closed and __outdated)")
    retracted = (
        sole.withColumn("expired_at", F.when(F.col("__outdated"), F.col("expired_at")).otherwise(instant(now)))
        .withColumn("invalid_at", F.col("valid_at"))
        .withColumn("attributes", _marks((*EPISODE_MARKS, "outdatedWhenWritten"), retracted=F.lit(True), invalidatedBy=why))
        .withColumn("outcome", F.lit("retracted"))
    )
    kept = own.where("not __only")
    shut = kept.where((F.col("__by") == episode) & F.col("__closed")).withColumn("__rel", normalise_relation(F.col("name")))
    other = own.where("not __only and not __gone and valid_at is not null").select(
        F.col("uuid").alias("__u"), F.col("source_node_uuid").alias("__s"), normalise_relation(F.col("name")).alias("__r"), F.col("valid_at").alias("__v"), F.col("invalid_at").alias("__i"), F.col("created_at").alias("__c"),
        _flag("replacesPrevious").alias("__replaces"),
    )
    single = F.col("__rel").isin(*SINGLE_VALUED) | _flag("replacesPrevious") | F.coalesce("__replaces", F.lit(False))
    met = shut.join(other, (F.col("source_node_uuid") == F.col("__s")) & (F.col("__rel") == F.col("__r")) & (F.col("uuid") != F.col("__u")), "left")
    after = F.when(F.col("valid_at").isNotNull(), (F.col("__v") > F.col("valid_at")) | ((F.col("__v") == F.col("valid_at")) & (F.col("__c") > F.col("created_at")))).otherwise(F.col("__v") >= F.col("invalid_at"))
    there = (F.col("__v") <= F.col("valid_at")) & (F.col("__i").isNull() | (F.col("valid_at") < F.col("__i")))
    seen = met.groupBy("uuid").agg(F.min(F.when(single & after, F.col("__v"))).alias("__next"), F.max(F.coalesce(single & there, F.lit(False))).alias("__there"))
    previous = F.to_timestamp_ntz(_mark("previousEnd"))
    before = F.when(F.col("valid_at").isNull() | (previous > F.col("valid_at")), previous)
    judged = shut.join(seen, "uuid").withColumn("__end", F.least(before, "__next"))  # least() passes over nulls
    taken = F.when(F.col("__outdated"), F.col("__there")).otherwise(F.col("__next").isNotNull() & F.coalesce(F.col("__end") <= F.col("invalid_at"), F.lit(False)))
    judged = judged.withColumn("__taken", taken)

    opened = judged.where("not __taken")
    pair = _reopened(opened.withColumn("__why", why), "__end", "__why", now)
    pair = pair.withColumn("episodes", F.when(F.col("outcome") == "reopened", rest).otherwise(F.col("episodes")))
    still = judged.where("__taken")
    loose = kept.join(judged.select("uuid"), "uuid", "left_anti").where("__cited").unionByName(still.where("__cited").select(*kept.columns))
    unlinked = loose.withColumn("episodes", rest).withColumn("outcome", F.lit("unlinked"))
    # Closures without a mark, of the instants at which the episode's own facts were written.
    written = own.where((F.element_at("episodes", 1) == episode) & _mark("reopenedFrom").isNull()).select(F.col("created_at").alias("__at")).distinct()
    unmarked = kept.where("__closed and __by is null").join(written, F.col("expired_at") == F.col("__at"), "left_semi")

    columns = [*facts.columns, "outcome"]
    changed = retracted.select(*columns).unionByName(unlinked.select(*columns)).unionByName(pair.select(*columns))
    said = lambda df, outcome: df.select("uuid", F.lit(outcome).alias("outcome"))
    report = said(sole, "retracted").unionByName(said(loose, "unlinked")).unionByName(said(opened, "reopened")).unionByName(said(still, "still_closed")).unionByName(said(unmarked, "unmarked"))

    used = own.where("not __gone and not __only").select(F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("uuid")).distinct()
    by, former = _mark("summaryByEpisode"), F.coalesce(_mark("previousSummary"), F.lit(""))
    back = F.coalesce(by == episode, F.lit(False)) & (former != F.col("summary"))
    nodes = entities.withColumn("__back", back).withColumn("__summary", F.when(back, former).otherwise(F.col("summary")))
    summaries = nodes.where("__back").withColumn("summary", F.col("__summary")).withColumn("attributes", _marks(("summaryByEpisode", "previousSummary"))).select(*entities.columns)
    orphaned = nodes.where((_mark("createdByEpisode") == episode) & (F.col("__summary") == "")).join(used, "uuid", "left_anti").select("uuid")
    mine = episodes.where(F.col("uuid") == episode)
    over = F.coalesce(F.col("status") == "forgotten", F.lit(False))
    mine = mine.withColumn("outcome", F.when(over, "conflict").otherwise("forgotten")).withColumn("error", F.lit(reason[:REASON_CHARS])).withColumn("status", F.lit("forgotten"))
    return Forgotten(changed, report, summaries, orphaned, mine)

