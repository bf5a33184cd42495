"""The two-axis time model as Column expressions.

A fact is true in the world in [valid_at, invalid_at) and was learned at
created_at; expired_at is when its end or its retraction was learned. All
functions take instants as Columns or timestamps and never read the clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def _yes(condition: Column) -> Column:
    """A condition over columns that may be null: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def is_known(as_of, prefix: str = "") -> Column:
    """Learned by as_of; a fact without a creation time always was."""
    created = _c(prefix, "created_at")
    return created.isNull() | _yes(created <= instant(as_of))


def _end_known(as_of, prefix: str) -> Column:
    return _yes(F.coalesce(_c(prefix, "expired_at"), _c(prefix, "created_at")) <= instant(as_of)) | (_c(prefix, "expired_at").isNull() & _c(prefix, "created_at").isNull())


def is_active(at, as_of, prefix: str = "") -> Column:
    """True in the world at `at`, as the system believed at `as_of`."""
    valid, invalid, expired = (_c(prefix, n) for n in ("valid_at", "invalid_at", "expired_at"))
    started = valid.isNull() | _yes(valid <= instant(at))
    over = F.when(invalid.isNotNull(), _yes(invalid <= instant(at)) & _end_known(as_of, prefix)).otherwise(_yes(expired <= instant(as_of)))
    return is_known(as_of, prefix) & started & ~over


def is_retracted(prefix: str = "") -> Column:
    """An empty window, or expired without an end."""
    valid, invalid, expired = (_c(prefix, n) for n in ("valid_at", "invalid_at", "expired_at"))
    return F.when(invalid.isNotNull(), _yes(invalid <= valid)).otherwise(expired.isNotNull())


def state(at, as_of, prefix: str = "") -> Column:
    """active, future, ended or retracted; null while the fact is not known."""
    valid, invalid, expired = (_c(prefix, n) for n in ("valid_at", "invalid_at", "expired_at"))
    retraction = is_retracted(prefix) & _yes(expired <= instant(as_of))
    ended = invalid.isNotNull() & _end_known(as_of, prefix) & _yes(invalid <= instant(at))
    return F.when(is_known(as_of, prefix), F.when(retraction, "retracted").when(ended, "ended").when(_yes(valid > instant(at)), "future").otherwise("active"))


def ends_at(as_of, prefix: str = "") -> Column:
    """The end, where it was known at as_of."""
    return F.when(_end_known(as_of, prefix), _c(prefix, "invalid_at"))


def revised_later(as_of, prefix: str = "") -> Column:
    return _yes(_c(prefix, "expired_at") > instant(as_of))


def covers(at, prefix: str = "") -> Column:
    valid, invalid = _c(prefix, "valid_at"), _c(prefix, "invalid_at")
    return (valid.isNull() | _yes(valid <= instant(at))) & (invalid.isNull() | _yes(instant(at) < invalid))


def is_live(now, prefix: str = "") -> Column:
    """Active now, or starting later and active at its start."""
    valid = _c(prefix, "valid_at")
    return is_active(now, now, prefix) | (_yes(valid > instant(now)) & is_active(valid, now, prefix))


def scope(facts: DataFrame, group: str | None, at=None, as_of=None, history: bool = False) -> DataFrame:
    """The filter every search shares; history drops the valid-time axis."""
    if group is not None:
        facts = facts.where(F.col("group_id") == group)
    if history:
        return facts if as_of is None else facts.where(is_known(as_of))
    return facts.where(is_active(at, as_of if as_of is not None else at))


def validity_label(now, zone: str = "UTC", prefix: str = "") -> Column:
    """A fact's window in words, by calendar days of a zone; an unknown start is a question mark."""
    day = lambda c: F.date_format(F.from_utc_timestamp(c.cast("timestamp"), zone), "yyyy-MM-dd")
    valid, invalid = _c(prefix, "valid_at"), _c(prefix, "invalid_at")
    start = F.coalesce(day(valid), F.lit("?"))
    return (
        F.when(is_retracted(prefix), "retracted")
        .when(_yes(invalid > instant(now)), F.concat(F.lit("since "), start, F.lit(", until "), day(invalid)))
        .when(invalid.isNotNull(), F.concat(F.lit("true "), start, F.lit(" → "), day(invalid)))
        .when(_yes(valid > instant(now)), F.concat(F.lit("from "), start))
        .when(valid.isNotNull(), F.concat(F.lit("since "), start))
        .otherwise("still true")
    )


def reference_time(at: Column, zone: str = "UTC") -> Column:
    """An instant as the wall clock of a zone shows it, with its distance from UTC and the day of the week: 2024-03-01T14:30:00+05:30 (Friday)."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), at)
    minutes = F.timestamp_diff("MINUTE", F.date_trunc("second", at).cast("timestamp_ntz"), F.date_trunc("second", local).cast("timestamp_ntz"))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    away = F.concat(F.when(minutes < 0, "-").otherwise("+"), two(F.floor(F.abs(minutes) / 60)), F.lit(":"), two(F.abs(minutes) % 60))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), away, F.lit(" ("), F.date_format(local, "EEEE"), F.lit(")"))


def with_names(facts: DataFrame, entities: DataFrame, missing: str | None = None) -> DataFrame:
    """Adds source_name and target_name; a name that is not there is `missing`, or the id where that is None."""
    names = entities.select(F.col("uuid").alias("__id"), F.col("name").alias("__name"))
    for end in ("source", "target"):
        other = F.lit(missing) if missing is not None else F.col(f"{end}_node_uuid")
        facts = facts.join(names, F.col(f"{end}_node_uuid") == F.col("__id"), "left").withColumn(f"{end}_name", F.coalesce("__name", other)).drop("__id", "__name")
    return facts


def facts_at(facts: DataFrame, entities: DataFrame, at, as_of=None, group: str | None = None, limit: int | None = None) -> DataFrame:
    """Facts active at (at, as_of) with the names of their ends; a limit takes the newest."""
    found = scope(facts, group, at, as_of)
    if limit is not None:
        found = found.orderBy(F.col("created_at").desc(), "uuid").limit(limit)
    return with_names(found, entities, "")


def normalise_window(start: Column, end: Column, episode: Column) -> tuple[Column, Column, Column]:
    """(valid_at, invalid_at, dated_by_episode) of a statement made in an episode."""
    no_start = start.isNull()
    over = no_start & _yes(end <= episode)
    valid = F.when(over, F.lit(None).cast("timestamp_ntz")).when(no_start, episode).when(_yes(end < start), F.lit(None).cast("timestamp_ntz")).otherwise(start)
    invalid = F.when(_yes(end == start), start + F.expr("INTERVAL 1 DAY")).otherwise(end)
    return valid, invalid, no_start & ~over


def supersede_chain(events: DataFrame, slot: list[str], order: list[str], start: str) -> DataFrame:
    """A one-valued slot, totally ordered: every value ends where the next one begins."""
    from pyspark.sql import Window

    return events.withColumn("invalid_at", F.lead(start).over(Window.partitionBy(*slot).orderBy(*order)))
