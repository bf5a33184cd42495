"""The fold of many notes into groups that are new: notes of one source of statements apart from those of another.

What a statement or an end does depends on earlier ones of its source or of its
pair of ends. In a group where each note speaks of one source, and no source is
told of by another one, the sources are parts that can be folded apart. What
parts share are the entities that their statements are about: whether one is
known, and since which note, is found before the fold, and what all notes make
of it is summed up beside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import idempotency_key
from factloom.ingest.extract import extraction
from factloom.ingest.fold import Entity, hashed, opposites
from factloom.ingest.job import CHANGES, _time, entity_row, folded
from factloom.operators.ranking import shared_table

#: Groups that are folded whole and are told to all tasks; if more are, all groups are.
MOST_WHOLE = 100_000
#: Notes that a task folds, about; a shuffle's own tasks are put together by their bytes, but a fold costs time.
NOTES_A_TASK = 50_000
NOTE = ("group_id", "created_at", "uuid", "content", "valid_at", "payload", "key")


def _read(notes: DataFrame) -> DataFrame:
    """notes with payload, part (their source, or nothing), others (what is said to be at the other ends), listed (low, name, labels, summary) and plain.

    What the built-in extractor lists is at an end of something, is described and is
    no literal. A note is plain if it speaks of one source at most and cannot fail.
    """
    found = notes.withColumn("x", extraction(F.col("content")))
    ends = lambda name: F.array_distinct(F.concat(*[F.transform(f"x.{part}", lambda r: F.lower(r[name])) for part in ("facts", "invalidations")]))
    plain = (F.size("sources") <= 1) & F.col("valid_at").isNotNull() & F.col("created_at").isNotNull()
    listed = F.transform("x.entities", lambda e: F.struct(F.lower(e["name"]).alias("low"), e["name"].alias("name"), e["labels"].alias("labels"), e["summary"].alias("summary")))
    told = found.select(*(c for c in NOTE if c != "payload"), F.to_json("x").alias("payload"), ends("source_name").alias("sources"), ends("target_name").alias("others"), listed.alias("listed"))
    return told.select("*", plain.alias("plain"), F.coalesce(F.get("sources", F.lit(0)), F.lit("")).alias("part")).drop("sources")


def _first_notes(read: DataFrame) -> DataFrame:
    """One row of each key: its first note, whether all of them are of one part and plain."""
    order = F.struct("created_at", "uuid")
    key = F.coalesce("key", F.concat(F.lit("note:"), "uuid"))
    agreed = (F.min("part") == F.max("part")) & F.min("plain")
    first = F.min_by(F.struct("created_at", "uuid", "part", "others", "listed"), order)
    return read.groupBy("group_id", key.alias("key")).agg(first.alias("first"), agreed.alias("agreed")).select("group_id", "first.*", "agreed")


def _names(first: DataFrame) -> DataFrame:
    """Each name of a group: its first and last part, whether it is a source and whether it is at another end, and the note that lists it first, with what this lists before it."""
    at = lambda k: F.transform(F.slice("listed", 1, k), lambda e: e["low"])
    kind = "struct<created_at:timestamp_ntz,uuid:string,name:string,before:array<string>>"
    listed = F.transform("listed", lambda e, k: F.struct(e["low"].alias("low"), F.struct("created_at", "uuid", e["name"].alias("name"), at(k).alias("before")).cast(kind).alias("made")))
    named = F.concat(F.when(F.col("part") == "", F.array().cast("array<string>")).otherwise(F.array("part")), "others")
    unlisted = F.transform(F.array_except(named, F.transform("listed", lambda e: e["low"])), lambda n: F.struct(n.alias("low"), F.lit(None).cast(kind).alias("made")))
    rows = first.select("group_id", "part", "others", F.explode(F.concat(listed, unlisted)).alias("n")).select("group_id", "part", "n.*", (F.col("n.low") == F.col("part")).alias("source"), F.array_contains("others", F.col("n.low")).alias("other"))
    return rows.groupBy("group_id", "low").agg(F.min("made").alias("made"), F.min("part").alias("one_part"), F.max("part").alias("last_part"), F.max("source").alias("source"), F.max("other").alias("other"))


def _shared(names: DataFrame) -> DataFrame:
    """(group_id, low, created_at, made_by, name, id) of the entities that more than one part names; an entity's id has its number among those that its note makes."""
    own = names.where("one_part <> last_part and made is not null").select("group_id", "low", "made.*")
    made = names.where("made is not null").select(F.col("group_id").alias("__group"), F.col("low").alias("__low"), F.col("made.uuid").alias("__by"))
    earlier = own.select("group_id", "low", "created_at", F.col("uuid").alias("made_by"), "name", F.explode_outer("before").alias("__before"))
    met = earlier.join(made, (F.col("group_id") == F.col("__group")) & (F.col("__before") == F.col("__low")) & (F.col("made_by") == F.col("__by")), "left")
    counted = met.groupBy("group_id", "low", "created_at", "made_by", "name").agg(F.count("__by").alias("__n"))
    return counted.select("group_id", "low", "created_at", "made_by", "name", F.concat("made_by", F.lit("/e"), F.col("__n").cast("string")).alias("id"))


def _summed(first: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of the shared entities after all notes: every label in the order of its first note, the last summary and the one before it."""
    listed = first.select("group_id", "created_at", "uuid", F.explode("listed").alias("e")).select("group_id", F.col("created_at").alias("at"), "uuid", "e.low", "e.labels", "e.summary")
    met = listed.join(shared.select("group_id", "low"), ["group_id", "low"], "left_semi")
    w = Window.partitionBy("group_id", "low").orderBy("at", "uuid")
    last = met.withColumn("before", F.lag("summary").over(w)).groupBy("group_id", "low").agg(F.max_by(F.struct("uuid", "summary", "before"), F.struct("at", "uuid")).alias("last"))
    labels = met.select("group_id", "low", "at", "uuid", F.posexplode("labels").alias("k", "label")).groupBy("group_id", "low", "label").agg(F.min(F.struct("at", "uuid", "k")).alias("since"))
    sorted_ = labels.groupBy("group_id", "low").agg(F.transform(F.array_sort(F.collect_list(F.struct("since", "label"))), lambda r: r["label"]).alias("labels"))
    known = shared.join(last, ["group_id", "low"]).join(sorted_, ["group_id", "low"], "left")
    flat = known.select("group_id", "id", "name", "created_at", "made_by", "labels", F.col("last.uuid").alias("last_by"), F.col("last.summary").alias("summary"), F.col("last.before").alias("before"))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                marks = {"createdByEpisode": r.made_by, "summaryByEpisode": r.last_by} | ({"previousSummary": r.before} if r.last_by != r.made_by else {})
                e = Entity(r.id, r.name, [] if r.labels is None else list(r.labels), r.summary, marks, _time(r.created_at), hashed([r.name])[0])
                out.append(("entity", r.group_id, r.id, json.dumps(entity_row(e, r.group_id), ensure_ascii=False), ""))
            yield pd.DataFrame(out, columns=["kind", "group_id", "uuid", "row", "status"])

    return flat.mapInPandas(rows, CHANGES)


def fold_new(episodes: DataFrame) -> DataFrame:
    """What fold_groups() gives of with_payload(episodes) and an empty state, with tasks of sources, not of groups.

    Notes are read once into the shared folder. A group that does not come apart is
    folded whole: one with a note that is not plain, with a source that is at
    another end too, or with notes of one key in two parts.
    """
    keyed = episodes.withColumn("key", idempotency_key(F.col("content"), F.col("valid_at")))
    read = shared_table(_read(keyed), "notes")
    tasks = max(episodes.sparkSession.sparkContext.defaultParallelism, -(-read.count() // NOTES_A_TASK))  # a count of footers
    first = shared_table(_first_notes(read), "first-notes")
    names = shared_table(_names(first), "names")
    whole = first.where("not agreed").select("group_id").union(names.where("source and other").select("group_id")).distinct()
    n = whole.limit(MOST_WHOLE + 1).count()
    if n > MOST_WHOLE:
        return folded(read.select(*NOTE), opposites, tasks=tasks)
    if n:
        whole = F.broadcast(whole.select(F.col("group_id").alias("__group"), F.lit(True).alias("__whole")))
        marked = lambda df: df.join(whole, F.col("group_id").eqNullSafe(F.col("__group")), "left").drop("__group")
        read = marked(read).withColumn("part", F.when(F.col("__whole"), "").otherwise(F.col("part")))
        first, names = (marked(df).where("__whole is null").drop("__whole") for df in (first, names))
    shared = shared_table(_shared(names), "shared-entities")
    named = F.concat(F.transform("listed", lambda e: e["low"]), "others", F.array("part"))
    told = first.select("group_id", "part", F.explode(F.array_distinct(named)).alias("low")).distinct().join(shared, ["group_id", "low"])
    seeds = told.select("group_id", "part", "created_at", F.col("made_by").alias("uuid"), F.lit("shared").alias("kind"), F.to_json(F.struct("id", "name")).alias("row"))
    return folded(read.select(*NOTE, "part").unionByName(seeds, allowMissingColumns=True), opposites, tasks=tasks).unionByName(_summed(first, shared))
