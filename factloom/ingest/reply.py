"""A language model's reply as a payload: what is well formed is kept, the rest is left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import normalise_relation

_ENTITY = "struct<name:string,labels:array<string>,summary:string>"
_FACT = "struct<source_name:string,target_name:string,relation:string,fact:string,valid_at:string,invalid_at:string,replaces_previous:boolean>"
_END = "struct<source_name:string,target_name:string,relation:string,invalid_at:string,reason:string>"
SHAPE = f"struct<entities:array<{_ENTITY}>,facts:array<{_FACT}>,invalidations:array<{_END}>>"


def _clean(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def _instant(text: Column) -> Column:
    """An ISO date or instant as one form; null where it is none."""
    return F.date_format(text.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def _rows(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{kind}>"))


def payload_of(reply: Column) -> Column:
    """{entities, facts, invalidations} of a reply that holds one JSON object, in a fence or with text around it.

    Names are trimmed and rows without them left out; dates that are none become
    null; relations are normalised. An end of a statement that the reply forgot to
    list as an entity is added, so that the statement is not lost. A reply without
    an object says nothing.
    """
    held = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1), SHAPE)
    entities = F.filter(
        F.transform(_rows(held["entities"], _ENTITY), lambda e: F.struct(_clean(e["name"]).alias("name"), F.filter(F.coalesce(e["labels"], F.array().cast("array<string>")), lambda x: _clean(x) != "").alias("labels"), _clean(e["summary"]).alias("summary"))),
        lambda e: e["name"] != "",
    )
    ended = lambda s: (_clean(s["source_name"]) != "") & (_clean(s["target_name"]) != "")
    facts = F.transform(F.filter(_rows(held["facts"], _FACT), ended), lambda s: F.struct(
        _clean(s["source_name"]).alias("source_name"), _clean(s["target_name"]).alias("target_name"), normalise_relation(s["relation"]).alias("relation"), _clean(s["fact"]).alias("fact"),
        _instant(s["valid_at"]).alias("valid_at"), _instant(s["invalid_at"]).alias("invalid_at"), F.coalesce(s["replaces_previous"], F.lit(False)).alias("replaces_previous"),
    ))
    over = F.transform(F.filter(_rows(held["invalidations"], _END), ended), lambda s: F.struct(
        _clean(s["source_name"]).alias("source_name"), _clean(s["target_name"]).alias("target_name"), normalise_relation(s["relation"]).alias("relation"), _instant(s["invalid_at"]).alias("invalid_at"), _clean(s["reason"]).alias("reason"),
    ))
    listed = F.transform(entities, lambda e: F.lower(e["name"]))
    ends = F.array_distinct(F.flatten(F.transform(facts, lambda s: F.array(s["source_name"], s["target_name"]))))
    missing = F.filter(ends, lambda n: ~F.array_contains(listed, F.lower(n)))
    added = F.transform(missing, lambda n: F.struct(n.alias("name"), F.array().cast("array<string>").alias("labels"), F.lit("").alias("summary")))
    return F.struct(F.concat(entities, added).alias("entities"), facts.alias("facts"), over.alias("invalidations"))
