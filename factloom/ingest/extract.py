"""The deterministic extractor as column expressions: who works where, who likes what, who left."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the extractor, with the words of which each needs one, the relation that it states, and the word by which one ends it.
STATED = (
    (r"\b([A-Z][\w'-]*(?:\s[A-Z][\w'-]*)?)\s+(?:works? at|joined)\s+([A-Z][\w'-]*(?:\s[A-Z][\w'-]*)?)", ("work", "joined"), "WORKS_AT"),
    (r"\b([A-Z][\w'-]*(?:\s[A-Z][\w'-]*)?)\s+(?:likes?|loves?|prefers?)\s+([A-Z][\w'-]*(?:\s[A-Z][\w'-]*)?)", ("like", "love", "prefer"), "LIKES"),
    (r"([一-龥]{2,8})\s*在\s*([一-龥]{2,10})\s*工作", ("工作",), "WORKS_AT"),
    (r"([一-龥]{2,8})\s*喜欢\s*([一-龥]{2,10})", ("喜欢",), "LIKES"),
)
ENDED = (
    (r"\b([A-Z][\w'-]*(?:\s[A-Z][\w'-]*)?)\s+left\s+([A-Z][\w'-]*(?:\s[A-Z][\w'-]*)?)", ("left",), "WORKS_AT", "left"),
    (r"([一-龥]{2,8})\s*离开\s*(?:了)?\s*([一-龥]{2,10})", ("离开",), "WORKS_AT", "离开"),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used: a column that is named twice is computed twice, and in a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(content: Column, pattern: str, words: tuple[str, ...]) -> Column:
    """All matches as (whole, source, target); a text without any of the words is not searched."""
    groups = [F.regexp_extract_all(content, F.lit(pattern), F.lit(k)) for k in range(3)]
    found = F.transform(F.arrays_zip(*groups), lambda m: F.struct(F.trim(m["0"]).alias("whole"), F.trim(m["1"]).alias("source_name"), F.trim(m["2"]).alias("target_name")))
    return F.when(reduce(or_, [content.contains(w) for w in words]), found).otherwise(F.array().cast("array<struct<whole:string,source_name:string,target_name:string>>"))


def _row(relation: str, name: str, value: Column | None = None):
    """A match as a row: its ends, the relation, and a text, which is the whole match where none is given."""
    return lambda m: F.struct(m["source_name"].alias("source_name"), m["target_name"].alias("target_name"), F.lit(relation).alias("relation"), (m["whole"] if value is None else value).alias(name))


def statements(found: Column) -> Column:
    return F.concat(*[F.transform(found[k], _row(r, "fact")) for k, (_, _, r) in enumerate(STATED)])


def endings(found: Column) -> Column:
    return F.concat(*[F.transform(found[len(STATED) + k], _row(r, "reason", F.lit(f'text states "{w}"'))) for k, (_, _, r, w) in enumerate(ENDED)])


def people_and_firms(found: Column) -> Column:
    """Every name of more than one character, as it is first written, with the label of its first place."""
    said = F.flatten(F.transform(F.flatten(found), lambda m: F.array(F.struct(m["source_name"].alias("name"), F.lit("Person").alias("label")), F.struct(m["target_name"].alias("name"), F.lit("Organization").alias("label")))))
    shown = lambda e: F.struct(e["name"].alias("name"), F.array(e["label"]).alias("labels"), F.concat(F.lit("Mentioned: "), e["name"]).alias("summary"))
    first = lambda named, low: F.filter(named, lambda e, k: F.array_position(low, F.lower(e["name"])) == k + 1)
    firsts = lambda named: _let(F.transform(named, lambda e: F.lower(e["name"])), lambda low: first(named, low))
    return F.transform(_let(F.filter(said, lambda e: F.length(e["name"]) > 1), firsts), shown)


def extraction(content: Column) -> Column:
    """{entities, facts, invalidations} of a text; a null text says nothing."""
    text = F.coalesce(content, F.lit(""))
    found = F.array(*[_matches(text, pattern, words) for pattern, words, *_ in (*STATED, *ENDED)])
    return _let(found, lambda f: F.struct(people_and_firms(f).alias("entities"), statements(f).alias("facts"), endings(f).alias("invalidations")))
