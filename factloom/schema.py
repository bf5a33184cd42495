"""Schemas of the three tables, the extraction payload and the access tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, TS, I = T.StringType(), T.TimestampNTZType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


EPISODES = _struct(
    ("uuid", S), ("group_id", S), ("name", S), ("source", S), ("source_description", S), ("content", S), ("valid_at", TS), ("created_at", TS),
    ("status", S), ("error", S), ("content_hash", S), ("attempts", I),
)
ENTITIES = _struct(
    ("uuid", S), ("group_id", S), ("name", S), ("labels", T.ArrayType(S)), ("summary", S), ("attributes", S), ("created_at", TS), ("name_embedding", T.ArrayType(T.DoubleType())),
)
FACTS = _struct(
    ("uuid", S), ("group_id", S), ("source_node_uuid", S), ("target_node_uuid", S), ("name", S), ("fact", S), ("episodes", T.ArrayType(S)),
    ("valid_at", TS), ("invalid_at", TS), ("created_at", TS), ("expired_at", TS), ("attributes", S), ("fact_embedding", T.ArrayType(T.DoubleType())),
)
PAYLOAD = _struct(
    ("entities", T.ArrayType(_struct(("name", S), ("labels", T.ArrayType(S)), ("summary", S)))),
    ("facts", T.ArrayType(_struct(("source_name", S), ("target_name", S), ("relation", S), ("fact", S), ("valid_at", TS), ("invalid_at", TS), ("replaces_previous", T.BooleanType())))),
    ("invalidations", T.ArrayType(_struct(("source_name", S), ("target_name", S), ("relation", S), ("invalid_at", TS), ("reason", S)))),
)
GRANTS = _struct(("user", S), ("pattern", S), ("role", S))
USERS = _struct(("name", S), ("admin", T.BooleanType()), ("disabled", T.BooleanType()), ("default_group", S), ("created_at", TS))
GRANT_LOG = _struct(("user", S), ("pattern", S), ("role", S), ("created_at", TS))
TOKENS = _struct(
    ("id", S), ("user", S), ("name", S), ("prefix", S), ("secret_hash", S), ("groups", T.ArrayType(S)), ("role", S), ("default_group", S),
    ("created_at", TS), ("expires_at", TS), ("last_used_at", TS), ("revoked_at", TS),
)
SESSIONS = _struct(("sid_hash", S), ("token_id", S), ("created_at", TS), ("expires_at", TS))
