"""Which groups a caller may use: patterns, roles, tokens and sessions as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.temporal import instant

# The order of roles, and the role that a need asks for.
ROLES = ("reader", "writer", "owner")
NEEDED = {"read": "reader", "write": "writer", "manage": "owner"}


def _rank(role: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)


def _named(rank: Column) -> Column:
    return F.when(rank > 0, F.element_at(F.array(*[F.lit(r) for r in ROLES]), rank.cast("int")))


def _begins(name: Column) -> Column:
    """All beginnings of a name, from none of it to all of it."""
    return F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substr(name, F.lit(1), n))


def _capped(rank: Column, cap: Column) -> Column:
    return F.least(rank, _rank(cap))


def matching(groups: DataFrame, patterns: DataFrame) -> DataFrame:
    """groups(group_id) joined with patterns(pattern, ...): equal names, or a beginning with a star.

    Each group asks for its own name and for each of its beginnings with a star,
    so that all is one equi-join, whatever the number of patterns.
    """
    own = groups.select("group_id").distinct()
    stars = F.transform(_begins(F.col("group_id")), lambda p: F.concat(p, F.lit("*")))
    return own.withColumn("pattern", F.explode(F.array_distinct(F.concat(F.array("group_id"), stars)))).join(patterns, "pattern")


def roles(grants: DataFrame, groups: DataFrame, cap: str | None = None, within: list[str] | None = None) -> DataFrame:
    """(user, group_id, role): the highest matching grant, capped by a token's role and kept to its groups."""
    if within is not None:
        allowed = groups.sparkSession.createDataFrame([(p,) for p in set(within)], "pattern string")
        groups = matching(groups, allowed).select("group_id").distinct()
    top = matching(groups, grants.select("user", "pattern", "role")).groupBy("user", "group_id").agg(F.max(_rank(F.col("role"))).alias("r"))
    return top.select("user", "group_id", _named(F.col("r") if cap is None else _capped(F.col("r"), F.lit(cap))).alias("role"))


def _overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (user, pattern) of left that lie within a pattern of right(user, pattern) of the same user."""
    body = F.regexp_replace("pattern", r"\*$", "")
    inner = left.select("user", "pattern", *[c for c in left.columns if c not in ("user", "pattern")])
    stars = F.transform(_begins(body), lambda p: F.concat(p, F.lit("*")))
    asked = inner.withColumn("__in", F.explode(F.when(F.col("pattern").endswith("*"), stars).otherwise(F.concat(F.array("pattern"), stars))))
    held = right.select(F.col("user").alias("__u"), F.col("pattern").alias("__in2"), *[F.col(c) for c in right.columns if c not in ("user", "pattern")])
    return asked.join(held, (F.col("user") == F.col("__u")) & (F.col("__in") == F.col("__in2"))).drop("__u", "__in", "__in2")


def effective_grants(grants: DataFrame, limits: DataFrame, within: DataFrame) -> DataFrame:
    """(user, pattern, role): what is left of grants(user, pattern, role) under a token.

    limits(user, cap, narrowed) has the token's role or null, and whether it is
    kept to the groups of within(user, pattern). Two patterns share the narrower
    one, or nothing; of equal patterns the highest role stays.
    """
    allowed = within.select("user", "pattern").distinct()
    inside = _overlaps(grants.select("user", "pattern", "role"), allowed).select("user", "pattern", "role")
    around = _overlaps(allowed, grants.select("user", "pattern", "role")).select("user", "pattern", "role")
    kept = grants.select("user", "pattern", "role").join(limits.select("user", "narrowed"), "user", "left").where(~F.coalesce("narrowed", F.lit(False))).drop("narrowed")
    narrowed = inside.unionByName(around).join(limits.where("narrowed").select("user"), "user", "left_semi")
    capped = kept.unionByName(narrowed).join(limits.select("user", "cap"), "user", "left")
    top = capped.groupBy("user", "pattern").agg(F.max(F.least(_rank(F.col("role")), F.coalesce(_rank(F.col("cap")), F.lit(len(ROLES)).cast("long")))).alias("r"))
    return top.select("user", "pattern", _named(F.col("r")).alias("role"))


def resolved(requests: DataFrame, held: DataFrame) -> DataFrame:
    """requests(id, user, group_id, need, default_group) with the group meant and the outcome: ok, forbidden, no_default, read_only or needs_owner.

    held(user, group_id, role) is what roles() gives. A request without a group means the caller's default.
    """
    named = F.coalesce(F.col("group_id"), F.lit("")) != ""
    asked = requests.withColumn("__named", named).withColumn("group_id", F.when(named, F.col("group_id")).otherwise(F.col("default_group")))
    joined = asked.join(held.select("user", "group_id", "role"), ["user", "group_id"], "left")
    wanted = F.when(F.col("need") == "manage", 3).when(F.col("need") == "write", 2).otherwise(1)
    outcome = (
        F.when(F.col("role").isNull(), F.when(F.col("__named"), "forbidden").otherwise("no_default"))
        .when(_rank(F.col("role")) >= wanted, "ok")
        .when(F.col("need") == "manage", "needs_owner").otherwise("read_only")
    )
    return joined.select("id", "user", "group_id", "role", outcome.alias("outcome"))


def principals(tokens: DataFrame, users: DataFrame, now) -> DataFrame:
    """Who a token stands for: none for revoked and expired tokens and disabled users.

    tokens(id, user, groups, role, default_group, revoked_at, expires_at);
    users(name, admin, disabled, default_group). An admin's narrowed token is no
    admin, since it could lift its own limits.
    """
    valid = tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > instant(now))))
    who = users.where(~F.coalesce("disabled", F.lit(False))).select(F.col("name").alias("user"), F.coalesce("admin", F.lit(False)).alias("__admin"), F.col("default_group").alias("__group"))
    narrowed = F.col("groups").isNotNull() | F.col("role").isNotNull()
    return valid.join(who, "user").select(
        "id", "user", (F.col("__admin") & ~narrowed).alias("admin"), F.col("__admin").alias("any_group"), narrowed.alias("narrowed"), "groups", F.col("role").alias("cap"), F.coalesce("default_group", "__group").alias("default_group"),
    )


def principal_grants(found: DataFrame, grants: DataFrame) -> DataFrame:
    """(id, pattern, role) of principals() before their limits: admins own every group."""
    own = found.where("not any_group").join(grants.select("user", "pattern", "role"), "user").select("id", "pattern", "role")
    return own.unionByName(found.where("any_group").select("id", F.lit("*").alias("pattern"), F.lit("owner").alias("role")))


def purged(sessions: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(sessions that are left, one row with the number of expired ones)."""
    over = F.coalesce(F.col("expires_at") <= instant(now), F.lit(False))
    return sessions.where(~over), sessions.agg(F.count_if(over).alias("purged"))
