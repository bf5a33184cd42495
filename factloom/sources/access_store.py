"""Users, grants, tokens and sessions as an append log: every change is one commit of one or more of its tables."""

from __future__ import annotations

import hashlib
import secrets
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.access import principal_grants, principals
from factloom.schema import GRANT_LOG, SESSIONS, TOKENS, USERS
from factloom.sources.store import Store, merged

SHOWN = 8  # characters of a secret by which people know it
KEYS = {"users": ("name",), "grants": ("user", "pattern"), "tokens": ("id",), "sessions": ("sid_hash",)}
#: What a later row of a key does not change.
FIXED = {"users": ("created_at",), "grants": ("created_at",), "tokens": ("user", "prefix", "secret_hash", "created_at"), "sessions": ("token_id", "created_at")}
#: Instants that stay once they are set.
SET_ONCE = {"tokens": ("last_used_at", "revoked_at")}


def hashed(secret: str) -> str:
    return hashlib.sha256(secret.encode()).hexdigest()


class AccessStore(Store):
    """Who may do what, with the store's commits: changes by several writers follow each other, and none is lost.

    Secrets and session ids are kept as hashes alone. Removing a user removes its
    grants, tokens and their sessions in the same commit; revoking a token ends its
    sessions. All instants are the caller's.
    """

    tables, parted = {"users": USERS, "grants": GRANT_LOG, "tokens": TOKENS, "sessions": SESSIONS}, ()

    def read(self, name: str, group: str | None = None, upto: int | None = None) -> DataFrame:
        log = self.log(name, upto).withColumn("__key", F.to_json(F.array(*KEYS[name])))
        return merged(log, "__key", ["seq"], (*KEYS[name], *FIXED[name]), SET_ONCE.get(name, ())).drop("__key", "seq")

    def _rows(self, name: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), self.tables[name])

    @staticmethod
    def _gone(rows: DataFrame) -> DataFrame:
        return rows.withColumn("deleted", F.lit(True))

    def put_user(self, name: str, now: datetime, admin: bool = False, disabled: bool = False, default_group: str = "") -> int:
        """A new user, or another state of one."""
        return self.transact(lambda head: {"users": self._rows("users", (name, admin, disabled, default_group, now))})

    def remove_user(self, name: str) -> int | None:
        def make(head: int):
            user = self.read("users", upto=head).where(F.col("name") == name)
            if user.isEmpty():
                return None
            tokens = self.read("tokens", upto=head).where(F.col("user") == name)
            sessions = self.read("sessions", upto=head).join(tokens.select(F.col("id").alias("token_id")), "token_id", "left_semi")
            grants = self.read("grants", upto=head).where(F.col("user") == name)
            return {"users": self._gone(user), "grants": self._gone(grants), "tokens": self._gone(tokens), "sessions": self._gone(sessions)}

        return self.transact(make)

    def grant(self, user: str, pattern: str, role: str, now: datetime) -> int:
        """A role on the groups that a pattern has; another role for the same pattern takes the place of the first."""
        return self.transact(lambda head: {"grants": self._rows("grants", (user, pattern, role, now))})

    def withdraw(self, user: str, pattern: str) -> int | None:
        def make(head: int):
            held = self.read("grants", upto=head).where((F.col("user") == user) & (F.col("pattern") == pattern))
            return None if held.isEmpty() else {"grants": self._gone(held)}

        return self.transact(make)

    def issue(self, user: str, name: str, now: datetime, expires: datetime | None = None, groups: list[str] | None = None, role: str | None = None, default_group: str | None = None) -> tuple[str, str]:
        """(id, secret) of a new token; the secret is not kept."""
        token, secret = "tk_" + secrets.token_hex(6), secrets.token_urlsafe(32)
        row = (token, user, name, secret[:SHOWN], hashed(secret), groups, role, default_group, now, expires, None, None)
        self.transact(lambda head: {"tokens": self._rows("tokens", row)})
        return token, secret

    def revoke(self, token: str, now: datetime) -> int | None:
        """Ends a token, once, and its sessions."""

        def make(head: int):
            held = self.read("tokens", upto=head).where((F.col("id") == token) & F.col("revoked_at").isNull())
            if held.isEmpty():
                return None
            sessions = self.read("sessions", upto=head).where(F.col("token_id") == token)
            return {"tokens": held.withColumn("revoked_at", F.lit(now).cast("timestamp_ntz")), "sessions": self._gone(sessions)}

        return self.transact(make)

    def principal(self, secret: str, now: datetime) -> DataFrame:
        """principals() of the token with a secret: one row, or none."""
        own = self.read("tokens").where(F.col("secret_hash") == hashed(secret))
        return principals(own, self.read("users"), now)

    def grants_of(self, secret: str, now: datetime) -> DataFrame:
        """principal_grants() of the token with a secret."""
        return principal_grants(self.principal(secret, now), self.read("grants"))

    def open_session(self, sid: str, token: str, now: datetime, expires: datetime) -> int:
        return self.transact(lambda head: {"sessions": self._rows("sessions", (hashed(sid), token, now, expires))})

    def session(self, sid: str) -> DataFrame:
        return self.read("sessions").where(F.col("sid_hash") == hashed(sid))

    def close_session(self, sid: str) -> int | None:
        def make(head: int):
            held = self.read("sessions", upto=head).where(F.col("sid_hash") == hashed(sid))
            return None if held.isEmpty() else {"sessions": self._gone(held)}

        return self.transact(make)

    def purge(self, now: datetime) -> int:
        """Removes expired sessions; how many."""
        count = 0

        def make(head: int):
            nonlocal count
            over = self.read("sessions", upto=head).where(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz"))
            count = over.count()
            return {"sessions": self._gone(over)} if count else None

        self.transact(make)
        return count
