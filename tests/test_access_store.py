from datetime import datetime

from factloom.operators.access import effective_grants
from factloom.sources.access_store import AccessStore, hashed


def at(day):
    return datetime(2024, 1, day)


def test_users_grants_tokens_and_sessions(spark, tmp_path):
    store = AccessStore(spark, f"file://{tmp_path}/access")
    store.put_user("ann", at(1), default_group="home")
    store.put_user("root", at(1), admin=True)
    store.grant("ann", "team-*", "reader", at(1))
    store.grant("ann", "team-*", "writer", at(2))
    assert [(r.pattern, r.role, r.created_at) for r in store.read("grants").collect()] == [("team-*", "writer", at(1))]
    token, secret = store.issue("ann", "laptop", at(2), expires=at(20), groups=["team-a"], role="reader")
    held = store.read("tokens").first()
    assert held.secret_hash == hashed(secret) and held.prefix == secret[:8] and secret not in str(held)
    who = store.principal(secret, at(3)).first()
    assert (who.id, who.user, who.admin, who.narrowed, who.default_group) == (token, "ann", False, True, "home")
    grants = store.grants_of(secret, at(3)).selectExpr("id AS user", "pattern", "role")
    limits = spark.createDataFrame([(token, "reader", True)], "user string, cap string, narrowed boolean")
    within = spark.createDataFrame([(token, "team-a")], "user string, pattern string")
    assert [(r.pattern, r.role) for r in effective_grants(grants, limits, within).collect()] == [("team-a", "reader")]
    assert store.principal(secret, at(21)).isEmpty() and store.principal("other", at(3)).isEmpty()
    store.put_user("ann", at(4), disabled=True, default_group="home")
    assert store.principal(secret, at(5)).isEmpty() and store.read("users").where("name = 'ann'").first().created_at == at(1)
    store.put_user("ann", at(6), default_group="home")

    for k, day in enumerate((5, 8, 30)):
        store.open_session(f"s{k}", token, at(2), at(day))
    assert store.session("s0").count() == 1 and store.close_session("s0") is not None and store.close_session("s0") is None
    assert store.purge(at(8)) == 1 and store.purge(at(8)) == 0 and store.session("s2").count() == 1
    assert store.revoke(token, at(9)) is not None and store.revoke(token, at(10)) is None
    assert store.read("tokens").first().revoked_at == at(9) and store.read("sessions").isEmpty() and store.principal(secret, at(9)).isEmpty()

    _, admin = store.issue("root", "all", at(9))
    assert [(r.pattern, r.role) for r in store.grants_of(admin, at(9)).collect()] == [("*", "owner")]
    assert store.withdraw("ann", "team-*") is not None and store.withdraw("ann", "team-*") is None
    store.grant("ann", "x", "owner", at(10))
    assert store.remove_user("ann") is not None and store.remove_user("ann") is None
    assert [r.user for r in store.read("tokens").collect()] == ["root"] and store.read("grants").isEmpty() and [r.name for r in store.read("users").collect()] == ["root"]
    store.put_user("ann", at(12))
    assert store.read("users").where("name = 'ann'").first().created_at == at(12)
