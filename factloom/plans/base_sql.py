"""The projection of factloom.sources.project and the time predicates, in SQL for the oracle."""

GRP = "grp AS (SELECT n_nationkey, n_name, r_name AS group_id FROM nation JOIN region ON n_regionkey = r_regionkey)"

FACTS = """facts AS (
  SELECT 'b:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS uuid, group_id, group_id || ':customer:' || c_custkey AS src, group_id || ':part:' || l_partkey AS tgt,
         'BOUGHT' AS name, c_name || ' bought ' || p_name AS fact, o_orderdate AS valid_at,
         CASE WHEN l_returnflag = 'R' AND l_shipdate > o_orderdate THEN l_shipdate END AS invalid_at,
         o_orderdate + INTERVAL 1 DAY AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS expired_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN grp ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT 'ch:' || c_custkey, group_id, group_id || ':customer:' || c_custkey, group_id || ':nation:' || n_nationkey, 'LIVES_IN', c_name || ' is in ' || n_name,
         CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), TIMESTAMP '1995-01-01 00:00:00', CAST(NULL AS TIMESTAMP) FROM customer JOIN grp ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'sh:' || s_suppkey, group_id, group_id || ':supplier:' || s_suppkey, group_id || ':nation:' || n_nationkey, 'BASED_IN', s_name || ' is in ' || n_name,
         CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), TIMESTAMP '1995-01-01 00:00:00', CAST(NULL AS TIMESTAMP) FROM supplier JOIN grp ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 's:' || l_suppkey || ':' || l_partkey, group_id, group_id || ':supplier:' || l_suppkey, group_id || ':part:' || l_partkey, 'SUPPLIES', s_name || ' supplies part ' || l_partkey,
         min(l_shipdate), CAST(NULL AS TIMESTAMP), TIMESTAMP '1995-01-01 00:00:00', CAST(NULL AS TIMESTAMP)
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN grp ON s_nationkey = n_nationkey GROUP BY l_suppkey, l_partkey, group_id, s_name
)"""

ENTITIES = """entities AS (
  SELECT group_id || ':customer:' || c_custkey AS uuid, group_id, c_name AS name, 'Person' AS label, c_mktsegment AS summary FROM customer JOIN grp ON c_nationkey = n_nationkey
  UNION ALL SELECT group_id || ':supplier:' || s_suppkey, group_id, s_name, 'Organization', '' FROM supplier JOIN grp ON s_nationkey = n_nationkey
  UNION ALL SELECT group_id || ':nation:' || n_nationkey, group_id, n_name, 'Entity', '' FROM grp
  UNION ALL SELECT group_id || ':part:' || p_partkey, group_id, p_name, 'Product', p_type FROM (
    SELECT group_id, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN grp ON c_nationkey = n_nationkey
    UNION SELECT group_id, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN grp ON s_nationkey = n_nationkey
  ) sold JOIN part ON l_partkey = p_partkey
)"""

EPISODES = """episodes AS (
  SELECT 'e:' || conv_id || ':' || turn AS uuid, 'g' || (conv_id % 5) AS group_id, role AS source, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(turn) AS valid_at,
         TIMESTAMP '2024-01-01 01:00:00' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(turn) AS created_at,
         CASE (conv_id * 31 + turn) % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN NULL ELSE 'processed' END AS status, (conv_id * 31 + turn) % 5 AS attempts
  FROM conversations
)"""


def graph(query: str, *more: str) -> str:
    """query over grp, facts and entities."""
    return "WITH " + ",\n".join([GRP, FACTS, ENTITIES, *more]) + "\n" + query


def notes(query: str, *more: str) -> str:
    return "WITH " + ",\n".join([EPISODES, *more]) + "\n" + query


def known(as_of: str) -> str:
    return f"(created_at IS NULL OR created_at <= {as_of})"


def active(at: str, as_of: str) -> str:
    return (
        f"({known(as_of)} AND (valid_at IS NULL OR valid_at <= {at}) AND NOT coalesce(CASE WHEN invalid_at IS NOT NULL "
        f"THEN invalid_at <= {at} AND coalesce(expired_at, created_at) <= {as_of} ELSE expired_at <= {as_of} END, false))"
    )


RETRACTED = "(CASE WHEN invalid_at IS NOT NULL THEN coalesce(invalid_at <= valid_at, false) ELSE expired_at IS NOT NULL END)"


def state(at: str, as_of: str) -> str:
    return (
        f"(CASE WHEN NOT {known(as_of)} THEN NULL WHEN {RETRACTED} AND coalesce(expired_at <= {as_of}, false) THEN 'retracted' "
        f"WHEN invalid_at IS NOT NULL AND coalesce(expired_at, created_at) <= {as_of} AND invalid_at <= {at} THEN 'ended' "
        f"WHEN coalesce(valid_at > {at}, false) THEN 'future' ELSE 'active' END)"
    )
