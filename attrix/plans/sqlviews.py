"""The test views as SQL text (DuckDB dialect) for the oracle side.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs, since
the checker registers only the base tables.
"""

from __future__ import annotations

VIEW_SQL = {
    "v_obs": """
SELECT o.o_orderkey AS key, o.o_custkey AS client_id,
       CASE WHEN o.o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS target,
       o.o_totalprice AS num_a, c.c_acctbal AS num_b,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE l.qty END AS num_c,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE c.c_mktsegment END AS cat_a,
       o.o_orderpriority AS cat_b, n.n_name AS cat_c,
       substr(CAST(o.o_orderdate AS VARCHAR), 1, 10) AS acquired_date
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) l
  ON o.o_orderkey = l.l_orderkey""",
    "v_pred": """
SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       ((o_orderkey * 7919) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 250 ELSE 0 END + 5e-1) / 1.25e3 AS prob,
       ((o_orderkey * 6101) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END + 5e-1) / 1.1e3 AS prob_b,
       ((o_orderkey * 4447) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 50 ELSE 0 END + 5e-1) / 1.05e3 AS prob_c
FROM orders""",
    "v_docs": """
SELECT l.doc_id AS key, l.quality AS label, d.n_chars / 2e4 AS score, d.lang, d.source
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_drift": """
SELECT event_id AS key,
       CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'train' ELSE 'prod' END AS side,
       event_type, value, CAST(user_id % 7 AS VARCHAR) AS user_group
FROM events""",
    "v_logs": """
SELECT CAST(event_id AS VARCHAR) AS uid, ts AS logging_timestamp,
       concat('{"input": {"client_id": "', CAST(user_id AS VARCHAR), '", "event_type": "', event_type,
              '"}, "output": {"prediction": 0.', lpad(CAST((event_id * 37) % 1000 AS VARCHAR), 3, '0'),
              ', "model_uid": "m', CAST(event_id % 2 AS VARCHAR), '"}}') AS input_output_payloads
FROM events""",
    "v_ltv": "SELECT c_custkey AS client_id, c_acctbal AS ltv FROM customer",
    "v_basket": """
SELECT DISTINCT l.l_orderkey AS key, p.p_type AS item
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_vec": "SELECT vec_id AS key, embedding, label FROM embeddings",
}


def with_views(sql: str, *names: str) -> str:
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
