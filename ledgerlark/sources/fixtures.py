"""Deterministic AML views over the given tables, in SQL that runs unchanged on Spark SQL and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The instant that every report takes as now.
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS: dict[str, str] = {}

VIEWS["aml_customer"] = """
SELECT c_custkey AS customer_id,
  concat('CUS-', CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS STRING), 6, '0') ELSE CAST(c_custkey AS STRING) END) AS customer_number,
  c_name AS full_name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('u', CAST(c_custkey AS STRING), '@mail.example') END AS email,
  CASE WHEN c_custkey % 40 = 7 THEN NULL ELSE substr('USDEGBFRIRKPRUBYCNNGPKAFMXITJPKRBRAESYCUVEZWCOINES', CAST(c_nationkey AS INT) * 2 + 1, 2) END AS nationality,
  CASE WHEN c_custkey % 10 = 0 THEN 'US' WHEN c_custkey % 50 = 3 THEN NULL ELSE substr('USDEGBFRIRKPRUBYCNNGPKAFMXITJPKRBRAESYCUVEZWCOINES', CAST(c_nationkey AS INT) * 2 + 1, 2) END AS country,
  CASE WHEN c_custkey % 10 < 6 THEN 'low' WHEN c_custkey % 10 < 8 THEN 'medium' WHEN c_custkey % 10 = 8 THEN 'high' ELSE 'critical' END AS risk_level,
  (c_custkey % 17 = 0) AS pep_status, (c_custkey % 23 = 0) AS sanctions_flag,
  c_mktsegment AS occupation,
  CASE WHEN c_acctbal > 0 THEN c_acctbal * 12 ELSE NULL END AS annual_income,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'passport' END AS id_type,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('P', CAST(c_custkey AS STRING)) END AS id_number,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST('1980-01-01' AS DATE) END AS date_of_birth,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'Main St' END AS address,
  TIMESTAMP '2024-01-31 00:00:00' - ((c_custkey % 400) * INTERVAL '1' DAY) AS created_at
FROM customer
"""

VIEWS["aml_txn"] = """
SELECT b.id, concat('TXN-', CAST(b.id AS STRING)) AS reference, b.from_customer_id, b.to_customer_id,
  b.amount, 'USD' AS currency, b.transaction_type, b.originating_country, b.destination_country,
  (b.originating_country <> b.destination_country) AS is_international,
  CASE b.id % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'branch' WHEN 2 THEN 'atm' ELSE 'mobile' END AS channel,
  CAST(b.id % 101 AS DOUBLE) AS risk_score, (b.id % 9 = 0) AS flagged, b.created_at
FROM (
  SELECT e.event_id + s.k * 100000000 AS id, e.user_id AS from_customer_id,
    CASE WHEN e.event_id % 29 = 0 AND CAST(floor(e.user_id / 6) AS BIGINT) % 2 = 0 AND e.user_id >= 6 THEN e.user_id % 3
         ELSE CAST(floor(e.user_id / 6) AS BIGINT) * 6 + (e.user_id % 6 + 1 + e.event_id % 2) % 6 END AS to_customer_id,
    CAST(CASE WHEN e.event_id % 11 = 0 THEN e.value WHEN e.event_id % 13 = 0 THEN ceil(e.value / 10) * 1000 ELSE round(e.value * 100) END AS DOUBLE) AS amount,
    CASE e.event_type WHEN 'click' THEN 'payment' WHEN 'view' THEN 'deposit' WHEN 'signup' THEN 'wire' WHEN 'purchase' THEN 'transfer'
         ELSE CASE WHEN e.event_id % 2 = 0 THEN 'cash' ELSE 'withdrawal' END END AS transaction_type,
    substr('USDEGBFRIRKPRUBYCNNGPKAFMXITJPKRBRAESYCUVEZWCOINES', CAST(e.user_id % 25 AS INT) * 2 + 1, 2) AS originating_country,
    CASE WHEN e.event_id % 3 = 0 THEN substr('USDEGBFRIRKPRUBYCNNGPKAFMXITJPKRBRAESYCUVEZWCOINES', CAST(e.event_id % 25 AS INT) * 2 + 1, 2)
         ELSE substr('USDEGBFRIRKPRUBYCNNGPKAFMXITJPKRBRAESYCUVEZWCOINES', CAST(e.user_id % 25 AS INT) * 2 + 1, 2) END AS destination_country,
    CAST(e.ts AS TIMESTAMP) - (s.k * INTERVAL '30' DAY) AS created_at
  FROM events e CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) s
  WHERE s.k = 0 OR (s.k = 1 AND e.event_id % 2 = 0) OR (s.k = 2 AND e.event_id % 3 = 0)
  UNION ALL
  SELECT e.event_id * 10 + m.k + 1000000000 AS id, e.user_id AS from_customer_id,
    CAST(floor(e.user_id / 6) AS BIGINT) * 6 + (e.user_id % 6 + 1) % 6 AS to_customer_id,
    CAST(5 + m.k AS DOUBLE) AS amount, 'payment' AS transaction_type, 'US' AS originating_country, 'US' AS destination_country,
    CAST(e.ts AS TIMESTAMP) + (m.k * INTERVAL '7' MINUTE) AS created_at
  FROM events e CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) m
  WHERE e.event_id % 97 = 0
) b
"""

VIEWS["aml_txn_big"] = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS id, o.o_custkey AS from_customer_id, l.l_suppkey AS to_customer_id,
  l.l_extendedprice AS amount, 'USD' AS currency, 'transfer' AS transaction_type,
  substr('USDEGBFRIRKPRUBYCNNGPKAFMXITJPKRBRAESYCUVEZWCOINES', CAST(o.o_custkey % 25 AS INT) * 2 + 1, 2) AS originating_country,
  substr('USDEGBFRIRKPRUBYCNNGPKAFMXITJPKRBRAESYCUVEZWCOINES', CAST(l.l_suppkey % 25 AS INT) * 2 + 1, 2) AS destination_country,
  CAST(l.l_shipdate AS TIMESTAMP) + ((l.l_orderkey % 86400) * INTERVAL '1' SECOND) AS created_at
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

VIEWS["aml_rule"] = """
SELECT 1 AS rule_id, 'Large Cash Transaction' AS name, 'large_transaction' AS category, 10000.0E0 AS threshold_amount, CAST(NULL AS INT) AS threshold_count, CAST(NULL AS INT) AS time_window_hours, CAST(NULL AS STRING) AS high_risk_countries, 'high' AS severity, true AS is_active
UNION ALL SELECT 2, 'Transaction Structuring (Smurfing)', 'structuring', 10000.0E0, NULL, 72, NULL, 'critical', true
UNION ALL SELECT 3, 'High Transaction Frequency', 'frequency', NULL, 5, 24, NULL, 'medium', true
UNION ALL SELECT 4, 'High Velocity Movement', 'velocity', 25000.0E0, NULL, 24, NULL, 'high', true
UNION ALL SELECT 5, 'High-Risk Country Transaction', 'high_risk_country', NULL, NULL, NULL, NULL, 'critical', true
UNION ALL SELECT 6, 'Rapid Fund Movement', 'rapid_movement', 5000.0E0, NULL, 24, NULL, 'high', true
UNION ALL SELECT 7, 'Suspicious Round Amount', 'round_amount', 1000.0E0, NULL, 48, NULL, 'low', true
UNION ALL SELECT 8, 'PEP Transaction Monitor', 'pep_transaction', 0.0E0, NULL, NULL, NULL, 'high', true
UNION ALL SELECT 9, 'Micro-Transaction Pattern', 'micro_transaction', 100.0E0, 4, 1, NULL, 'medium', true
"""

VIEWS["aml_alert"] = """
SELECT o_orderkey AS alert_id, concat('ALT-', CAST(o_orderkey AS STRING)) AS alert_number,
  o_orderkey AS transaction_id, o_custkey AS customer_id,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey % 9 + 1 AS INT) END AS rule_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'critical' WHEN o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END AS severity,
  CASE o_orderkey % 7 WHEN 0 THEN 'closed' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'escalated' WHEN 3 THEN 'under_review' ELSE 'open' END AS status,
  concat('Rule ', CAST(o_orderkey % 9 + 1 AS STRING), ' matched') AS reason,
  round(o_totalprice / 5000, 2) AS risk_score,
  TIMESTAMP '2024-01-31 00:00:00' - ((o_orderkey % 240) * INTERVAL '1' DAY) - ((o_orderkey % 23) * INTERVAL '1' HOUR) AS created_at,
  CASE WHEN o_orderkey % 7 < 2 THEN TIMESTAMP '2024-01-31 00:00:00' - ((o_orderkey % 240) * INTERVAL '1' DAY) - ((o_orderkey % 23) * INTERVAL '1' HOUR) + ((o_orderkey % 97) * INTERVAL '1' HOUR) ELSE NULL END AS closed_at
FROM orders
"""

VIEWS["aml_case"] = """
SELECT o_orderkey AS case_id, concat('CASE-', CAST(o_orderkey AS STRING)) AS case_number, o_orderkey AS alert_id,
  CASE CAST(floor(o_orderkey / 6) AS BIGINT) % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'pending_review' WHEN 3 THEN 'escalated' WHEN 4 THEN 'closed' ELSE 'filed_sar' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS priority,
  (CAST(floor(o_orderkey / 6) AS BIGINT) % 6 = 5) AS sar_filed,
  CASE WHEN CAST(floor(o_orderkey / 6) AS BIGINT) % 6 = 5 THEN concat('SAR-', CAST(o_orderkey AS STRING)) ELSE NULL END AS sar_reference,
  TIMESTAMP '2024-01-31 00:00:00' - ((o_orderkey % 240) * INTERVAL '1' DAY) AS created_at,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' - ((o_orderkey % 20) * INTERVAL '1' DAY) END AS updated_at,
  CASE WHEN CAST(floor(o_orderkey / 6) AS BIGINT) % 6 >= 4 THEN TIMESTAMP '2024-01-31 00:00:00' - ((o_orderkey % 240) * INTERVAL '1' DAY) + ((o_orderkey % 120) * INTERVAL '1' HOUR) ELSE NULL END AS closed_at
FROM orders WHERE o_orderkey % 6 = 0
"""

VIEWS["aml_sanctions_entry"] = """
SELECT doc_id AS entry_id, concat('F', CAST(doc_id AS STRING)) AS fixed_ref, trim(substr(replace(text, chr(10), ' '), 1, 24)) AS primary_name,
  CASE doc_id % 4 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Entity' WHEN 2 THEN 'Vessel' ELSE 'Aircraft' END AS entity_type,
  CASE WHEN doc_id % 10 = 0 THEN 'not json' WHEN doc_id % 3 = 0 THEN '["SDGT","IRAN"]' WHEN doc_id % 3 = 1 THEN '["DPRK"]' ELSE '[]' END AS programs,
  CASE WHEN doc_id % 5 = 0 THEN 'UN' ELSE 'SDN' END AS list_name
FROM documents
"""

VIEWS["aml_sanctions_alias"] = """
SELECT doc_id * 2 AS alias_id, doc_id AS entry_id, trim(substr(replace(text, chr(10), ' '), 1, 24)) AS alias_name, 'Name' AS alias_type, true AS is_primary, false AS low_quality FROM documents
UNION ALL
SELECT doc_id * 2 + 1, doc_id, upper(replace(trim(substr(replace(text, chr(10), ' '), 5, 20)), 'ß', 'ss')), 'A.K.A.', false, (doc_id % 2 = 0) FROM documents WHERE doc_id % 3 <> 1
"""

VIEWS["aml_sanctions_location"] = """
SELECT doc_id AS entry_id, CASE WHEN doc_id % 6 = 1 THEN NULL WHEN doc_id % 6 < 3 THEN 'Iran' ELSE 'Russia' END AS country,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Moscow' END AS city, CAST(NULL AS STRING) AS state_province, CAST(NULL AS STRING) AS address, CAST(NULL AS STRING) AS postal_code
FROM documents WHERE doc_id % 7 <> 0
"""

VIEWS["aml_sanctions_identifier"] = """
SELECT doc_id AS entry_id, 'Passport' AS id_type, concat('P', CAST(doc_id * 13 AS STRING)) AS id_value FROM documents WHERE doc_id % 5 = 0
"""

VIEWS["aml_screen_query"] = """
SELECT doc_id AS query_id,
  CASE WHEN doc_id % 40 = 0 THEN '' WHEN doc_id % 24 = 0 THEN upper(replace(trim(substr(replace(text, chr(10), ' '), 1, 15)), 'ß', 'ss'))
       WHEN doc_id % 16 = 0 THEN replace(trim(substr(replace(text, chr(10), ' '), 1, 15)), 'e', 'a')
       ELSE trim(substr(replace(text, chr(10), ' '), 1, 15)) END AS name,
  CASE WHEN doc_id % 40 = 0 THEN concat('P', CAST(doc_id * 13 AS STRING)) ELSE NULL END AS id_number,
  CAST(NULL AS STRING) AS entity_type
FROM documents WHERE doc_id % 8 = 0
"""

VIEWS["aml_blacklist"] = """
SELECT n_nationkey AS entry_id, 'country' AS entry_type,
  lower(substr('USDEGBFRIRKPRUBYCNNGPKAFMXITJPKRBRAESYCUVEZWCOINES', CAST(n_nationkey AS INT) * 2 + 1, 2)) AS value,
  'listed' AS reason, 'high' AS severity,
  CASE n_nationkey % 3 WHEN 0 THEN 'black' WHEN 1 THEN 'yellow' ELSE 'white' END AS list_type,
  (n_nationkey % 5 <> 0) AS is_active,
  CASE WHEN n_nationkey % 4 = 1 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE NULL END AS expires_at
FROM nation WHERE n_nationkey >= 4
"""

VIEWS["aml_audit"] = """
SELECT event_id AS audit_id, user_id, CASE event_id % 3 WHEN 0 THEN 'SANCTIONS_SEARCH' WHEN 1 THEN 'UPDATE_ALERT' ELSE 'LOGIN' END AS action,
  CASE WHEN event_id % 3 = 1 THEN 'alert' ELSE NULL END AS entity_type, CAST(ts AS TIMESTAMP) AS created_at
FROM events WHERE event_type = 'view'
"""

VIEWS["aml_scored"] = """
SELECT doc_id AS row_id, quality AS label, CAST((doc_id * 37 + quality * 20) % 101 AS DOUBLE) / 100 AS score FROM labels
"""

VIEWS["aml_account"] = """
SELECT c_custkey AS account_id, concat('ACC-', lpad(CAST(c_custkey AS STRING), 10, '0')) AS account_number, c_custkey AS customer_id,
  'checking' AS account_type, 'USD' AS currency, c_acctbal AS balance, 'active' AS status
FROM customer WHERE c_custkey % 11 <> 0
"""

VIEWS["aml_case_note"] = """
SELECT o_orderkey AS note_id, o_orderkey - o_orderkey % 6 AS case_id, concat('note ', CAST(o_orderkey AS STRING)) AS note,
  CASE WHEN o_orderkey % 2 = 0 THEN 'comment' ELSE 'status_change' END AS note_type,
  TIMESTAMP '2024-01-31 00:00:00' - ((o_orderkey % 200) * INTERVAL '1' DAY) AS created_at
FROM orders WHERE o_orderkey % 6 < 3
"""

VIEWS["aml_blacklist_move"] = """
SELECT n_nationkey * 10 + s.k AS log_id, n_nationkey AS entry_id,
  CASE s.k WHEN 0 THEN 'none' WHEN 1 THEN 'black' ELSE 'yellow' END AS from_list,
  CASE s.k WHEN 0 THEN 'black' WHEN 1 THEN 'yellow' ELSE 'white' END AS to_list, 'review' AS reason,
  TIMESTAMP '2024-01-01 00:00:00' + (s.k * INTERVAL '5' DAY) AS created_at
FROM nation CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) s WHERE n_nationkey >= 4 AND s.k <= n_nationkey % 3
"""


class Tables:
    """The given tables and the AML views of one data folder, as attributes; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            sql = VIEWS[name]
            for base in BASE:
                if re.search(rf"\b(FROM|JOIN) {base}\b", sql):
                    self.spark.read.parquet(f"{self.sf_dir}/{base}.parquet").createOrReplaceTempView(base)
            return self.spark.sql(sql)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """Puts the views that a statement names before it, as common table expressions."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not named:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in named)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
