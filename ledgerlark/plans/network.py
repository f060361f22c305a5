"""Behaviour, pattern and network queries over the AML views."""

from __future__ import annotations

from ledgerlark.operators import behavior as B
from ledgerlark.operators import network as G
from ledgerlark.plans.sql import AT, NOW, cnt, pct, r, total


def _win(days: int) -> str:
    return f"{NOW} - INTERVAL {days} DAY"


def _edges(days: int = 90) -> str:
    return f"SELECT from_customer_id AS src, to_customer_id AS dst, {total('amount')} AS amount, count(*) AS n FROM aml_txn WHERE created_at >= {_win(days)} AND from_customer_id <> to_customer_id GROUP BY 1, 2"


_NODES = f"""SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, {total('s')} AS total_sent, {total('r')} AS total_received FROM (
  SELECT src AS node, 1 AS o, 0 AS i, amount AS s, 0E0 AS r FROM ({_edges()}) e UNION ALL SELECT dst, 0, 1, 0E0, amount FROM ({_edges()}) e) x GROUP BY 1"""
_M = "CAST(amount AS DECIMAL(18,2))"
_SD = "CASE WHEN n > 1 THEN sqrt(greatest(0E0, (q - s * s / n) / (n - 1))) ELSE 0E0 END"
_SQ = f"CAST(sum({_M}) AS DOUBLE) AS s, CAST(sum({_M} * {_M}) AS DOUBLE) AS q"
_ANOMALY = f"""SELECT t.id AS txn_id, t.from_customer_id AS customer_id, amount, {r('mean')} AS mean_amount, CASE WHEN std > 0 THEN {r('(amount - mean) / std')} ELSE 0E0 END AS deviation FROM aml_txn t JOIN (
  SELECT c, s / n AS mean, {_SD} AS std FROM (SELECT from_customer_id AS c, count(*) AS n, {_SQ} FROM aml_txn GROUP BY 1) a WHERE n >= 3) m ON m.c = t.from_customer_id WHERE amount > mean + std * 2.5E0"""
_OFF = f"""SELECT g.customer_id, g.n, off_hours, {pct('off_hours', 'g.n')} AS off_hours_pct, CAST(m.h AS INTEGER) AS most_active_hour FROM (SELECT from_customer_id AS customer_id, count(*) AS n, {cnt('hour(created_at) < 8 OR hour(created_at) >= 20')} AS off_hours FROM aml_txn GROUP BY 1) g
  LEFT JOIN (SELECT customer_id, h FROM (SELECT from_customer_id AS customer_id, hour(created_at) AS h, row_number() OVER (PARTITION BY from_customer_id ORDER BY count(*) DESC, hour(created_at)) AS k FROM aml_txn WHERE hour(created_at) < 8 OR hour(created_at) >= 20 GROUP BY 1, 2) z WHERE k = 1) m ON m.customer_id = g.customer_id"""
_STRUCT = f"""SELECT *, {r('least(100E0, days * 20E0 + amount / 10000E0 * 5E0)')} AS structuring_score FROM (SELECT customer_id, count(*) AS days, {total('s')} AS amount FROM (
  SELECT from_customer_id AS customer_id, CAST(created_at AS DATE) AS d, count(*) AS n, {total('amount')} AS s FROM aml_txn WHERE amount BETWEEN 7000 AND 9800 GROUP BY 1, 2) x WHERE n >= 2 AND s >= 10000 GROUP BY 1) y"""
_NEAR = " OR ".join(f"abs(amount - {k}) / {k} < 0.01E0" for k in (f"(least(greatest({f}(amount / 1000), 1), 999) * 1000E0)" for f in ("floor", "ceil")))
_ROUND = f"SELECT *, {pct('round_n', 'n')} AS round_pct FROM (SELECT from_customer_id AS customer_id, count(*) AS n, {cnt('amount % 1000 = 0')} AS round_n, {cnt(f'amount % 1000 <> 0 AND ({_NEAR})')} AS near_round_n FROM aml_txn WHERE amount > 0 GROUP BY 1) x"


def _ch(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 100E0 ELSE 0E0 END ELSE {r(f'({a} - {b}) / {b} * 100E0')} END"


_REC, _PRI = f"created_at >= {_win(7)}", f"created_at >= {_win(14)} AND created_at < {_win(7)}"
_SPIKE = f"""SELECT *, count_change > 200 OR volume_change > 200 AS is_spike FROM (SELECT *, {_ch('recent_n', 'prior_n')} AS count_change, {_ch('recent_volume', 'prior_volume')} AS volume_change FROM (
  SELECT from_customer_id AS customer_id, {cnt(_REC)} AS recent_n, {cnt(_PRI)} AS prior_n, {total('amount', _REC)} AS recent_volume, {total('amount', _PRI)} AS prior_volume FROM aml_txn GROUP BY 1) x) y"""
_SMURF = f"""SELECT *, {r('least(100E0, groups * 25E0 + amount / 10000E0 * 5E0)')} AS confidence FROM (SELECT customer_id, count(*) AS groups, {total('s2')} AS amount FROM (
  SELECT customer_id, sum(n) OVER w AS n2, CAST(sum(CAST(s AS DECIMAL(18,2))) OVER w AS DOUBLE) AS s2 FROM (SELECT from_customer_id AS customer_id, CAST(created_at AS DATE) AS d, count(*) AS n, {total('amount')} AS s FROM aml_txn WHERE amount >= 7000 AND amount < 9900 GROUP BY 1, 2) x
  WINDOW w AS (PARTITION BY customer_id ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)) y WHERE n2 >= 2 AND s2 >= 10000 GROUP BY 1) z"""
_INTEG = f"""SELECT *, least(100E0, events * 15E0 + flagged * 5E0) AS confidence FROM (SELECT customer_id, {cnt("transaction_type IN ('payment', 'wire') AND amount >= 5000 AND seen > 0")} AS events, {cnt('f')} AS flagged FROM (
  SELECT from_customer_id AS customer_id, transaction_type, amount, flagged AS f, count(*) FILTER (WHERE flagged) OVER (PARTITION BY from_customer_id ORDER BY epoch_us(created_at) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS seen FROM aml_txn) x GROUP BY 1) y"""
_RAPID = f"""SELECT *, least(100E0, clusters * 20E0) AS confidence FROM (SELECT customer_id, count(*) AS clusters, max(s) AS largest FROM (SELECT from_customer_id AS customer_id, count(*) OVER w AS n, CAST(sum({_M}) OVER w AS DOUBLE) AS s FROM aml_txn
  WINDOW w AS (PARTITION BY from_customer_id ORDER BY created_at RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOUR FOLLOWING)) x WHERE n >= 3 AND s >= 10000 GROUP BY 1) y"""
_OTHERS = f"""SELECT *, concat_ws(',', CASE WHEN others > 10 THEN 'high_diversity' END, CASE WHEN one_time > others * 0.8E0 AND others >= 5 THEN 'mostly_one_time' END) AS anomalies, least(100E0, others * 5E0 + one_time * 3E0) AS confidence FROM (
  SELECT a AS customer_id, count(*) AS others, {cnt('n = 1')} AS one_time FROM (SELECT a, b, count(*) AS n FROM (SELECT from_customer_id AS a, to_customer_id AS b FROM aml_txn UNION ALL SELECT to_customer_id, from_customer_id FROM aml_txn) p WHERE a <> b GROUP BY 1, 2) q GROUP BY 1) z"""


_X = "x AS (SELECT id, from_customer_id, to_customer_id, amount, created_at FROM aml_txn WHERE amount > 0 AND from_customer_id <> to_customer_id"
def _grown(hours: int, rule: str, strict: bool, most: int | None, where: str = "") -> str:
    """``p``: chains of any length up to ``most`` transactions."""
    span = f"b.created_at > p.at AND b.created_at < p.at + INTERVAL {hours} HOUR" if strict else f"b.created_at >= p.at AND b.created_at <= p.at + INTERVAL {hours} HOUR"
    return f"""WITH RECURSIVE {_X}{where}), p AS (SELECT id AS start_id, [id] AS ids, [from_customer_id, to_customer_id] AS path, to_customer_id AS last, amount, created_at AS at, amount AS total FROM x
    UNION ALL SELECT p.start_id, list_append(p.ids, b.id), list_append(p.path, b.to_customer_id), b.to_customer_id, b.amount, b.created_at, p.total + b.amount FROM p JOIN x b ON b.from_customer_id = p.last AND {span} AND abs(b.amount - p.amount) / p.amount {rule} AND NOT list_contains(p.path, b.to_customer_id){f' WHERE len(p.ids) < {most}' if most else ''})"""


_LAYER = f"{_grown(48, '<= 0.2E0', False, None)} SELECT start_id, array_to_string(ids, ',') AS txn_ids, array_to_string(path, ',') AS customers, {r('total')} AS total_amount FROM p WHERE len(ids) >= 3"
_CHAINS = f"{_grown(24, '< 0.15E0', True, 9, f' AND created_at >= {_win(30)}')} SELECT start_id, CAST(len(ids) AS INTEGER) AS length, ids[-1] AS end_id, {r('total')} AS total_amount FROM (SELECT *, row_number() OVER (PARTITION BY start_id, len(ids) ORDER BY ids) AS k FROM p WHERE len(ids) >= 2) q WHERE k = 1"
_CYCLES = "\nUNION\n".join(
    f"SELECT CAST({n} AS INTEGER) AS length, array_to_string(list_sort([{', '.join(f'e{i}.src' for i in range(1, n + 1))}]), ',') AS nodes FROM e e1 "
    + " ".join(f"JOIN e e{i} ON e{i}.src = e{i - 1}.dst AND e{i}.src > e1.src" + "".join(f" AND e{i}.src <> e{j}.src" for j in range(2, i)) for i in range(2, n + 1)) + f" WHERE e{n}.dst = e1.src" for n in range(2, 6))
_FEAT = f"""SELECT node, {r('out_degree / o', 4)} AS f_out_degree, {r('in_degree / i', 4)} AS f_in_degree, {r('ln(1E0 + total_sent)', 4)} AS f_log_sent, {r('ln(1E0 + total_received)', 4)} AS f_log_received, {r('out_degree / (in_degree + 1)', 4)} AS f_degree_ratio, {r('total_sent / (total_received + 1)', 4)} AS f_amount_ratio
  FROM nodes, (SELECT greatest(max(out_degree), 1) AS o, greatest(max(in_degree), 1) AS i FROM nodes) m"""


def _stat(k: str) -> str:
    d = f"CAST({k} AS DECIMAL(19,4))"
    std = f"sqrt(greatest(0E0, (CAST(sum(CAST({d} * {d} AS DECIMAL(38,6))) AS DOUBLE) - CAST(sum({d}) AS DOUBLE) * CAST(sum({d}) AS DOUBLE) / count(*)) / (count(*) - 1)))"
    return f"CAST(sum({d}) AS DOUBLE) / count(*) AS {k}_mean, CASE WHEN {std} = 0 THEN 1E0 ELSE {std} END AS {k}_std"


_F = [f"f_{n}" for n in G.FEATURES]
_Z = {n: f"abs(f_{n} - f_{n}_mean) / f_{n}_std" for n in G.FEATURES}


def _graph(t, days: int = 90):
    return G.graph_edges(t.aml_txn, AT, days)


_SCORES = f"""WITH l AS ({_LAYER}), b AS (SELECT DISTINCT from_customer_id AS customer_id FROM aml_txn), lc AS (SELECT CAST(string_split(customers, ',')[1] AS BIGINT) AS customer_id, least(100E0, count(*) * 25E0) AS confidence FROM l GROUP BY 1)
        SELECT customer_id, smurfing, layering, integration, rapid_movement, counterparties, {r('least(100E0, 0E0 + smurfing * 0.25E0 + layering * 0.25E0 + integration * 0.2E0 + rapid_movement * 0.15E0 + counterparties * 0.15E0)')} AS composite FROM (
        SELECT b.customer_id, coalesce(s.confidence, 0E0) AS smurfing, coalesce(lc.confidence, 0E0) AS layering, coalesce(i.confidence, 0E0) AS integration, coalesce(m.confidence, 0E0) AS rapid_movement, coalesce(c.confidence, 0E0) AS counterparties FROM b LEFT JOIN ({_SMURF}) s ON s.customer_id = b.customer_id
        LEFT JOIN lc ON lc.customer_id = b.customer_id LEFT JOIN ({_INTEG}) i ON i.customer_id = b.customer_id LEFT JOIN ({_RAPID}) m ON m.customer_id = b.customer_id LEFT JOIN ({_OTHERS}) c ON c.customer_id = b.customer_id) x"""

def _isolation(levels: int = 32) -> str:
    """Levels of ``f`` one by one: as many as a table of 2^31 nodes can need, those beyond the limit changing nothing."""
    steps = ["n AS (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE length(bin(count(*))) END AS most FROM f)", "l0 AS (SELECT f.*, 'r' AS cell, CAST(NULL AS INTEGER) AS depth FROM f)"]
    for d in range(levels):
        x = _F[d % len(_F)]
        cell = f"CASE WHEN active AND NOT stop THEN cell || CASE WHEN {x} < (lo + hi) / 2 THEN '0' ELSE '1' END ELSE cell END"
        steps.append(
            f"""l{d + 1} AS (SELECT node, {', '.join(_F)}, {cell} AS cell, CASE WHEN active AND stop THEN CAST({d} AS INTEGER) ELSE depth END AS depth FROM (
            SELECT *, depth IS NULL AND {d} < most AS active, k <= 1 OR lo = hi AS stop FROM (SELECT *, min({x}) OVER w AS lo, max({x}) OVER w AS hi, count(*) OVER w AS k FROM l{d} WINDOW w AS (PARTITION BY cell)) a, n) b)"""
        )
    return ", ".join(steps) + f"""
        SELECT node, depth, score, score > 0.9E0 AS is_anomaly FROM (SELECT node, depth, {r('power(2E0, -depth / (greatest(1, most) / 2E0))', 4)} AS score FROM (SELECT node, CAST(coalesce(depth, most) AS INTEGER) AS depth, most FROM l{levels}, n) a) b"""


PLANS = {
    "behavior_off_hours": (lambda t: B.behavior_off_hours(t.aml_txn), _OFF),
    "behavior_amount_anomaly": (lambda t: B.behavior_amount_anomaly(t.aml_txn), _ANOMALY),
    "behavior_velocity_spike": (lambda t: B.behavior_velocity_spike(t.aml_txn, AT), _SPIKE),
    "behavior_structuring": (lambda t: B.behavior_structuring(t.aml_txn), _STRUCT),
    "behavior_round_amounts": (lambda t: B.behavior_round_amounts(t.aml_txn), _ROUND),
    "behavior_profile": (
        lambda t: B.behavior_profile(t.aml_txn),
        f"""SELECT p.*, coalesce(o.off_hours_pct, 0E0) AS off_hours_pct, coalesce(structuring_score, 0E0) AS structuring_score, coalesce(round_pct, 0E0) AS round_pct,
        concat_ws(',', CASE WHEN off_hours_pct > 30 THEN 'off_hours' END, CASE WHEN structuring_score > 50 THEN 'structuring' END, CASE WHEN round_pct > 40 THEN 'round_amounts' END, CASE WHEN destinations > 5 THEN 'many_destinations' END) AS flags FROM (
        SELECT customer_id, n, s AS total_amount, {r('s / n')} AS mean_amount, {r(_SD)} AS std_amount, max_amount, destinations, origins, types, flagged, international FROM (SELECT from_customer_id AS customer_id, count(*) AS n, {_SQ}, max(amount) AS max_amount, count(DISTINCT destination_country) AS destinations,
        count(DISTINCT originating_country) AS origins, string_agg(DISTINCT transaction_type, ',' ORDER BY transaction_type) AS types, {cnt('flagged')} AS flagged, {cnt('is_international')} AS international FROM aml_txn GROUP BY 1) a) p
        LEFT JOIN ({_OFF}) o ON o.customer_id = p.customer_id LEFT JOIN ({_STRUCT}) z ON z.customer_id = p.customer_id LEFT JOIN ({_ROUND}) u ON u.customer_id = p.customer_id""",
    ),
    "behavior_risk_score": (
        lambda t: B.behavior_risk_score(t.aml_txn, AT),
        f"""SELECT customer_id, s AS behavioral_score, CASE WHEN s >= 75 THEN 'critical' WHEN s >= 50 THEN 'high' WHEN s >= 25 THEN 'medium' ELSE 'low' END AS risk_band FROM (SELECT b.customer_id, least(100E0, {r('''least(15E0, coalesce(off_hours_pct, 0E0) * 0.5E0) + least(25E0, coalesce(structuring_score, 0E0) * 0.25E0)
        + least(10E0, coalesce(round_pct, 0E0) * 0.2E0) + CASE WHEN is_spike THEN 20E0 WHEN count_change > 100 THEN 12E0 WHEN count_change > 50 THEN 7E0 ELSE 0E0 END + least(15E0, coalesce(outliers, 0) * 3E0) + least(15E0, countries * 2E0)''')}) AS s
        FROM (SELECT from_customer_id AS customer_id, count(DISTINCT destination_country) AS countries FROM aml_txn GROUP BY 1) b LEFT JOIN ({_OFF}) o ON o.customer_id = b.customer_id LEFT JOIN ({_STRUCT}) z ON z.customer_id = b.customer_id LEFT JOIN ({_ROUND}) u ON u.customer_id = b.customer_id
        LEFT JOIN ({_SPIKE}) v ON v.customer_id = b.customer_id LEFT JOIN (SELECT customer_id, count(*) AS outliers FROM ({_ANOMALY}) w GROUP BY 1) a ON a.customer_id = b.customer_id) q""",
    ),
    "pattern_smurfing": (lambda t: B.pattern_smurfing(t.aml_txn), _SMURF),
    "pattern_integration": (lambda t: B.pattern_integration(t.aml_txn), _INTEG),
    "pattern_rapid_clusters": (lambda t: B.pattern_rapid_clusters(t.aml_txn), _RAPID),
    "pattern_counterparties": (lambda t: B.pattern_counterparties(t.aml_txn), _OTHERS),
    "pattern_layering": (lambda t: G.pattern_layering(t.aml_txn), _LAYER),
    "pattern_scores": (lambda t: B.pattern_scores(t.aml_txn, G.layering_confidence(t.aml_txn)), _SCORES),
    "graph_edges": (lambda t: _graph(t, 30), _edges(30)),
    "graph_nodes": (lambda t: G.graph_nodes(_graph(t)), _NODES),
    "graph_cycles": (lambda t: G.graph_cycles(_graph(t)), f"WITH e AS (SELECT src, dst FROM ({_edges()}) q) {_CYCLES}"),
    "graph_hubs": (
        lambda t: G.graph_hubs(G.graph_nodes(_graph(t)), t.aml_customer),
        f"SELECT node, out_degree + in_degree AS degree, out_degree, in_degree, full_name, risk_level FROM ({_NODES}) n LEFT JOIN aml_customer c ON c.customer_id = n.node WHERE out_degree + in_degree >= 5",
    ),
    "graph_layering_chains": (lambda t: G.graph_layering_chains(t.aml_txn, AT), _CHAINS),
    "graph_centrality": (
        lambda t: G.graph_centrality(G.graph_nodes(_graph(t)), _graph(t)),
        f"""WITH nodes AS ({_NODES}), p AS (SELECT node, sum(n) AS taken FROM (SELECT src AS node, n FROM ({_edges()}) a UNION ALL SELECT dst, n FROM ({_edges()}) b) x GROUP BY 1)
        SELECT nodes.node, {r('(out_degree + in_degree) / (k - 1)', 4)} AS degree, {r('in_degree / (k - 1)', 4)} AS in_degree, {r('out_degree / (k - 1)', 4)} AS out_degree, {r('taken / most', 4)} AS participation
        FROM nodes JOIN p ON p.node = nodes.node, (SELECT count(*) AS k FROM nodes) c, (SELECT max(taken) AS most FROM p) m""",
    ),
    "graph_components": (
        lambda t: G.graph_components(_graph(t)),
        f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM ({_edges()}) q UNION SELECT dst, src FROM ({_edges()}) q), c AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node), m AS (SELECT node, min(root) AS component FROM c GROUP BY 1), s AS (SELECT component, count(*) AS size FROM m GROUP BY 1)
        SELECT m.node, m.component, s.size, s.size = (SELECT max(size) FROM s) AS in_largest FROM m JOIN s ON s.component = m.component""",
    ),
    "node_features": (lambda t: G.node_features(G.graph_nodes(_graph(t))), f"WITH nodes AS ({_NODES}) {_FEAT}"),
    "node_anomalies": (
        lambda t: G.node_anomalies(G.node_features(G.graph_nodes(_graph(t)))),
        f"""WITH nodes AS ({_NODES}), f AS ({_FEAT}), s AS (SELECT {', '.join(_stat(k) for k in _F)} FROM f) SELECT node, reasons, max_z, CASE WHEN max_z > 5 THEN 'high' ELSE 'medium' END AS severity FROM (
        SELECT node, concat_ws(',', {', '.join(f"CASE WHEN {z} > 2.5 THEN '{n}' END" for n, z in _Z.items())}) AS reasons, {r('greatest(' + ', '.join(f'CASE WHEN {z} > 2.5 THEN {z} ELSE 0E0 END' for z in _Z.values()) + ')', 3)} AS max_z FROM f, s) x WHERE reasons <> ''""",
    ),
    "edge_anomalies": (
        lambda t: G.edge_anomalies(_graph(t)),
        f"""WITH e AS ({_edges()}), s AS (SELECT {_stat('amount')}, {_stat('n')} FROM e) SELECT src, dst, amount, n, {r('za', 3)} AS amount_z, {r('zn', 3)} AS count_z, CASE WHEN za > zn THEN 'high_amount' ELSE 'high_frequency' END AS kind
        FROM (SELECT e.*, abs(amount - amount_mean) / amount_std AS za, abs(n - n_mean) / n_std AS zn FROM e, s) x WHERE za > 2.5 OR zn > 2.5""",
    ),
    "isolation_depth_scores": (lambda t: G.isolation_depth_scores(G.node_features(G.graph_nodes(_graph(t)))), f"WITH nodes AS ({_NODES}), f AS ({_FEAT}), {_isolation()}"),
}
