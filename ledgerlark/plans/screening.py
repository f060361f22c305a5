"""Screening queries over the AML views."""

from __future__ import annotations

from ledgerlark.functions.names import folded
from ledgerlark.operators import screening as S
from ledgerlark.plans.sql import cnt, pct, r


def _fold(x: str) -> str:
    plain = rf"regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\x01-\x7F]', '', 'g')), '[^a-z0-9_\s]', ' ', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array({plain}, '\\s+'), lambda w: w <> '' AND w NOT IN ('mr', 'mrs', 'ms', 'dr', 'prof', 'sir')), ' ')"


_BASE = f"""q AS (SELECT query_id, {_fold("coalesce(name, '')")} AS q FROM aml_screen_query), a AS (SELECT alias_id, entry_id, alias_name, low_quality, is_primary, {_fold('alias_name')} AS c FROM aml_sanctions_alias),
t AS (SELECT query_id, q, list_filter(list_distinct(string_split(q, ' ')), lambda w: length(w) >= 3) AS long FROM q WHERE q <> ''),
cand AS (SELECT query_id, q, alias_id, entry_id, alias_name, low_quality, c FROM t, a WHERE CASE WHEN len(long) > 0 THEN len(list_filter(long, lambda w: contains(lower(alias_name), w))) > 0 WHEN length(q) >= 2 THEN contains(lower(alias_name), q) ELSE contains(c, q) END),
tok AS (SELECT *, list_sort(list_distinct(string_split(q, ' '))) AS qt, list_distinct(string_split(c, ' ')) AS ct FROM cand WHERE c <> ''),
sc AS (SELECT query_id, alias_id, entry_id, alias_name, low_quality, CASE WHEN q = c OR list_has_all(ct, qt) THEN 100E0 ELSE floor(least(99.9E0, 60E0 * (list_sum(list_transform(qt, lambda x: list_max(list_transform(ct, lambda y: jaro_winkler_similarity(x, y))))) / len(qt))
  + 25E0 * jaro_winkler_similarity(q, c) + 15E0 * (len(list_intersect(qt, ct)) / len(list_distinct(list_concat(qt, ct))))) * 100E0 + 0.5E0 + 1E-9) / 100E0 END AS raw FROM tok)"""
_PARTS = ("address", "city", "state_province", "postal_code", "country")
_ADDRESS = f"nullif(concat_ws(', ', {', '.join(f'nullif({c}, {chr(39) * 2})' for c in _PARTS)}), '')"
_BY_ID = """SELECT s.query_id, i.entry_id, (SELECT alias_id FROM aml_sanctions_alias x WHERE x.entry_id = i.entry_id ORDER BY is_primary DESC, alias_id LIMIT 1) AS alias_id
FROM (SELECT query_id, lower(id_number) AS n FROM aml_screen_query WHERE coalesce(id_number, '') <> '') s JOIN (SELECT DISTINCT entry_id, lower(id_value) AS v FROM aml_sanctions_identifier) i ON contains(i.v, s.n)"""
_PROGRAMS = """unnest(CASE WHEN trim(programs) LIKE '[%]' THEN from_json(programs, '["VARCHAR"]') ELSE [trim(programs)] END)"""


PLANS = {
    "normalize_names": (lambda t: t.aml_sanctions_alias.select("alias_id", folded("alias_name").alias("normalized")), f"SELECT alias_id, {_fold('alias_name')} AS normalized FROM aml_sanctions_alias"),
    "screen_candidates": (lambda t: S.screen_candidates(t.aml_screen_query, t.aml_sanctions_alias), f"WITH {_BASE} SELECT query_id, alias_id FROM cand"),
    "name_match_score": (lambda t: S.name_scores(t.aml_screen_query, t.aml_sanctions_alias), f"WITH {_BASE} SELECT query_id, alias_id, raw AS score FROM sc UNION ALL SELECT query_id, alias_id, 0E0 FROM cand WHERE c = ''"),
    "screen_location_filter": (
        lambda t: S.screen_location_filter(t.aml_sanctions_entry, t.aml_sanctions_location, country="ira", city="MOSC").select("entry_id", "country", "city"),
        "SELECT e.entry_id, l.country, l.city FROM aml_sanctions_entry e LEFT JOIN aml_sanctions_location l ON l.entry_id = e.entry_id WHERE contains(upper(l.country), 'IRA') AND (l.entry_id IS NULL OR contains(lower(l.city), 'mosc'))",
    ),
    "screen_by_id": (lambda t: S.screen_by_id(t.aml_screen_query, t.aml_sanctions_identifier, t.aml_sanctions_alias), f"SELECT DISTINCT * FROM ({_BY_ID}) x"),
    "bulk_screen": (
        lambda t: S.bulk_screen(t.aml_screen_query, t.aml_sanctions_entry, t.aml_sanctions_alias, t.aml_sanctions_location, t.aml_sanctions_identifier),
        f"""WITH {_BASE}, h AS (SELECT query_id, entry_id, alias_id, alias_name, {r('s')} AS score, 0 AS k FROM (SELECT *, CASE WHEN low_quality AND raw < 100 THEN raw * 0.97E0 ELSE raw END AS s FROM sc) x WHERE s >= 65
          UNION ALL SELECT i.query_id, i.entry_id, i.alias_id, a.alias_name, 100E0, 1 FROM (SELECT DISTINCT * FROM ({_BY_ID}) y) i JOIN a ON a.alias_id = i.alias_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, encode(alias_name), alias_id, k) AS rank FROM h)
        SELECT s.query_id, CAST(coalesce(rank, 0) AS INTEGER) AS rank, n.entry_id, e.primary_name, n.alias_name AS matched_name, e.list_name, score, CASE WHEN score IS NULL THEN 'NO MATCH' WHEN score >= 85 THEN 'STRONG' WHEN score >= 70 THEN 'POSSIBLE' ELSE 'WEAK' END AS label,
          {_ADDRESS} AS address, g.aliases FROM aml_screen_query s LEFT JOIN (SELECT * FROM n WHERE rank <= 5) n ON n.query_id = s.query_id LEFT JOIN aml_sanctions_entry e ON e.entry_id = n.entry_id LEFT JOIN aml_sanctions_location l ON l.entry_id = n.entry_id
          LEFT JOIN (SELECT entry_id, string_agg(alias_name, '|' ORDER BY encode(alias_name)) AS aliases FROM aml_sanctions_alias GROUP BY 1) g ON g.entry_id = n.entry_id""",
    ),
    "sanctions_overview": (
        lambda t: S.sanctions_overview(t.aml_sanctions_entry, t.aml_sanctions_alias),
        f"SELECT *, {r('aliases / entries')} AS avg_aliases FROM (SELECT count(*) AS entries, {cnt("list_name = 'SDN'")} AS ofac, {cnt("list_name = 'UN'")} AS un, (SELECT count(*) FROM aml_sanctions_alias) AS aliases FROM aml_sanctions_entry) x",
    ),
    "sanctions_entity_types": (
        lambda t: S.sanctions_entity_types(t.aml_sanctions_entry),
        f"SELECT entity_type, list_name, n, {pct('n', 'w')} AS pct FROM (SELECT entity_type, list_name, count(*) AS n, (SELECT count(*) FROM aml_sanctions_entry) AS w FROM aml_sanctions_entry GROUP BY 1, 2) x",
    ),
    "sanctions_top_programs": (
        lambda t: S.sanctions_top_programs(t.aml_sanctions_entry),
        f"WITH p AS (SELECT {_PROGRAMS} AS program FROM aml_sanctions_entry), g AS (SELECT program, count(*) AS n FROM p GROUP BY 1) SELECT program, n, {pct('n', '(SELECT sum(n) FROM g)')} AS pct FROM g ORDER BY n DESC, program LIMIT 15",
    ),
    "sanctions_geography": (
        lambda t: S.sanctions_geography(t.aml_sanctions_location),
        f"WITH g AS (SELECT country, count(*) AS n FROM aml_sanctions_location WHERE country IS NOT NULL GROUP BY 1 ORDER BY n DESC, country LIMIT 20) SELECT country, n, {pct('n', '(SELECT sum(n) FROM g)')} AS pct FROM g",
    ),
    "sanctions_alias_quality": (
        lambda t: S.sanctions_alias_quality(t.aml_sanctions_alias),
        f"SELECT *, {pct('low_quality_n', 'n')} AS low_quality_pct FROM (" + " UNION ALL ".join(f"SELECT {k} AS alias_type, count(*) AS n, {cnt('is_primary')} AS primary_n, {cnt('low_quality')} AS low_quality_n FROM aml_sanctions_alias GROUP BY 1" for k in ("alias_type", "'all'")) + ") x",
    ),
    "sanctions_difficulty": (
        lambda t: S.sanctions_difficulty(t.aml_sanctions_entry, t.aml_sanctions_alias, t.aml_sanctions_location),
        f"""SELECT x AS complexity, CASE WHEN x < 10 THEN 'Low' WHEN x < 20 THEN 'Medium' ELSE 'High' END AS level, {pct('p', 'e')} AS location_coverage_pct FROM (SELECT e, p, {r('a / e * 2E0 + l / a * 100E0 * 0.5E0', 1)} AS x FROM (SELECT (SELECT count(*) FROM aml_sanctions_entry) AS e, count(*) AS a, {cnt('low_quality')} AS l,
        (SELECT count(DISTINCT entry_id) FROM aml_sanctions_location) AS p FROM aml_sanctions_alias) q) z""",
    ),
}
