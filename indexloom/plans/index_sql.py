"""The index in SQL, for checking: building blocks that each query's statement starts with."""

import re

from indexloom.functions import constants as C

_ROUTES = ", ".join(f"({i}, '{o}', '{d}', '{'-'.join(sorted((o, d)))}', {p:.1f}::DOUBLE)" for i, (o, d, p) in enumerate(C.ROUTES))
_SCENARIOS = ", ".join(f"('{s}', {lead}, {w}::DOUBLE)" for s, ws in C.SCENARIOS.items() for lead, w in ws.items())
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)

BLOCKS = {
    "routes": f"SELECT *, pax / sum(pax) OVER () AS weight FROM (VALUES {_ROUTES}) v(route_id, origin, destination, pair, pax)",
    "scenarios": f"SELECT * FROM (VALUES {_SCENARIOS}) v(scenario, lead_time_days, lead_weight)",
    "quotes": """SELECT e.event_id AS quote_id, e.ts AS collection_ts_utc, CAST(e.ts AS DATE) AS collection_date, 's' AS source, r.origin, r.destination,
        ([1, 7, 15, 30, 45])[CAST((e.user_id // 24) % 5 AS INTEGER) + 1] AS lead_time_days, e.event_type AS carrier, e.value AS total_fare,
        (e.event_type <> 'error' AND e.value > 0 AND CAST(e.ts AS DATE) <> DATE '2024-01-15') AS is_available,
        CASE WHEN e.event_type <> 'error' AND e.value > 0 AND CAST(e.ts AS DATE) <> DATE '2024-01-15' THEN NULL
             WHEN CAST(e.ts AS DATE) = DATE '2024-01-15' OR e.value <= 0 THEN 'blocked' WHEN e.event_id % 2 = 0 THEN 'sold_out' ELSE 'timeout' END AS unavailable_reason
        FROM events e JOIN routes r ON r.route_id = e.user_id % 24""",
    "days": "SELECT collection_date, row_number() OVER (ORDER BY collection_date) AS day_no FROM (SELECT DISTINCT collection_date FROM quotes)",
    "strata": "SELECT DISTINCT origin, destination, lead_time_days FROM quotes",
    "items": "SELECT source, origin, destination, lead_time_days, carrier, collection_date, min(total_fare) AS total_fare FROM quotes WHERE is_available AND total_fare IS NOT NULL GROUP BY ALL",
    "numbered": "SELECT i.*, d.day_no FROM items i JOIN days d ON d.collection_date = i.collection_date",
    "matched": """SELECT b.origin, b.destination, b.lead_time_days, b.day_no, exp(avg(ln(b.total_fare / a.total_fare))) AS relative, count(*) AS matched_items
        FROM numbered b JOIN numbered a ON a.source = b.source AND a.origin = b.origin AND a.destination = b.destination AND a.lead_time_days = b.lead_time_days AND a.carrier = b.carrier AND b.day_no = a.day_no + 1
        GROUP BY ALL""",
    "item_counts": "SELECT origin, destination, lead_time_days, day_no, count(*) AS n FROM numbered GROUP BY ALL",
    "relatives": """SELECT s.origin, s.destination, s.lead_time_days, d.collection_date, d.day_no, m.relative, coalesce(m.matched_items, 0) AS matched_items, coalesce(c.n, 0) AS items_this_period, coalesce(p.n, 0) AS items_prev_period
        FROM strata s CROSS JOIN days d
        LEFT JOIN matched m ON m.origin = s.origin AND m.destination = s.destination AND m.lead_time_days = s.lead_time_days AND m.day_no = d.day_no
        LEFT JOIN item_counts c ON c.origin = s.origin AND c.destination = s.destination AND c.lead_time_days = s.lead_time_days AND c.day_no = d.day_no
        LEFT JOIN item_counts p ON p.origin = s.origin AND p.destination = s.destination AND p.lead_time_days = s.lead_time_days AND p.day_no = d.day_no - 1
        WHERE d.day_no > 1""",
    "movements": """SELECT *, exp(avg(ln(relative)) OVER (PARTITION BY collection_date, origin, destination)) AS m1,
        exp(avg(ln(relative)) OVER (PARTITION BY collection_date, lead_time_days)) AS m2, exp(avg(ln(relative)) OVER (PARTITION BY collection_date)) AS m3 FROM relatives""",
    "imputed": f"""SELECT origin, destination, lead_time_days, collection_date, relative, matched_items, coalesce(relative, m1, m2, m3) AS relative_used,
        CASE WHEN relative IS NOT NULL THEN '{C.TIER_OBSERVED}' WHEN m1 IS NOT NULL THEN '{C.TIER_ROUTE}' WHEN m2 IS NOT NULL THEN '{C.TIER_LEAD}' WHEN m3 IS NOT NULL THEN '{C.TIER_ALL}' ELSE '{C.TIER_NONE}' END AS imputation_tier
        FROM movements""",
    "levels": """SELECT origin, destination, lead_time_days, collection_date,
        CASE WHEN relative_used IS NOT NULL THEN 100 * exp(coalesce(sum(ln(relative_used)) OVER (PARTITION BY origin, destination, lead_time_days ORDER BY collection_date), 0)) END AS stratum_index, imputation_tier, matched_items
        FROM imputed
        UNION ALL SELECT s.origin, s.destination, s.lead_time_days, d.collection_date, 100.0::DOUBLE, 'observed', NULL FROM strata s CROSS JOIN days d WHERE d.day_no = 1""",
    "weights": "SELECT s.scenario, r.origin, r.destination, s.lead_time_days, r.weight * s.lead_weight AS weight FROM routes r CROSS JOIN scenarios s",
    "cell_flags": f"""SELECT collection_date, origin, destination, lead_time_days, bool_or(is_available AND total_fare IS NOT NULL) AS p, coalesce(bool_or(unavailable_reason IN ({_LIST(C.FAILURES)})), false) AS b, coalesce(bool_or(unavailable_reason IN ({_LIST(C.MARKET_SIGNALS)})), false) AS s
        FROM quotes GROUP BY ALL""",
    "availability": "SELECT collection_date, count(*) FILTER (WHERE p) AS cells_priced, CAST(120 AS BIGINT) AS cells_in_basket, count(*) FILTER (WHERE p) / 120.0::DOUBLE AS availability_rate, count(*) FILTER (WHERE b) AS cells_blocked, count(*) FILTER (WHERE s) AS cells_sold_out FROM cell_flags GROUP BY collection_date",
    "points": """SELECT l.collection_date, w.scenario, sum(l.stratum_index * w.weight) / sum(w.weight) AS index_value, max(a.availability_rate) AS availability_rate,
        coalesce(sum(w.weight) FILTER (WHERE l.imputation_tier = 'observed'), 0) / sum(w.weight) AS observed_weight_share, count(*) AS strata_contributing, CAST(120 AS BIGINT) AS strata_in_basket
        FROM levels l JOIN weights w ON w.origin = l.origin AND w.destination = l.destination AND w.lead_time_days = l.lead_time_days LEFT JOIN availability a ON a.collection_date = l.collection_date
        WHERE l.stratum_index IS NOT NULL GROUP BY l.collection_date, w.scenario""",
    "published": "SELECT collection_date, scenario, round(index_value, 4) AS index_value, round(availability_rate, 4) AS availability_rate, round(observed_weight_share, 4) AS observed_weight_share, strata_contributing, strata_in_basket FROM points",
    "direct": """SELECT d.collection_date, CASE WHEN d.day_no = 1 THEN 100.0::DOUBLE ELSE 100 * exp(avg(ln(t.total_fare / b.total_fare))) END AS direct_index, CASE WHEN d.day_no > 1 THEN count(b.total_fare) END AS matched_vs_base
        FROM days d LEFT JOIN numbered t ON t.day_no = d.day_no
        LEFT JOIN numbered b ON b.day_no = 1 AND b.source = t.source AND b.origin = t.origin AND b.destination = t.destination AND b.lead_time_days = t.lead_time_days AND b.carrier = t.carrier
        GROUP BY d.collection_date, d.day_no""",
    "matrix": """SELECT a.day_no AS a, b.day_no AS b, avg(ln(b.total_fare) - ln(a.total_fare)) AS ln_p, count(*) AS matched
        FROM numbered a JOIN numbered b ON a.source = b.source AND a.origin = b.origin AND a.destination = b.destination AND a.lead_time_days = b.lead_time_days AND a.carrier = b.carrier AND abs(a.day_no - b.day_no) < 25 AND a.day_no <> b.day_no
        GROUP BY ALL UNION ALL SELECT day_no, day_no, 0.0::DOUBLE, NULL FROM days""",
    "ends": "SELECT day_no AS e FROM days WHERE day_no >= least(25, (SELECT max(day_no) FROM days))",
    "window_levels": """SELECT w.e, p.b AS t, avg(p.ln_p - f.ln_p) AS ln_g FROM ends w JOIN matrix p ON p.a <= w.e AND p.a > w.e - 25 AND p.b <= w.e AND p.b > w.e - 25
        JOIN matrix f ON f.a = p.a AND f.b = w.e - 24 GROUP BY ALL""",
    "window_lists": "SELECT w.e, list(g.ln_g ORDER BY d.day_no) AS g FROM ends w JOIN days d ON d.day_no <= w.e LEFT JOIN window_levels g ON g.e = w.e AND g.t = d.day_no GROUP BY w.e",
    "splice": """SELECT e, g AS lv FROM window_lists WHERE e = 25 UNION ALL
        SELECT w.e, list_append(s.lv, w.g[w.e] + list_avg(list_filter(list_transform(range(w.e - 24, w.e), lambda i: s.lv[i] - w.g[i]), lambda x: x IS NOT NULL))) FROM splice s JOIN window_lists w ON w.e = s.e + 1""",
    "geks": "SELECT d.collection_date, 100 * exp(s.lv[d.day_no]) AS geks_index FROM days d CROSS JOIN (SELECT lv FROM splice ORDER BY e DESC LIMIT 1) s",
    "drift_days": """SELECT p.collection_date, p.index_value, g.geks_index, d.direct_index, p.index_value - g.geks_index AS gap, row_number() OVER (ORDER BY p.collection_date) - 1 AS k
        FROM published p JOIN geks g ON g.collection_date = p.collection_date JOIN direct d ON d.collection_date = p.collection_date WHERE p.scenario = 'uniform' AND g.geks_index IS NOT NULL""",
}


def statement(select: str, extra: dict[str, str] | None = None) -> str:
    """WITH all blocks that the statement needs (in their order) and the final SELECT."""
    blocks = BLOCKS | (extra or {})
    need: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in blocks:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(blocks[name])
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({blocks[n]})" for n in blocks if n in need) + " " if need else "") + select
