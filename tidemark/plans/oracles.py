"""SQL for the queries of ``problems``; DuckDB runs it over the same tables."""

P1 = """
WITH d AS (
  SELECT generation_id, security_id,
    max(upper(trim(trading_status)) = 'ACTIVE') AS active,
    arg_max(row(nullif(upper(trim(issuer_id)), ''), nullif(upper(trim(current_ticker)), ''), nullif(upper(trim(name)), ''),
      nullif(upper(trim(asset_type)), ''), nullif(upper(trim(primary_exchange)), ''), nullif(upper(trim(country)), ''),
      nullif(upper(trim(cik)), ''), listing_date, nullif(upper(trim(trading_status)), ''), delisting_date,
      nullif(upper(trim(currency)), '')), updated_at) AS v
  FROM security_master_snapshots WHERE generation_id IS NOT NULL AND security_id IS NOT NULL GROUP BY ALL),
n AS (SELECT generation_id, count(*) AS rows, count(*) FILTER (WHERE active) AS actives FROM d GROUP BY 1),
g AS (
  SELECT generation_id, lag(generation_id) OVER (PARTITION BY universe ORDER BY target_session, created_at, generation_id) AS before
  FROM (SELECT DISTINCT generation_id, universe, target_session, created_at, status, row_count, active_count FROM security_master_generations)
  JOIN n USING (generation_id)
  WHERE status = 'PUBLISHED' AND rows = row_count AND actives = active_count),
a AS (SELECT g.generation_id, d.security_id, d.v FROM g JOIN d USING (generation_id) WHERE before IS NOT NULL),
b AS (SELECT g.generation_id, d.security_id, d.v FROM g JOIN d ON d.generation_id = g.before)
SELECT generation_id, security_id,
  CASE WHEN b.i IS NULL THEN 'added' WHEN a.i IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT *, 1 AS i FROM a) a FULL JOIN (SELECT *, 1 AS i FROM b) b USING (generation_id, security_id)
WHERE a.i IS NULL OR b.i IS NULL OR a.v IS DISTINCT FROM b.v
"""

_VALID = """
a AS (SELECT security_id, date, arg_max(row(close, volume), row(coalesce(source_asof, DATE '0001-01-01'), ingestion_run_id)) AS v
  FROM coverage_bars WHERE security_id IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
v AS (SELECT security_id, date, v[1] AS close, v[2] AS volume FROM a
  WHERE isfinite(v[1]) AND isfinite(v[2]) AND v[1] > 0 AND v[2] >= 0)
"""

P2 = f"""
WITH {_VALID},
e AS (SELECT DISTINCT date, security_id, adv20_usd, valid_sessions_20d, (SELECT max(session_no) FROM trading_sessions WHERE session_date <= date) AS no
  FROM eligibility_audit),
b AS (SELECT security_id, session_no, close * volume AS usd FROM v JOIN trading_sessions ON date = session_date),
t AS (SELECT e.date, e.security_id, any_value(adv20_usd) AS stored, any_value(valid_sessions_20d) AS n, count(usd) AS m, avg(usd) AS mean
  FROM e LEFT JOIN b ON b.security_id = e.security_id AND session_no BETWEEN no - 19 AND no GROUP BY ALL)
SELECT strftime(date, '%Y-%m-%d') AS audit_date, security_id FROM t
WHERE n IS DISTINCT FROM m OR (stored IS NULL) <> (mean IS NULL) OR abs(stored - mean) > 0.002 * abs(mean)
"""

P2_TOTALS = f"""
WITH {_VALID},
x AS (SELECT security_id, date, CAST(volume AS DECIMAL(38,6)) AS volume, CAST(close * volume AS DECIMAL(38,6)) AS usd, session_no AS no
  FROM v LEFT JOIN trading_sessions ON date = session_date),
d AS (SELECT security_id, CAST(unnest(generate_series(min(date), greatest(max(date), (SELECT max(session_date) FROM trading_sessions)), INTERVAL 1 DAY)) AS DATE) AS day FROM coverage_bars WHERE security_id IS NOT NULL AND date IS NOT NULL GROUP BY 1),
n AS (SELECT *, (SELECT max(session_no) FROM trading_sessions WHERE session_date <= day) AS no FROM d),
t7 AS (SELECT security_id, day, count(volume) AS n, sum(volume) AS volume, sum(usd) AS usd FROM n LEFT JOIN x USING (security_id)
  WHERE date BETWEEN day - 6 AND day GROUP BY ALL),
t30 AS (SELECT security_id, day, count(volume) AS n, sum(volume) AS volume, sum(usd) AS usd FROM n LEFT JOIN x USING (security_id)
  WHERE date BETWEEN day - 29 AND day GROUP BY ALL),
t20 AS (SELECT n.security_id, day, count(volume) AS n, sum(volume) AS volume, sum(usd) AS usd FROM n JOIN x ON x.security_id = n.security_id
  AND x.no BETWEEN n.no - 19 AND n.no GROUP BY ALL)
SELECT security_id, strftime(day, '%Y-%m-%d') AS day,
  coalesce(t7.n, 0) AS n_d7, CAST(t7.volume AS DOUBLE) AS volume_d7, round(CAST(t7.volume AS DOUBLE) / t7.n, 1) AS mean_volume_d7, CAST(t7.usd AS DOUBLE) AS usd_d7, round(CAST(t7.usd AS DOUBLE) / t7.n, 1) AS mean_usd_d7,
  coalesce(t30.n, 0) AS n_d30, CAST(t30.volume AS DOUBLE) AS volume_d30, round(CAST(t30.volume AS DOUBLE) / t30.n, 1) AS mean_volume_d30, CAST(t30.usd AS DOUBLE) AS usd_d30, round(CAST(t30.usd AS DOUBLE) / t30.n, 1) AS mean_usd_d30,
  coalesce(t20.n, 0) AS n_s20, CAST(t20.volume AS DOUBLE) AS volume_s20, round(CAST(t20.volume AS DOUBLE) / t20.n, 1) AS mean_volume_s20, CAST(t20.usd AS DOUBLE) AS usd_s20, round(CAST(t20.usd AS DOUBLE) / t20.n, 1) AS mean_usd_s20
FROM d LEFT JOIN t7 USING (security_id, day) LEFT JOIN t30 USING (security_id, day) LEFT JOIN t20 USING (security_id, day)
"""

P2_STATE = f"""
WITH {_VALID},
x AS (SELECT security_id, CAST(close * volume AS DECIMAL(38,6)) AS usd, session_no AS no FROM v JOIN trading_sessions ON date = session_date),
e AS (SELECT min(session_no) AS low, max(session_no) AS high FROM trading_sessions),
p AS (SELECT session_no FROM trading_sessions, e WHERE (session_no - low) % 128 = 127 OR session_no = high)
SELECT CAST(p.session_no AS INT) AS session_no, security_id, CAST(count(*) AS INT) AS n_s20, round(CAST(sum(usd) AS DOUBLE), 2) AS usd_s20 FROM p JOIN x ON no BETWEEN p.session_no - 19 AND p.session_no GROUP BY ALL
"""

def _spell(f: str) -> str:
    """Rows of ``r`` whose field lies in a spell away from the levels before and after it."""
    ok = lambda c: f"isfinite({c}) AND {c} > 0"
    return f"""
x_{f} AS (SELECT security_id, date, row_number() OVER w - 1 AS i, x, median(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before, median(x) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS after,
  lag(x) OVER w AS p1, lag(x, 2) OVER w AS p2, lead(x) OVER w AS n1, lead(x, 2) OVER w AS n2
  FROM (SELECT security_id, date, ln(v.{f} / v.close) AS x FROM acc WHERE {ok(f'v.{f}')} AND {ok('v.close')}) WINDOW w AS (PARTITION BY security_id ORDER BY date)),
j_{f} AS (SELECT r.*, ln(r.{f} / r.close) AS own, x.i AS p, x.i + CASE WHEN x.date = r.date THEN 1 ELSE 0 END AS q, [x.p1, x.p2] AS earlier, CASE WHEN x.date = r.date THEN [x.n1, x.n2] ELSE [x.x, x.n1] END AS later
  FROM (SELECT r.*, 8 * m.m AS lim FROM r JOIN m USING (security_id) WHERE m.m > 0 AND {ok(f'r.{f}')} AND {ok('r.close')}) r ASOF JOIN x_{f} x ON x.security_id = r.security_id AND r.date <= x.date),
s_{f} AS (SELECT DISTINCT j.origin, j.security_id, j.date, j.run FROM j_{f} j CROSS JOIN (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)) k(a, b)
  JOIN x_{f} s ON s.security_id = j.security_id AND s.i = p - a AND s.i >= 1 JOIN x_{f} e ON e.security_id = j.security_id AND e.i = q + b
  WHERE abs(own - s.before) > lim AND abs(own - e.after) > lim AND abs(s.p1 - s.before) <= lim AND abs(e.x - e.after) <= lim
    AND len(list_filter(list_concat(earlier[1:a], later[1:b]), lambda o: coalesce(abs(o - s.before) > lim AND abs(o - e.after) > lim, false))) = a + b)"""


def _stuck(f: str) -> str:
    return f"""
g_{f} AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY security_id ORDER BY date) AS g FROM (SELECT security_id, date, v.{f} AS value,
  coalesce(v.{f} = lag(v.{f}) OVER (PARTITION BY security_id ORDER BY date) AND NOT isnan(v.{f}), false) AS same FROM acc WHERE v.volume > 0 AND NOT isnan(v.volume))),
k_{f} AS (SELECT security_id, date, value FROM g_{f} QUALIFY count(*) OVER (PARTITION BY security_id, g) >= 5),
t_{f} AS (SELECT r.origin, r.security_id, r.date, r.run FROM r JOIN k_{f} k ON k.security_id = r.security_id AND k.date = r.date AND k.value = r.{f} WHERE origin = 'coverage_bars')"""


_READ = ("open", "adj_close", "unadjusted_close")
_SOUND = " AND ".join(f"isfinite({c}) AND {c} > 0" for c in ("open", "high", "low", "close", "adj_close", "unadjusted_close"))
_ROWS = "security_id, date, ingestion_run_id AS run, open, close, adj_close, unadjusted_close"
P3 = f"""
WITH acc AS (SELECT security_id, date, arg_max({{{", ".join(f"'{c}': {c}" for c in (*_READ, "close", "volume"))}}}, row(coalesce(source_asof, DATE '0001-01-01'), ingestion_run_id)) AS v
  FROM coverage_bars WHERE security_id IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
m AS (SELECT security_id, median(abs(ln(open / close))) AS m FROM coverage_bars WHERE {_SOUND} AND isfinite(volume) AND volume >= 0 GROUP BY 1),
r AS (SELECT 'coverage_bars' AS origin, {_ROWS} FROM coverage_bars UNION ALL SELECT 'bar_quarantine', {_ROWS} FROM bar_quarantine),
{_spell("adj_close")}, {_spell("unadjusted_close")}, {", ".join(_stuck(f) for f in _READ)},
o AS (SELECT r.* FROM r JOIN m USING (security_id) WHERE m > 0 AND isfinite(open) AND open > 0 AND isfinite(close) AND close > 0 AND abs(ln(open / close)) > 8 * m),
hit AS (SELECT origin, security_id, date, run FROM r WHERE {" OR ".join(f"NOT isfinite({c}) OR {c} <= 0" for c in _READ)}
  UNION SELECT origin, security_id, date, run FROM o {" ".join(f"UNION SELECT * FROM s_{f}" for f in _READ[1:])} {" ".join(f"UNION SELECT * FROM t_{f}" for f in _READ)})
SELECT origin, security_id, strftime(date, '%Y-%m-%d') AS bar_date, run AS ingestion_run_id FROM hit
"""

P4 = """
WITH i AS (
  SELECT security_id, coalesce(effective_from, DATE '0001-01-01') AS f, coalesce(effective_to, DATE '9999-12-31') AS t FROM symbol_history
  UNION
  SELECT security_id, coalesce(start_date, DATE '0001-01-01'), coalesce(next_alias_start - 1, end_date, DATE '9999-12-31') FROM query_mappings),
r AS (SELECT *, max(t) OVER (PARTITION BY security_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM i WHERE f <= t AND security_id IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR f - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS n FROM r),
p AS (SELECT security_id, n, min(f) AS f, max(t) AS t FROM g GROUP BY ALL),
x AS (SELECT security_id, 'period' AS kind, f, t FROM p UNION ALL
  SELECT security_id, 'gap', t + 1, lead(f) OVER (PARTITION BY security_id ORDER BY f) - 1 FROM p
  QUALIFY lead(f) OVER (PARTITION BY security_id ORDER BY f) IS NOT NULL)
SELECT security_id, kind, strftime(f, '%Y-%m-%d') AS from_day, strftime(t, '%Y-%m-%d') AS to_day FROM x
"""

P5 = """
WITH m AS (SELECT *, coalesce(upper(trim(snapshot_type)), '') AS kind FROM pit_membership),
c AS (SELECT * FROM m WHERE kind IN ('MONTH_END', 'FORCED_EXIT_CARRY_FORWARD', '')),
k AS (SELECT date, min(knowledge_date) AS known FROM c GROUP BY 1),
q AS (SELECT DISTINCT date AS d FROM factor_values),
s AS (SELECT d, max(date) AS snap FROM q JOIN k ON known <= d GROUP BY 1),
f AS (SELECT DISTINCT date, security_id FROM factor_values WHERE security_id IS NOT NULL AND date IS NOT NULL),
a AS (SELECT f.date, f.security_id, s.snap, max_by(coalesce(c.active, false), (c.knowledge_date, coalesce(c.active, false))) AS active
  FROM f LEFT JOIN s ON s.d = f.date LEFT JOIN c ON c.security_id = f.security_id AND c.date = s.snap AND c.knowledge_date <= f.date GROUP BY ALL),
b AS (SELECT a.date, a.security_id, coalesce(active, false) AND NOT EXISTS (SELECT 1 FROM m WHERE kind = 'FORCED_EXIT' AND m.security_id = a.security_id
  AND m.date > a.snap AND m.date <= a.date AND m.knowledge_date <= a.date) AS member FROM a)
SELECT DISTINCT strftime(date, '%Y-%m-%d') AS obs_date, security_id, factor_id FROM factor_values JOIN b USING (date, security_id)
WHERE pit_member <> member AND factor_id IS NOT NULL
"""

ORACLES = {"p1_found": P1, "p2_found": P2, "p2_totals": P2_TOTALS, "p2_state": P2_STATE, "p3_found": P3, "p4_found": P4, "p5_found": P5}
