"""SQL with the results of the queries, put together from common table expressions. All times are January 2024: New York is UTC-5."""

from __future__ import annotations

PARTS: dict[str, str] = {
    "base": """SELECT event_type AS symbol, time_bucket(INTERVAL 5 minute, ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL""",
    "seq": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_seq FROM base",
    "det": """SELECT symbol, time_bucket(INTERVAL 15 minute, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, ts) AS close, sum(volume) AS volume FROM base GROUP BY symbol, time_bucket(INTERVAL 15 minute, ts)""",
    "ranged": """SELECT *, row_number() OVER w AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
        FROM det WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "smooth": """SELECT * FROM (WITH RECURSIVE s AS (SELECT symbol, i, tr AS a, close AS m FROM ranged WHERE i = 1 UNION ALL
        SELECT r.symbol, r.i, s.a * (13 / 14.0::DOUBLE) + r.tr / 14, s.m * (49 / 51.0::DOUBLE) + r.close * (2 / 51.0::DOUBLE) FROM s JOIN ranged r ON r.symbol = s.symbol AND r.i = s.i + 1)
        SELECT r.*, CASE WHEN r.i >= 14 THEN s.a END AS atr, s.m AS ema50 FROM ranged r JOIN s USING (symbol, i))""",
    "cal": """SELECT *, hour(l) AS hour, minute(l) AS minute, isodow(l) - 1 AS dow, month(l) AS month, year(l) AS year, CAST(l AS DATE) AS local_date,
        CASE WHEN isodow(l) > 5 THEN 'WEEKEND' WHEN t >= 1080 OR t < 180 THEN 'ASIA' WHEN t < 570 THEN 'LONDON' WHEN t < 960 THEN 'RTH' ELSE 'AFTER' END AS session
        FROM (SELECT *, ts - INTERVAL 5 hour AS l, hour(ts - INTERVAL 5 hour) * 60 + minute(ts - INTERVAL 5 hour) AS t FROM smooth)""",
    "days": """SELECT symbol, local_date, lag(h) OVER w AS prior_day_high, lag(l) OVER w AS prior_day_low, lag(c) OVER w AS prior_day_close,
        lag(h) OVER w - lag(l) OVER w AS prior_day_range, o - lag(c) OVER w AS gap_points
        FROM (SELECT symbol, local_date, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c, arg_min(open, ts) AS o FROM cal GROUP BY ALL)
        WINDOW w AS (PARTITION BY symbol ORDER BY local_date)""",
    "feat": """SELECT c.* EXCLUDE (l), d.* EXCLUDE (symbol, local_date), (close - ema50) / atr AS dist_ema50_atr, (max(high) OVER w - min(low) OVER w) / atr AS day_range_atr,
        prior_day_range / atr AS prior_day_range_atr, gap_points / atr AS gap_atr FROM cal c JOIN days d USING (symbol, local_date)
        WINDOW w AS (PARTITION BY symbol, local_date ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
    "hbars": """SELECT symbol, time_bucket(INTERVAL 4 hour, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, ts) AS close FROM base GROUP BY symbol, time_bucket(INTERVAL 4 hour, ts)""",
    "hranged": """SELECT *, row_number() OVER w AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
        FROM hbars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "htf": """SELECT symbol, ts AS htf_label, ts + INTERVAL 4 hour AS closed_at, close AS htf_close, open AS htf_open, m AS htf_ema, a AS htf_atr, high - low AS htf_range,
        (close - m) / a AS htf_dist_ema_atr, (m - lag(m, 3) OVER w) / a AS htf_slope_atr, (high - low) / a AS htf_range_atr,
        CASE WHEN close >= m THEN 1 ELSE -1 END AS htf_bias, CASE WHEN close >= open THEN 1 ELSE -1 END AS htf_bar_dir
        FROM (WITH RECURSIVE s AS (SELECT symbol, i, tr AS a, close AS m FROM hranged WHERE i = 1 UNION ALL
          SELECT r.symbol, r.i, s.a * (13 / 14.0::DOUBLE) + r.tr / 14, s.m * (49 / 51.0::DOUBLE) + r.close * (2 / 51.0::DOUBLE) FROM s JOIN hranged r ON r.symbol = s.symbol AND r.i = s.i + 1)
          SELECT r.*, CASE WHEN r.i >= 14 THEN s.a END AS a, s.m FROM hranged r JOIN s USING (symbol, i)) WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "spacing": """SELECT symbol, CASE WHEN sum(n) < 3 THEN 60 ELSE arg_max(gap, row(CASE WHEN gap IS NULL THEN -1 ELSE n END, -coalesce(gap, 0))) END * INTERVAL 1 second AS tf FROM (
        SELECT symbol, gap, count(*) AS n FROM (SELECT symbol, CAST(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS gap FROM det) GROUP BY ALL) GROUP BY symbol""",
    "fvg": """SELECT symbol, ts AS known, ts AS source_ts, CASE WHEN low > h2 THEN h2 ELSE high END AS zone_low, CASE WHEN low > h2 THEN low ELSE l2 END AS zone_high,
        CASE WHEN low > h2 THEN 1 ELSE -1 END AS bias, atr, 500 AS age FROM (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY ts))
        WHERE atr > 0 AND (low > h2 OR high < l2)""",
    "gaps": """SELECT symbol, known + tf AS formed_at, known + tf + age * tf AS expires_at, source_ts, zone_low, zone_high, zone_high - zone_low AS zone_height,
        (zone_high - zone_low) / atr AS zone_height_atr, (zone_high - zone_low) / atr AS displacement_atr, bias, row_number() OVER (ORDER BY symbol, known) AS z
        FROM fvg JOIN spacing USING (symbol) WHERE (zone_high - zone_low) / atr >= 0.25 AND zone_high > zone_low""",
    "met": """SELECT z.*, s.ts AS bar_ts, s.bar_seq, s.open, s.high, s.low, s.close FROM gaps z JOIN seq s ON s.symbol = z.symbol AND s.ts BETWEEN z.formed_at + INTERVAL 15 minute AND z.expires_at
        AND s.high >= z.zone_low AND s.low <= z.zone_high""",
    "first": "SELECT *, 1 AS test_number FROM met QUALIFY row_number() OVER (PARTITION BY z ORDER BY bar_seq) = 1",
    "ctx": """SELECT t.*, f.session, f.hour, f.minute, f.dow, f.month, f.year, g.atr, coalesce(g.dist_ema50_atr, 0) AS dist_ema50_atr,
        CASE WHEN g.local_date = f.local_date THEN coalesce(g.day_range_atr, 0) ELSE 0 END AS day_range_atr, coalesce(f.prior_day_range, 0) / g.atr AS prior_day_range_atr,
        coalesce(f.gap_points, 0) / g.atr AS gap_atr, (epoch(t.bar_ts) - epoch(t.formed_at)) / 900 AS bars_since_zone
        FROM TESTS t ASOF JOIN feat f ON f.symbol = t.symbol AND t.bar_ts >= f.ts ASOF JOIN feat g ON g.symbol = t.symbol AND t.bar_ts >= g.ts + INTERVAL 15 minute WHERE g.atr > 0""",
    "known": """SELECT c.*, coalesce(h.htf_bias, 0)::DOUBLE AS htf_bias, coalesce(h.htf_bar_dir, 0)::DOUBLE AS htf_bar_dir, coalesce(h.htf_slope_atr, 0) AS htf_slope_atr,
        coalesce(h.htf_dist_ema_atr, 0) AS htf_dist_ema_atr, coalesce(h.htf_range_atr, 0) AS htf_range_atr, coalesce((epoch(bar_ts) - epoch(h.closed_at)) / 14400, 0) AS htf_bar_progress,
        CASE WHEN h.htf_bias = c.bias THEN 1.0 ELSE 0.0 END::DOUBLE AS aligned, CASE WHEN h.htf_bar_dir = c.bias THEN 1.0 ELSE 0.0 END::DOUBLE AS aligned_bar
        FROM ctx c ASOF LEFT JOIN htf h ON h.symbol = c.symbol AND c.bar_ts > h.closed_at""",
    "kept": "SELECT *, bar_seq AS i, CASE WHEN bias = 1 THEN zone_high ELSE zone_low END AS entry FROM known WHERE FILTERS",
    "levels": """SELECT *, entry + bias * GOAL AS target FROM (SELECT *, (entry - stop) * bias AS risk_points FROM (SELECT *, STOP AS stop FROM kept)) WHERE risk_points > 0""",
    "walk": """SELECT e.z, e.test_number, s.bar_seq, e.i, s.close, (s.high - e.entry) * e.bias AS up, (s.low - e.entry) * e.bias AS down, (s.close - e.entry) * e.bias AS shut, e.bias,
        (e.target - e.entry) * e.bias AS goal, e.risk_points AS r FROM levels e JOIN seq s ON s.symbol = e.symbol AND s.bar_seq >= e.i AND s.bar_seq < e.i + HORIZON""",
    "moves": """SELECT *, least(up, down) AS bad, CASE WHEN LIMITED AND bar_seq = i THEN greatest(0, shut) ELSE greatest(up, down) END AS good, greatest(up, down) AS raw FROM walk""",
    "ends": """SELECT z, test_number, min(bar_seq) FILTER (bad <= -r) AS s, min(bar_seq) FILTER (good >= goal) AS g, greatest(0, max(good / r)) AS mfe_r, greatest(0, max(-bad / r)) AS mae_r,
        max(bar_seq) AS last, arg_max(shut, bar_seq) AS shut, bool_or(coalesce(bar_seq = i AND LIMITED AND raw >= goal AND good < goal, false)) AS unsure FROM moves GROUP BY z, test_number""",
    "ev": """SELECT l.*, l.bar_ts AS ts, mfe_r, mae_r, CASE WHEN s <= coalesce(g, s) THEN 'loss' WHEN g IS NOT NULL THEN 'win' ELSE 'timeout' END AS outcome,
        unsure OR coalesce(s = g, false) AS ambiguous, CASE WHEN s <= coalesce(g, s) THEN -1.0 WHEN g IS NOT NULL THEN (target - entry) * bias / risk_points ELSE shut / risk_points END::DOUBLE AS r_fixed,
        CAST(CASE WHEN s <= coalesce(g, s) THEN s WHEN g IS NOT NULL THEN g ELSE last END - i + 1 AS INTEGER) AS bars_held, s <= coalesce(g, s) AND false AS no,
        s IS NULL AND g IS NOT NULL OR g < s AS win FROM levels l JOIN ends USING (z, test_number)""",
}

#: The settings of the first study: limit fill at a gap's near edge, stop at its far one, twice the risk as target.
STUDY = {"TESTS": "first", "FILTERS": "zone_height_atr < 3 AND (hour >= 2 OR session <> 'ASIA')", "GOAL": "2 * risk_points", "HORIZON": "240", "LIMITED": "true",
         "STOP": "CASE WHEN bias = 1 THEN zone_low ELSE zone_high END"}

ORACLE_SQL: dict[str, str] = {}


def sql(select: str, last: str, extra: dict[str, str] | None = None, **settings: str) -> str:
    """The select after all parts up to ``last``, and then ``extra`` ones, with the study's settings filled in."""
    names = list(PARTS)
    own = {n: PARTS[n] for n in names[: names.index(last) + 1]} | (extra or {})
    text = "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in own.items()) + "\n" + select
    for k, v in (STUDY | settings).items():
        text = text.replace(k, v)
    return text


def _columns(names: str, times: tuple[str, ...] = ("ts", "formed_at", "expires_at", "source_ts", "bar_ts", "first_ts", "last_ts", "htf_label", "closed_at", "utc")) -> str:
    """Names as columns: times in whole seconds, names marked ~ rounded to six places."""
    out = []
    for n in names.split():
        plain = n.rstrip("~")
        out.append(f"CAST(epoch({plain}) AS BIGINT) AS {plain}" if plain in times else f"round({plain}, 6) AS {plain}" if n.endswith("~") else plain)
    return ", ".join(out)


BARS = _columns("symbol ts open~ high~ low~ close~ volume~")
ZONE = _columns("symbol formed_at expires_at source_ts zone_low~ zone_high~ zone_height~ zone_height_atr~ displacement_atr~ bias")
EVENT = _columns("symbol ts formed_at zone_low~ zone_high~ bias entry~ stop~ target~ risk_points~ outcome ambiguous r_fixed~ mfe_r~ mae_r~ bars_held")
TEST = _columns("symbol formed_at zone_low~ zone_high~ bias bar_ts") + ", CAST(test_number AS INTEGER) AS test_number"


def _wilson(k: str, n: str) -> str:
    z = 1.959963984540054
    half = f"{z} * sqrt(({k}) / ({n})::DOUBLE * (1 - ({k}) / ({n})::DOUBLE) / ({n}) + {z * z} / (4.0 * ({n}) * ({n}))) / (1 + {z * z} / ({n}))"
    centre = f"(({k}) / ({n})::DOUBLE + {z * z} / (2.0 * ({n}))) / (1 + {z * z} / ({n}))"
    return f"round(({k}) / ({n})::DOUBLE, 6) AS rate, round(greatest(0, {centre} - {half}), 6) AS ci_low, round(least(1, {centre} + {half}), 6) AS ci_high"


def _zones(body: str, age: int, also: str = "CAST(NULL AS DOUBLE) AS displacement_atr") -> dict[str, str]:
    """Zones from a query with known, source_ts, zone_low, zone_high, bias, zone_height_atr."""
    return {"found": body, "zones": f"SELECT *, known + tf AS formed_at, known + tf + {age} * tf AS expires_at, zone_high - zone_low AS zone_height, {also} FROM found JOIN spacing USING (symbol) WHERE zone_high > zone_low"}


def _block(threshold: float, back: int, swing: bool, low: str, high: str) -> dict[str, str]:
    """Order blocks: rows of places are joined to those before them, where the plan uses windows."""
    rule = " AND CASE WHEN move > 0 THEN m.high > top ELSE m.low < bottom END" if swing else ""
    return _zones(
        f"""SELECT m.symbol, m.ts AS known, c.ts AS source_ts, {low} AS zone_low, {high} AS zone_high, CASE WHEN move > 0 THEN 1 ELSE -1 END AS bias,
        ({high} - {low}) / size AS zone_height_atr, abs(move) / size AS d FROM (
          SELECT f.symbol, f.ts, f.i, f.high, f.low, f.close - (SELECT o.open FROM feat o WHERE o.symbol = f.symbol AND o.i = f.i - {back - 1}) AS move,
            (SELECT o.atr FROM feat o WHERE o.symbol = f.symbol AND o.i = f.i - {back}) AS size,
            (SELECT max(o.high) FROM feat o WHERE o.symbol = f.symbol AND o.i BETWEEN f.i - {back - 1 + 10} AND f.i - {back}) AS top,
            (SELECT min(o.low) FROM feat o WHERE o.symbol = f.symbol AND o.i BETWEEN f.i - {back - 1 + 10} AND f.i - {back}) AS bottom
          FROM feat f) m JOIN feat c ON c.symbol = m.symbol AND c.i BETWEEN m.i - {back - 1 + 15} AND m.i - {back} AND CASE WHEN move > 0 THEN c.close < c.open ELSE c.close > c.open END
        WHERE size > 0 AND abs(move) / size >= {threshold} AND m.i > {10 + back + 1}{rule} QUALIFY row_number() OVER (PARTITION BY m.symbol, m.i ORDER BY c.i DESC) = 1""",
        500, "d AS displacement_atr",
    )


O = ORACLE_SQL
O["b1_bars_from_ticks"] = sql(f"SELECT {BARS} FROM base", "base")
O["b1_resample"] = sql(f"SELECT {BARS} FROM det", "det")
O["b1_resample_anchored"] = sql(
    f"SELECT {BARS} FROM seven", "base",
    {"seven": """SELECT symbol, a + floor((epoch(ts) - epoch(a)) / 25200)::BIGINT * INTERVAL 7 hour AS ts, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close, sum(volume) AS volume
      FROM (SELECT *, ts AS t, date_trunc('day', min(ts) OVER (PARTITION BY symbol)) AS a FROM base) GROUP BY symbol, a + floor((epoch(ts) - epoch(a)) / 25200)::BIGINT * INTERVAL 7 hour"""},
)
O["v4_bar_seq"] = sql(f"SELECT {_columns('symbol ts bar_seq')} FROM seq", "seq")
O["f1_atr"] = sql(f"SELECT {_columns('symbol ts atr~')} FROM smooth", "smooth")
O["f2_ema"] = sql(f"SELECT {_columns('symbol ts ema50~')} FROM smooth", "smooth")
O["f3_f4_calendar_and_session"] = sql(
    f"SELECT {_columns('symbol ts session')}, hour::INTEGER AS hour, minute::INTEGER AS minute, dow::INTEGER AS dow, month::INTEGER AS month, year::INTEGER AS year, strftime(local_date, '%Y-%m-%d') AS local_date FROM cal", "cal"
)
O["f7_f9_prior_days"] = sql(f"SELECT {_columns('symbol prior_day_high~ prior_day_low~ prior_day_close~ prior_day_range~ gap_points~')}, strftime(local_date, '%Y-%m-%d') AS local_date FROM days", "days")
O["f12_features"] = sql(
    f"SELECT {_columns('symbol ts atr~ ema50~ session dist_ema50_atr~ day_range_atr~ prior_day_range~ prior_day_range_atr~ gap_points~ gap_atr~ prior_day_high~ prior_day_low~ prior_day_close~')}, hour::INTEGER AS hour FROM feat", "feat"
)
O["f10_swing_points"] = sql(
    f"SELECT {_columns('symbol ts pivot_high pivot_low')} FROM p WHERE pivot_high OR pivot_low", "ranged",
    {"p": """SELECT f.symbol, f.ts, f.high > max(o.high) AND count(*) = 7 AS pivot_high, f.low < min(o.low) AND count(*) = 7 AS pivot_low FROM ranged f
      JOIN ranged o ON o.symbol = f.symbol AND o.i BETWEEN f.i - 3 AND f.i + 4 AND o.i <> f.i GROUP BY f.symbol, f.ts, f.high, f.low"""},
)
O["f11_htf_context"] = sql(f"SELECT {_columns('symbol htf_label closed_at htf_close~ htf_open~ htf_ema~ htf_atr~ htf_range~ htf_dist_ema_atr~ htf_slope_atr~ htf_range_atr~ htf_bias htf_bar_dir')} FROM htf", "htf")
O["z1_order_block"] = sql(f"SELECT {ZONE} FROM zones", "spacing", _block(1.2, 2, True, "least(c.open, c.close)", "greatest(c.open, c.close)"))
O["z1_order_block_wick"] = sql(f"SELECT {ZONE} FROM zones", "spacing", _block(1.5, 1, False, "c.low", "c.high"))
O["z2_fair_value_gap"] = sql(f"SELECT {ZONE} FROM gaps", "gaps")
O["z3_swing_level"] = sql(
    f"SELECT {ZONE} FROM zones", "spacing",
    _zones("""SELECT p.symbol, c.ts AS known, p.ts AS source_ts, CASE WHEN hi THEN high ELSE low END - 0.1 * c.atr AS zone_low, CASE WHEN hi THEN high ELSE low END + 0.1 * c.atr AS zone_high,
      CASE WHEN hi THEN -1 ELSE 1 END AS bias, 0.2::DOUBLE AS zone_height_atr FROM (SELECT f.symbol, f.ts, f.i, f.high, f.low, f.high > max(o.high) AND count(*) = 10 AS hi, f.low < min(o.low) AND count(*) = 10 AS lo FROM feat f
        JOIN feat o ON o.symbol = f.symbol AND o.i BETWEEN f.i - 5 AND f.i + 5 AND o.i <> f.i GROUP BY f.symbol, f.ts, f.i, f.high, f.low) p
      JOIN (SELECT symbol, i, ts, atr FROM feat) c ON c.symbol = p.symbol AND c.i = p.i + 5 WHERE (hi OR lo) AND c.atr > 0""", 1000),
)
O["z4_prior_session_level"] = sql(
    f"SELECT {ZONE} FROM zones", "spacing",
    _zones("""SELECT d.symbol, known, known AS source_ts, level - 0.1 * b.atr AS zone_low, level + 0.1 * b.atr AS zone_high, -1 AS bias, 0.2::DOUBLE AS zone_height_atr
      FROM (SELECT symbol, local_date, max(high) AS level, max(ts) AS known, lead(local_date) OVER (PARTITION BY symbol ORDER BY local_date) AS later FROM feat WHERE session = 'RTH' GROUP BY symbol, local_date) d
      JOIN spacing s USING (symbol) JOIN (SELECT symbol, max(ts) AS final FROM feat GROUP BY symbol) m USING (symbol)
      ASOF JOIN (SELECT symbol, ts, atr FROM feat) b ON b.symbol = d.symbol AND d.known + s.tf > b.ts WHERE later IS NOT NULL AND known + s.tf <= final AND b.atr > 0""", 1440),
)
O["z5_round_number"] = sql(
    f"SELECT {ZONE} FROM zones", "spacing",
    _zones("""SELECT symbol, known, known AS source_ts, level - 0.1 * atr AS zone_low, level + 0.1 * atr AS zone_high, CASE WHEN level < open THEN 1 ELSE -1 END AS bias, 0.2::DOUBLE AS zone_height_atr
      FROM (SELECT *, floor(open / 10) * 10 + unnest([-2, -1, 0, 1, 2]) * 10 AS level FROM (SELECT symbol, ts AS known, open, atr FROM feat QUALIFY row_number() OVER (PARTITION BY symbol, local_date ORDER BY ts) = 1)) WHERE atr > 0""", 1440),
)
O["z6_z7_detect_long"] = sql(f"SELECT {ZONE} FROM gaps WHERE zone_height_atr >= 0.5 AND bias = 1", "gaps")
O["j1_zone_hits"] = sql(
    "SELECT symbol, CAST(epoch(formed_at) AS BIGINT) AS formed_at, round(zone_low, 6) AS zone_low, bias, count(*) AS hits, CAST(sum(bar_seq) AS BIGINT) AS places, CAST(epoch(min(bar_ts)) AS BIGINT) AS first_ts "
    "FROM met WHERE close BETWEEN zone_low AND zone_high GROUP BY ALL", "met",
)
O["j2_first_test"] = sql(f"SELECT {TEST} FROM first", "first")
O["j3_separate_tests"] = sql(
    f"SELECT {TEST} FROM t", "met",
    {"runs": "SELECT *, bar_seq - row_number() OVER (PARTITION BY z ORDER BY bar_seq) AS run FROM met",
     "t": """SELECT *, row_number() OVER (PARTITION BY z ORDER BY bar_seq) AS test_number FROM
       (SELECT * FROM runs WHERE close BETWEEN zone_low AND zone_high QUALIFY row_number() OVER (PARTITION BY z, run ORDER BY bar_seq) = 1)"""},
)
O["j4_j5_j7_context"] = sql(
    f"SELECT {_columns('symbol formed_at zone_low~ bias bar_ts session atr~ dist_ema50_atr~ day_range_atr~ prior_day_range_atr~ gap_atr~ bars_since_zone~ htf_bias htf_bar_dir htf_slope_atr~ htf_dist_ema_atr~ htf_range_atr~ htf_bar_progress~ aligned aligned_bar')}, "
    "hour::INTEGER AS hour, minute::INTEGER AS minute, dow::INTEGER AS dow FROM known", "known",
)
O["j6_asof_join"] = sql("SELECT e.event_id, CAST(epoch(d.ts) AS BIGINT) AS ts, round(d.close, 6) AS close FROM events e ASOF LEFT JOIN det d ON d.symbol = e.event_type AND e.ts > d.ts", "det")
O["j8_event_window"] = sql(
    "SELECT e.symbol, round(entry, 6) AS entry, count(*) AS bars, CAST(epoch(min(s.ts)) AS BIGINT) AS first_ts, CAST(epoch(max(s.ts)) AS BIGINT) AS last_ts, round(sum(s.close), 6) AS closes "
    "FROM ev e JOIN seq s ON s.symbol = e.symbol AND s.bar_seq BETWEEN e.bar_seq - 12 AND e.bar_seq + 24 GROUP BY e.symbol, e.z, e.entry", "ev",
)
O["p1_filtered_events"] = sql(
    f"SELECT {EVENT} FROM ev", "ev",
    FILTERS="(session = 'RTH' OR hour IN (3, 4, 5)) AND 0.3 < zone_height_atr AND zone_height_atr <= 2 AND (aligned = 1 OR htf_bar_progress > 0.25)",
)
O["p2_p5_expressions"] = sql(
    """SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, CAST(epoch(formed_at) AS BIGINT) AS formed_at, round(zone_low, 6) AS zone_low,
      zone_height_atr * 2 >= 1.5 AND session <> 'ASIA' AS e0, floor(hour / 6) IN (1, 2) OR dow % 3 = 1 AS e1,
      -4 + (hour - -5 * floor(hour / -5.0)) < sqrt(minute) AS e2, test_number + 1 <= 2 AND hour > 2 AS e3,
      CASE WHEN hour <> 5 THEN atr / (hour - 5) > 0 OR hour >= 0 END AS e4, CASE WHEN hour > 12 THEN atr ELSE zone_height END > 30 AS e5,
      round_even(atr, 0) = trunc(atr) OR 1 > greatest(1, dow) AS e6, session IN ('RTH', 'LONDON') AND least(hour, 10) > 4 AS e7, dow <> 0 AS e8, CAST(NULL AS BOOLEAN) AS e9 FROM ev""",
    "ev", FILTERS="true",
)
O["p7_filter_outcome"] = sql(" UNION ALL ".join(f"SELECT '{w}' AS which, {EVENT} FROM ev WHERE {t}" for w, t in (("wins", "outcome = 'win'"), ("losses", "outcome = 'loss'"), ("ambiguous", "ambiguous"))), "ev")
O["e1_e2_e4_scan"] = sql(f"SELECT {EVENT} FROM ev", "ev")
_b = _block(1.2, 1, True, "least(c.open, c.close)", "greatest(c.open, c.close)")
O["e1_e2_scan_next_open"] = sql(f"SELECT {EVENT}, CAST(test_number AS INTEGER) AS test_number FROM ev", "ev", TESTS="retests", FILTERS="true", GOAL="1.5 * atr", HORIZON="60", LIMITED="false", STOP="entry - bias * atr").replace(
    "ctx AS (", f"""found AS ({_b['found']}), zones AS ({_b['zones']}), blocks AS (SELECT * EXCLUDE (tf, known, d), row_number() OVER (ORDER BY symbol, known) AS z FROM zones),
    hits AS (SELECT z.*, s.ts AS bar_ts, s.bar_seq, s.open, s.high, s.low, s.close, CASE WHEN bias = 1 THEN s.low <= zone_low ELSE s.high >= zone_high END AS hit
      FROM blocks z JOIN seq s ON s.symbol = z.symbol AND s.ts BETWEEN z.formed_at + INTERVAL 30 minute AND z.expires_at WHERE hit OR s.high >= zone_low AND s.low <= zone_high),
    visits AS (SELECT *, bar_seq - row_number() OVER (PARTITION BY z ORDER BY bar_seq) AS run FROM hits),
    retests AS (SELECT * EXCLUDE (run, hit), row_number() OVER (PARTITION BY z ORDER BY bar_seq) AS test_number FROM (SELECT * FROM visits WHERE hit QUALIFY row_number() OVER (PARTITION BY z, run ORDER BY bar_seq) = 1)),
    ctx AS (""").replace(  # fmt: skip
    "SELECT *, bar_seq AS i, CASE WHEN bias = 1 THEN zone_high ELSE zone_low END AS entry FROM known WHERE true",
    "SELECT k.*, s.bar_seq AS i, s.open AS entry FROM known k JOIN seq s ON s.symbol = k.symbol AND s.bar_seq = k.bar_seq + 1",
)
O["e3_rescore"] = sql(
    """SELECT symbol, 'fixed' AS lens, count(*) FILTER (outcome = 'win') AS wins, count(*) AS n FROM ev GROUP BY symbol
    UNION ALL SELECT symbol, 'atr', count(*) FILTER (mfe_r * risk_points / atr >= 2 AND mae_r * risk_points / atr < 1), count(*) FROM ev GROUP BY symbol
    UNION ALL SELECT symbol, 'mfe', count(*) FILTER (mfe_r > mae_r), count(*) FROM ev GROUP BY symbol""", "ev",
)
O["e5_scan_counts"] = sql(
    """SELECT symbol, n_zones, coalesce(n_tests_raw, 0) AS n_tests_raw, coalesce(n_filtered_out, 0) AS n_filtered_out, coalesce(n_events, 0) AS n_events, round(share, 6) AS ambiguous_share, coalesce(share > 0.15, false) AS warning
    FROM (SELECT symbol, count(*) AS n_zones FROM gaps GROUP BY symbol) LEFT JOIN (SELECT symbol, count(*) AS n_tests_raw FROM first GROUP BY symbol) USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) FILTER (NOT (zone_height_atr < 3 AND (hour >= 2 OR session <> 'ASIA'))) AS n_filtered_out FROM known GROUP BY symbol) USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) AS n_events, avg(ambiguous::INTEGER) AS share FROM ev GROUP BY symbol) USING (symbol)""", "ev",
)

_binom = """CASE WHEN n > 0 THEN (SELECT least(1, sum(p)) FROM (SELECT exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(P0) + (n - k) * ln(1 - P0)) AS p,
    exp(lgamma(n + 1) - lgamma(wins + 1) - lgamma(n - wins + 1) + wins * ln(P0) + (n - wins) * ln(1 - P0)) AS own FROM (SELECT unnest(range(0, n + 1)) AS k)) WHERE p <= own * (1 + 1e-7)) END"""
O["g1_g4_summary"] = sql(
    f"""SELECT n, wins, {_wilson('wins', 'n')}, round(mean_r, 6) AS mean_r, round(ambiguous, 6) AS ambiguous, round(median_bars, 6) AS median_bars, 0.3::DOUBLE AS baseline_rate,
    round(wins / n::DOUBLE - 0.3, 6) AS edge, round({_binom.replace('P0', '0.3::DOUBLE')}, 6) AS p_value, true AS mean_in_bounds
    FROM (SELECT count(*) AS n, count(*) FILTER (outcome = 'win') AS wins, avg(r_fixed) AS mean_r, avg(ambiguous::INTEGER) AS ambiguous, median(bars_held)::DOUBLE AS median_bars FROM ev)""", "ev",
)
_groups = " UNION ALL ".join(f"SELECT '{c}' AS \"by\", CAST({c} AS VARCHAR) AS value, outcome, r_fixed FROM ev" for c in ("session", "hour", "year", "aligned"))
O["g5_rate_by_group"] = sql(
    f"""SELECT "by", value, n, {_wilson('wins', 'n')}, round(mean_r, 6) AS mean_r, n >= 20 AS reliable FROM (SELECT "by", value, count(*) AS n, count(*) FILTER (outcome = 'win') AS wins, avg(r_fixed) AS mean_r FROM ({_groups}) GROUP BY ALL)""", "ev"
)
O["g6_excursion_quantiles"] = sql(
    """SELECT measure, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
    round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 0.9), 6) AS q90, round(max(x), 6) AS max
    FROM (SELECT 'mfe_r' AS measure, mfe_r::DOUBLE AS x FROM ev UNION ALL SELECT 'mae_r', mae_r FROM ev UNION ALL SELECT 'bars_held', bars_held FROM ev) GROUP BY measure""", "ev",
)
O["g7_excursion_histogram"] = sql(
    """SELECT measure, bin, round(a + bin * w, 6) AS low, round(a + (bin + 1) * w, 6) AS high, count(*) AS n FROM (SELECT *, CAST(CASE WHEN w > 0 THEN least(19, floor((x - a) / w)) ELSE 0 END AS INTEGER) AS bin
    FROM (SELECT *, min(x) OVER (PARTITION BY measure) AS a, (max(x) OVER (PARTITION BY measure) - min(x) OVER (PARTITION BY measure)) / 20 AS w
    FROM (SELECT 'mfe_r' AS measure, mfe_r AS x FROM ev UNION ALL SELECT 'mae_r', mae_r FROM ev))) GROUP BY measure, bin, a, w""", "ev",
)
O["g8_equity_curve"] = sql(
    "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(sum(sum(r_fixed)) OVER (PARTITION BY symbol ORDER BY ts), 6) AS equity, count(*) AS n FROM ev GROUP BY symbol, ts", "ev"
)
O["g9_split_events"] = sql(
    """SELECT symbol, part, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS first_ts, CAST(epoch(max(ts)) AS BIGINT) AS last_ts FROM (SELECT symbol, ts,
    CASE WHEN ts > TIMESTAMP '2024-01-18' THEN 'out_of_sample' WHEN ts >= TIMESTAMP '2024-01-03' THEN 'in_sample' END AS part FROM ev) WHERE part IS NOT NULL GROUP BY symbol, part""", "ev",
)
O["g10_split_bars"] = sql(
    """SELECT symbol, part, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS first_ts, split_date FROM (SELECT symbol, ts, CASE WHEN ts >= TIMESTAMP '2024-01-19' THEN 'holdout' WHEN ts >= TIMESTAMP '2024-01-03' THEN 'in_sample' END AS part FROM seq)
    JOIN (SELECT s.symbol, strftime(s.ts, '%Y-%m-%d') AS split_date FROM seq s JOIN (SELECT symbol, count(*) AS n FROM seq GROUP BY symbol) c ON c.symbol = s.symbol AND s.bar_seq = floor(n * 70 / 100)) USING (symbol)
    WHERE part IS NOT NULL GROUP BY symbol, part, split_date""", "seq",
)
_side = lambda p, a: f"SELECT n AS {a}_n, rate AS {a}_rate, ci_low AS {a}_ci_low, ci_high AS {a}_ci_high FROM (SELECT n, {_wilson('wins', 'n')} FROM (SELECT count(*) AS n, count(*) FILTER (outcome = 'win') AS wins FROM ev WHERE {p}))"
O["g11_compare_splits"] = sql(
    f"""SELECT *, round(oos_rate - is_rate, 6) AS rate_change, is_ci_low <= oos_ci_high AND oos_ci_low <= is_ci_high AS overlap FROM ({_side("ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-18'", 'is')}) CROSS JOIN ({_side("ts > TIMESTAMP '2024-01-18'", 'oos')})""", "ev"
)
_u = lambda key: f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_CONTROL = {
    "span": "SELECT symbol, min(bar_seq) AS lo, least(max(bar_seq), (SELECT count(*) FROM base b WHERE b.symbol = ev.symbol) - 242) AS hi, median(risk_points) AS risk, median(atr) AS atr, avg(CASE WHEN bias = 1 THEN 1 ELSE 0 END) AS longs FROM ev GROUP BY symbol",
    "drawn": f"""SELECT *, 'd' || k AS id, lo + floor({_u("'drift place 0|' || symbol || '|' || k")} * (hi - lo)) AS spot, CASE WHEN {_u("'drift side 0|' || symbol || '|' || k")} < longs THEN 1 ELSE -1 END AS side
      FROM (SELECT *, unnest(range(0, 3000)) AS k FROM span WHERE hi > lo)""",
    "moved": f"""SELECT symbol, bias, atr, z, formed_at, zone_low + shift AS zl, zone_high + shift AS zh FROM (SELECT *, (0.5 + {_u("'placebo size 0|' || eid")} * 2.5) * atr * CASE WHEN {_u("'placebo side 0|' || eid")} < 0.5 THEN -1 ELSE 1 END AS shift
      FROM (SELECT *, substr(md5(symbol || '|' || epoch_us(formed_at) || '|' || epoch_us(source_ts) || '|' || printf('%.9f', zone_low) || '|' || bias), 1, 16) || '-' || test_number AS eid FROM ev))""",
    "begun": "SELECT m.*, s.bar_seq AS a FROM moved m ASOF JOIN seq s ON s.symbol = m.symbol AND m.formed_at <= s.ts WHERE s.bar_seq < (SELECT count(*) FROM base b WHERE b.symbol = m.symbol) - 2",
    "entered": """SELECT b.symbol, b.z, b.bias, b.atr, zl, zh, min(s.bar_seq) AS spot FROM begun b JOIN (SELECT *, lag(low) OVER w AS l1, lag(high) OVER w AS h1 FROM seq WINDOW w AS (PARTITION BY symbol ORDER BY bar_seq)) s
      ON s.symbol = b.symbol AND s.bar_seq > a AND s.bar_seq < a + 2000 AND s.high >= zl AND s.low <= zh AND CASE WHEN b.bias = 1 THEN l1 > zh ELSE h1 < zl END GROUP BY ALL""",
    "sides": """SELECT 'drift' AS kind, d.symbol, id, spot, side AS bias, s.open AS entry, CASE WHEN side = 1 THEN s.open - d.risk ELSE s.open + d.risk END AS stop
      FROM drawn d JOIN seq s ON s.symbol = d.symbol AND s.bar_seq = spot
      UNION ALL SELECT 'placebo', symbol, CAST(z AS VARCHAR), spot, bias, CASE WHEN bias = 1 THEN zh ELSE zl END, CASE WHEN bias = 1 THEN zl ELSE zh END FROM entered""",
    "control": "SELECT *, entry + bias * 2.0::DOUBLE * ((entry - stop) * bias) AS target FROM sides WHERE (entry - stop) * bias > 0",
    "steps": """SELECT c.*, s.bar_seq, CASE WHEN bias = 1 THEN s.low <= stop ELSE s.high >= stop END AS bad,
      CASE WHEN bias = 1 THEN CASE WHEN s.bar_seq = spot THEN greatest(entry, s.close) ELSE s.high END >= target
        ELSE CASE WHEN s.bar_seq = spot THEN least(entry, s.close) ELSE s.low END <= target END AS good
      FROM control c JOIN seq s ON s.symbol = c.symbol AND s.bar_seq >= spot AND s.bar_seq < spot + 240""",
    "done": "SELECT kind, symbol, id, coalesce(min(bar_seq) FILTER (good), 1e18) < coalesce(min(bar_seq) FILTER (bad), 1e18) AS win FROM steps GROUP BY kind, symbol, id",
    "rates": "SELECT kind, symbol, count(*) AS n, count(*) FILTER (win) AS wins FROM done GROUP BY kind, symbol",
}
for _name, _kind in (("c1_drift_baseline", "drift"), ("c2_placebo_baseline", "placebo")):
    O[_name] = sql(f"SELECT symbol, n, wins, {_wilson('wins', 'n')} FROM rates WHERE kind = '{_kind}'", "ev", _CONTROL)
O["g2_g12_baseline_table"] = sql(
    f"""SELECT control, round(rate, 6) AS rate, bn AS n, round(edge, 6) AS edge, round(p_value, 6) AS p_value, CASE WHEN bool_or(edge <= 0 OR p_value > 0.05) OVER () THEN 'no edge' ELSE 'edge' END AS verdict
    FROM (SELECT control, rate, bn, wins / n::DOUBLE - rate AS edge, {_binom.replace('P0', 'rate')} AS p_value FROM (SELECT kind AS control, sum(wins) / sum(n)::DOUBLE AS rate, CAST(sum(n) AS BIGINT) AS bn FROM rates GROUP BY kind)
    CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (outcome = 'win') AS wins FROM ev))""", "ev", _CONTROL,
)
O["s1_s5_csv_bars"] = sql(f"SELECT {BARS} FROM base", "base")
O["s6_s7_symbol_folder"] = sql(f"SELECT {BARS} FROM base", "base")
O["s4_localize"] = sql(
    """SELECT symbol, CAST(epoch(t) AS BIGINT) AS ts,
      CASE WHEN t >= TIMESTAMP '2024-11-03 05:00' AND t < TIMESTAMP '2024-11-03 07:00' THEN NULL ELSE CAST(epoch(t) AS BIGINT) END AS there_and_back,
      CAST(epoch(CASE WHEN t < TIMESTAMP '2024-03-10 02:00' THEN t + INTERVAL 5 hour WHEN t < TIMESTAMP '2024-03-10 03:00' THEN TIMESTAMP '2024-03-10 07:00'
        WHEN t < TIMESTAMP '2024-11-03 01:00' THEN t + INTERVAL 4 hour WHEN t >= TIMESTAMP '2024-11-03 02:00' THEN t + INTERVAL 5 hour END) AS BIGINT) AS as_clock
    FROM (SELECT symbol, ts + to_days(unnest([0, 60, 298])) AS t FROM base)""", "base",
)
O["s8_bars_parquet"] = sql(f"SELECT {BARS} FROM base WHERE symbol IN ('click', 'purchase')", "base")
O["s8_incremental_load"] = O["s1_s5_csv_bars"]
O["s9_dataset_fingerprint"] = sql(
    """SELECT symbol, substr(sha1(n || '|' || strftime(a, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || strftime(b, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || printf('%.6f', x) || '|' || printf('%.6f', y)), 1, 12) AS data_fingerprint
    FROM (SELECT symbol, count(*) AS n, min(ts) AS a, max(ts) AS b, arg_min(close, ts) AS x, arg_max(close, ts) AS y FROM base GROUP BY symbol)""", "base",
)
O["s10_events_parquet"] = O["s10_events_csv"] = O["e1_e2_e4_scan"]
O["r1_r6_registry"] = sql(
    """SELECT 2::BIGINT AS studies, count(*) AS n_events, round(count(*) FILTER (outcome = 'win') / count(*)::DOUBLE, 6) AS rate, 2::BIGINT AS trials, 2::BIGINT AS distinct_trials,
    round(sqrt(2 * ln(2)), 6) AS deflated_threshold, 1::BIGINT AS looks, 'warning' AS level, 'a' AS name, 'all|fvg|both' AS family, count(*) AS events_kept, round(sum(r_fixed), 6) AS r_kept FROM ev""", "ev",
)
