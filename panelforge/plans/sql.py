"""DuckDB statements that say independently what the queries return.

Each WITH_... begins a statement with the tables up to it, each of which is made once. The values of the rules stand here
again, so that a wrong one in the engine shows.
"""

from __future__ import annotations

from panelforge.operators import extras

from .adapter import THEMES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"CAST('{x!r}' AS DOUBLE)"
        return quoted(x) if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


THEME_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in THEMES.items()) + " ELSE c_mktsegment END"

WITH_PANEL = """WITH owners AS (
    SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lines AS (
    SELECT n_name, r_name, CAST(l_shipdate AS DATE) AS session_date, l_extendedprice / l_quantity AS q FROM lineitem JOIN owners ON l_suppkey = s_suppkey),
panel AS MATERIALIZED (
    SELECT n_name AS symbol, session_date, avg(q) AS p FROM lines GROUP BY n_name, session_date
    UNION ALL SELECT r_name, session_date, avg(q) FROM lines WHERE r_name <> 'MIDDLE EAST' GROUP BY r_name, session_date
    UNION ALL SELECT 'MKT', session_date, avg(q) FROM lines GROUP BY session_date),
cal AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS ord FROM panel WHERE symbol = 'MKT')
"""
WITH_RETURNS = WITH_PANEL + """, rets AS (SELECT *, p / nullif(lag(p) OVER (PARTITION BY symbol ORDER BY session_date), 0) - 1 AS ret FROM panel)
"""
WITH_BETAS = WITH_RETURNS + """, joint AS (
    SELECT a.symbol, a.session_date, a.ret, m.ret AS mret FROM rets a JOIN rets m ON m.symbol = 'MKT' AND m.session_date = a.session_date
    WHERE a.symbol <> 'MKT' AND a.ret IS NOT NULL AND m.ret IS NOT NULL),
betas AS MATERIALIZED (
    SELECT symbol, session_date, count(*) OVER w AS n_joint,
        CASE WHEN count(*) OVER w >= 30 AND var_samp(mret) OVER w > 0 THEN covar_samp(ret, mret) OVER w / var_samp(mret) OVER w END AS beta
    FROM joint WINDOW w AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))
"""
WITH_SIGNALS = WITH_BETAS + f""", nations AS (
    SELECT n_nationkey, n_name AS ticker, CASE WHEN r_name <> 'MIDDLE EAST' THEN r_name END AS sector_proxy FROM nation JOIN region ON n_regionkey = r_regionkey),
signals AS MATERIALIZED (
    SELECT o_orderkey AS id, ticker, sector_proxy, o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS created_day,
        CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 3 WHEN '3' THEN 5 WHEN '4' THEN 20 ELSE 60 END AS INTEGER) AS horizon_days,
        CASE o_orderstatus WHEN 'P' THEN 'positive' WHEN 'F' THEN 'negative' ELSE 'neutral' END AS sentiment,
        CAST(o_orderkey % 101 AS DOUBLE) AS setup_score, CAST(o_orderkey * 7 % 101 AS DOUBLE) AS rsi, o_totalprice > 250000 AS volume, {THEME_CASE} AS theme
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nations ON c_nationkey = n_nationkey)
"""
WITH_KEYS = WITH_SIGNALS + """, before AS (
    SELECT created_day, (SELECT count(*) FROM cal WHERE session_date <= created_day) AS n_le FROM (SELECT DISTINCT created_day FROM signals)),
ends AS (
    SELECT created_day, horizon_days, session_date AS end_day FROM before CROSS JOIN (VALUES (1), (3), (5), (20), (60)) h(horizon_days) LEFT JOIN cal ON ord = n_le + horizon_days),
allkeys AS (SELECT ticker, sector_proxy, created_day, horizon_days, end_day FROM nations CROSS JOIN ends),
wanted AS (SELECT DISTINCT ticker, created_day, horizon_days FROM signals),
keys AS (SELECT allkeys.* FROM allkeys SEMI JOIN wanted USING (ticker, created_day, horizon_days))
"""
ASOF_AFTER = """SELECT DISTINCT k.ticker, k.created_day, round(p.p, 6) AS price FROM keys k ASOF LEFT JOIN panel p ON k.ticker = p.symbol AND k.created_day <= p.session_date"""
ASOF_BEFORE = """SELECT DISTINCT k.ticker, k.end_day, round(p.p, 6) AS price FROM keys k ASOF LEFT JOIN panel p ON k.ticker = p.symbol AND k.end_day >= p.session_date"""
LEGS = """, who AS (SELECT DISTINCT symbol FROM panel),
starts AS (
    SELECT q.symbol, q.day, p.p FROM (SELECT symbol, created_day AS day FROM who CROSS JOIN before) q ASOF LEFT JOIN panel p ON q.symbol = p.symbol AND q.day <= p.session_date),
finals AS (
    SELECT q.symbol, q.day, p.p FROM (SELECT symbol, day FROM who CROSS JOIN (SELECT DISTINCT end_day AS day FROM ends WHERE end_day IS NOT NULL)) q
    ASOF LEFT JOIN panel p ON q.symbol = p.symbol AND q.day >= p.session_date),
moves AS MATERIALIZED (
    SELECT w.symbol, e.created_day, e.horizon_days, f.p / nullif(s.p, 0) - 1 AS r
    FROM who w CROSS JOIN ends e LEFT JOIN starts s ON s.symbol = w.symbol AND s.day = e.created_day LEFT JOIN finals f ON f.symbol = w.symbol AND f.day = e.end_day)
"""
RAW_RETURN = LEGS + "SELECT k.ticker, k.created_day, k.horizon_days, round(r, 6) AS raw_return FROM keys k LEFT JOIN moves m ON m.symbol = k.ticker AND m.created_day = k.created_day AND m.horizon_days = k.horizon_days"
PEERS = LEGS + "SELECT k.sector_proxy, k.created_day, k.horizon_days, round(avg(r), 6) AS peer_reaction FROM keys k LEFT JOIN moves m ON m.symbol = k.ticker AND m.created_day = k.created_day AND m.horizon_days = k.horizon_days GROUP BY ALL"
WITH_RECORDS = WITH_KEYS + LEGS + """, estimates AS (
    SELECT q.symbol, q.created_day, b.beta FROM (SELECT symbol, created_day FROM who CROSS JOIN before) q ASOF LEFT JOIN betas b ON q.symbol = b.symbol AND q.created_day > b.session_date),
found AS (
    SELECT k.*, t.r AS raw_return, m.r AS market_return, s.r AS sector, b.beta AS estimate
    FROM allkeys k LEFT JOIN moves t ON t.symbol = k.ticker AND t.created_day = k.created_day AND t.horizon_days = k.horizon_days
    LEFT JOIN moves m ON m.symbol = 'MKT' AND m.created_day = k.created_day AND m.horizon_days = k.horizon_days
    LEFT JOIN moves s ON s.symbol = k.sector_proxy AND s.created_day = k.created_day AND s.horizon_days = k.horizon_days
    LEFT JOIN estimates b ON b.symbol = k.ticker AND b.created_day = k.created_day),
judged AS (
    SELECT *, raw_return IS NOT NULL AND market_return IS NOT NULL AS good FROM found),
rec AS (
    SELECT *, CASE WHEN good THEN coalesce(estimate, 1.0) END AS beta, good AND estimate IS NULL AS beta_fallback_used, CASE WHEN good THEN sector END AS sector_return FROM judged),
records AS MATERIALIZED (
    SELECT *, raw_return - beta * market_return AS beta_adjusted_abnormal_return, raw_return - sector_return AS sector_adjusted_abnormal_return,
        CASE WHEN sector_return IS NULL THEN raw_return - beta * market_return ELSE raw_return - 0.5 * beta * market_return - 0.5 * sector_return END AS combined_abnormal_return,
        CASE WHEN raw_return IS NULL THEN 'insufficient_price_history' WHEN market_return IS NULL THEN 'missing_benchmark_data'
            WHEN beta_fallback_used AND sector_proxy IS NOT NULL AND sector_return IS NULL THEN 'beta_fallback_used,missing_sector_proxy'
            WHEN beta_fallback_used THEN 'beta_fallback_used' WHEN sector_proxy IS NOT NULL AND sector_return IS NULL THEN 'missing_sector_proxy' ELSE 'ok' END AS data_quality_flag
    FROM rec)
"""
RECORDS = """SELECT ticker, sector_proxy, created_day, horizon_days, round(raw_return, 6) AS raw_return, round(market_return, 6) AS market_return, round(beta, 6) AS beta, beta_fallback_used,
    round(beta_adjusted_abnormal_return, 6) AS beta_adjusted_abnormal_return, round(sector_return, 6) AS sector_return, round(sector_adjusted_abnormal_return, 6) AS sector_adjusted_abnormal_return,
    round(combined_abnormal_return, 6) AS combined_abnormal_return, data_quality_flag
FROM records SEMI JOIN wanted USING (ticker, created_day, horizon_days)"""
RUNS = """, runs AS (
    SELECT k.ticker, k.created_day, k.horizon_days, min(p) / nullif(arg_min(p, session_date), 0) - 1 AS max_drawdown, max(p) / nullif(arg_min(p, session_date), 0) - 1 AS max_runup
    FROM keys k JOIN panel ON symbol = k.ticker AND session_date BETWEEN k.created_day AND k.end_day GROUP BY ALL)
"""
DRAWDOWN = RUNS + """SELECT k.ticker, k.created_day, k.horizon_days, round(max_drawdown, 6) AS max_drawdown, round(max_runup, 6) AS max_runup
FROM keys k LEFT JOIN runs r ON r.ticker = k.ticker AND r.created_day = k.created_day AND r.horizon_days = k.horizon_days"""
WITH_EVENTS = WITH_RECORDS + """, reactions AS (
    SELECT s.*, r.combined_abnormal_return AS event_ar,
        CASE WHEN r.combined_abnormal_return IS NULL THEN 'Inconclusive' WHEN sentiment = 'neutral' THEN 'Inconclusive'
            WHEN abs(r.combined_abnormal_return) < 0.01 THEN 'No Meaningful Abnormal Reaction'
            WHEN sentiment = 'positive' THEN CASE WHEN r.combined_abnormal_return > 0 THEN 'Positive Abnormal Reaction' ELSE 'Sell the News' END
            ELSE CASE WHEN r.combined_abnormal_return >= 0 THEN 'Bad News Absorbed' ELSE 'Negative Abnormal Reaction' END END AS label
    FROM signals s LEFT JOIN records r ON r.ticker = s.ticker AND r.created_day = s.created_day AND r.horizon_days = 1),
classes AS (
    SELECT *, setup_score + CASE WHEN volume THEN 8 ELSE 0 END AS score,
        CASE WHEN label = 'Positive Abnormal Reaction' AND rsi >= 75 THEN 'Avoid Chase' WHEN label IN ('Sell the News', 'Negative Abnormal Reaction') THEN 'Avoid'
            WHEN label = 'Bad News Absorbed' THEN 'Watch' WHEN label IN ('Inconclusive', 'No Meaningful Abnormal Reaction') THEN CASE WHEN sentiment = 'positive' THEN 'Wait for Confirmation' ELSE 'Avoid' END
            WHEN setup_score + CASE WHEN volume THEN 8 ELSE 0 END >= 70 THEN 'Tradeable' ELSE 'Watch' END AS classification
    FROM reactions)
"""
SNAPSHOTS = """SELECT id, c.ticker, created_at, horizon_days, classification, score, theme, 'MKT' AS benchmark, coalesce(sector_proxy, '') AS sector_proxy, round(p.p, 6) AS price_at_creation, 'rules.v1' AS rule_version
FROM classes c LEFT JOIN panel p ON p.symbol = c.ticker AND p.session_date = c.created_day"""
WITH_OUTCOMES = WITH_EVENTS + RUNS + """, joined AS (
    SELECT c.*, r.end_day AS horizon_end, r.raw_return, r.beta_fallback_used AS fallback, r.combined_abnormal_return AS ar, r.data_quality_flag AS quality, d.max_drawdown AS dd, d.max_runup AS ru,
        CASE WHEN c.ticker NOT IN (SELECT symbol FROM panel) THEN 'missing_prices' WHEN r.end_day IS NULL THEN 'insufficient_calendar' ELSE 'matured' END AS status
    FROM classes c LEFT JOIN records r ON r.ticker = c.ticker AND r.created_day = c.created_day AND r.horizon_days = c.horizon_days
    LEFT JOIN runs d ON d.ticker = c.ticker AND d.created_day = c.created_day AND d.horizon_days = c.horizon_days),
mature AS (
    SELECT *, status = 'matured' AS is_matured, CASE WHEN status = 'matured' THEN ar END AS far, CASE WHEN status = 'matured' THEN raw_return END AS forward_return,
        CASE WHEN status = 'matured' THEN dd END AS max_drawdown, CASE WHEN status = 'matured' THEN ru END AS max_runup,
        CASE WHEN status = 'matured' THEN quality END AS data_quality_flag, CASE WHEN status = 'matured' THEN fallback END AS beta_fallback_used
    FROM joined),
outcomes AS (
    SELECT *, CASE WHEN far IS NOT NULL AND classification = 'Tradeable' THEN far > 0 END AS trade_hit,
        CASE WHEN far IS NOT NULL AND classification IN ('Watch', 'Wait for Confirmation') THEN far > 0 END AS watch_followthrough,
        CASE WHEN far IS NOT NULL AND classification IN ('Avoid', 'Avoid Chase') THEN far <= 0 END AS avoided_bad_trade,
        CASE WHEN far IS NULL THEN NULL WHEN classification IN ('Avoid', 'Avoid Chase') THEN far > 0.02 ELSE false END AS false_negative
    FROM mature)
"""
AS_OF = """SELECT CASE WHEN ticker NOT IN (SELECT symbol FROM panel) THEN 'missing_prices' WHEN horizon_end IS NULL THEN 'insufficient_calendar' WHEN horizon_end <= DATE '1998-06-30' THEN 'matured' ELSE 'pending' END AS status,
    count(*) AS n FROM outcomes GROUP BY ALL"""
PROVENANCE = """SELECT id, CASE WHEN s.symbol IS NULL THEN 'bundle' ELSE 'lines' END AS price_source, CASE WHEN s.symbol IS NULL THEN 'none' ELSE 'average' END AS price_adjustment,
    strftime(s.a, '%Y-%m-%dT00:00:00') AS price_actual_start, strftime(s.b, '%Y-%m-%dT00:00:00') AS price_actual_end,
    concat_ws(',', CASE WHEN s.symbol IS NOT NULL THEN 'sampled' END, CASE WHEN data_quality_flag <> 'ok' THEN data_quality_flag END) AS flags
FROM outcomes LEFT JOIN (SELECT symbol, min(session_date) AS a, max(session_date) AS b FROM panel WHERE symbol <> 'FRANCE' GROUP BY symbol) s ON s.symbol = ticker"""
WITH_COHORT = WITH_OUTCOMES + """, cohort AS (
    SELECT r.ticker, CAST(r.created_day AS TIMESTAMP) AS created_at, r.created_day, r.horizon_days, r.combined_abnormal_return AS far
    FROM records r SEMI JOIN (SELECT DISTINCT created_day, horizon_days FROM signals) d ON d.created_day = r.created_day AND d.horizon_days = r.horizon_days
    SEMI JOIN (SELECT DISTINCT symbol FROM panel) t ON t.symbol = r.ticker WHERE r.end_day IS NOT NULL)
"""
WITH_GROUPS = WITH_COHORT + """, good AS (SELECT * FROM outcomes WHERE is_matured AND far IS NOT NULL),
base AS (
    SELECT g.horizon_days, g.classification, avg(CASE WHEN c.far > 0 THEN 1.0 ELSE 0.0 END) AS base_rate
    FROM (SELECT DISTINCT horizon_days, classification, created_day FROM good) g JOIN cohort c ON c.horizon_days = g.horizon_days AND c.created_day = g.created_day
    WHERE c.far IS NOT NULL GROUP BY ALL),
groups AS (
    SELECT horizon_days, classification, count(*) AS sample_size, avg(CAST(far > 0 AS INTEGER)) AS sample_positive_rate, avg(CAST(trade_hit AS INTEGER)) AS trade_hit_rate,
        avg(CAST(watch_followthrough AS INTEGER)) AS watch_followthrough_rate, avg(CAST(avoided_bad_trade AS INTEGER)) AS avoided_bad_trade_rate,
        count(*) FILTER (WHERE false_negative) AS false_negatives, avg(far) AS average_far
    FROM good GROUP BY ALL),
rated AS (SELECT g.*, base_rate, trade_hit_rate - base_rate AS excess FROM groups g LEFT JOIN base b ON b.horizon_days = g.horizon_days AND b.classification = g.classification)
"""
GROUPS = """SELECT horizon_days, classification, sample_size, round(sample_positive_rate, 6) AS sample_positive_rate, round(base_rate, 6) AS base_rate, round(trade_hit_rate, 6) AS trade_hit_rate,
    round(excess, 6) AS excess_trade_hit_rate, round(watch_followthrough_rate, 6) AS watch_followthrough_rate, round(avoided_bad_trade_rate, 6) AS avoided_bad_trade_rate, false_negatives,
    round(average_far, 6) AS average_forward_abnormal_return FROM rated"""
CHART = """SELECT horizon_days, classification, round(excess * 100, 6) AS excess_hit_rate_pct, printf('%.1f', round_even(trade_hit_rate * 100, 1)) || '%' AS label FROM rated WHERE excess IS NOT NULL"""
FIRST_GROUP = """SELECT horizon_days, round(avoided_bad_trade_rate, 6) AS avoided_bad_trade_rate FROM rated WHERE classification = 'Avoid Chase' ORDER BY horizon_days LIMIT 1"""
SUMMARY = """SELECT count(*) AS sample_size, round(avg(CAST(far > 0 AS INTEGER)), 6) AS sample_positive_rate, round(avg(far), 6) AS average_forward_abnormal_return, round(median(far), 6) AS median_forward_abnormal_return,
    count(*) FILTER (WHERE classification = 'Tradeable' AND NOT trade_hit) AS false_positives, count(*) FILTER (WHERE false_negative) AS false_negatives,
    count(*) FILTER (WHERE classification = 'Avoid Chase') AS avoid_chase_count FROM outcomes WHERE is_matured AND far IS NOT NULL"""
VALIDATION = """, own AS (SELECT *, coalesce(trade_hit, false) AS h FROM outcomes),
bases AS (SELECT horizon_days, theme, avg(CASE WHEN far > 0 THEN 1.0 ELSE 0.0 END) AS base_rate FROM own WHERE is_matured GROUP BY ALL)
SELECT o.horizon_days, o.theme, o.ticker, count(*) AS signal_count, count(*) FILTER (WHERE is_matured) AS matured_count,
    round(count(*) FILTER (WHERE is_matured AND h) / nullif(count(*) FILTER (WHERE is_matured), 0), 6) AS hit_rate, round(avg(far), 6) AS avg_forward_abnormal_return,
    round(median(far), 6) AS median_forward_abnormal_return, round(avg(max_drawdown), 6) AS avg_max_drawdown,
    round(count(*) FILTER (WHERE is_matured AND classification IN ('Tradeable', 'Watch') AND trade_hit = false) / nullif(count(*) FILTER (WHERE is_matured AND classification IN ('Tradeable', 'Watch')), 0), 6) AS false_positive_rate,
    round(count(*) FILTER (WHERE is_matured AND classification IN ('Avoid', 'Avoid Chase') AND false_negative) / nullif(count(*) FILTER (WHERE is_matured AND classification IN ('Avoid', 'Avoid Chase')), 0), 6) AS false_negative_rate,
    round(any_value(base_rate), 6) AS base_rate, round(count(*) FILTER (WHERE is_matured AND h) / nullif(count(*) FILTER (WHERE is_matured), 0) - any_value(base_rate), 6) AS excess_hit_rate
FROM own o LEFT JOIN bases b ON b.horizon_days = o.horizon_days AND b.theme = o.theme GROUP BY o.horizon_days, o.theme, o.ticker"""
HIT_RATE = """SELECT coalesce(classification, 'all') AS classification, round(count(*) FILTER (WHERE trade_hit) / count(*), 6) AS hit_rate FROM outcomes WHERE is_matured GROUP BY ROLLUP (classification)"""
FLAGGED = """SELECT coalesce(string_agg(DISTINCT ticker, ', ' ORDER BY ticker) FILTER (WHERE beta_fallback_used), '') AS flagged FROM outcomes"""
PROXIES = "SELECT id, theme, CASE " + " ".join(f"WHEN contains(lower(theme), '{k}') THEN '{v}'" for k, v in {"ai infrastructure": "SMH", "semiconductor": "SMH", "airlines": "JETS", "travel rebound": "JETS", "energy": "XLE", "consumer cyclical": "XLY", "utilities": "XLU", "power": "XLU", "enterprise software": "IGV", "cybersecurity": "HACK"}.items()) + " END AS proxy FROM signals"

COVERAGE = """SELECT w.position, w.symbol, min(session_date) AS actual_start, max(session_date) AS actual_end
FROM (VALUES (0, 'FRANCE'), (1, 'GERMANY'), (2, 'MKT'), (3, 'NOWHERE')) w(position, symbol) LEFT JOIN panel p ON p.symbol = w.symbol GROUP BY ALL"""
MISSING = """SELECT * FROM (VALUES (0, 'NOWHERE'), (1, 'FRANCE'), (2, 'ATLANTIS'), (3, 'MKT')) w(position, symbol) WHERE symbol NOT IN (SELECT symbol FROM panel)"""
REQUIRED = """SELECT * FROM (VALUES ('FRANCE'), ('ATLANTIS')) w(symbol) WHERE symbol NOT IN (SELECT symbol FROM panel)"""
NORMALISE = """SELECT upper(event_type) AS symbol, d AS session_date, arg_max(value, event_id) AS adjusted_close FROM (
    SELECT *, CASE event_id % 5 WHEN 1 THEN CAST(ts AS DATE) + 1 WHEN 4 THEN NULL ELSE CAST(ts AS DATE) END AS d FROM events
    WHERE value IS NOT NULL AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0)
WHERE d IS NOT NULL GROUP BY ALL"""
TRAILING = """SELECT symbol, round(p0, 6) AS latest, round(p0 / nullif(p5, 0) - 1, 6) AS return_5d, round(p0 / nullif(p20, 0) - 1, 6) AS return_20d, round(p0 / nullif(p60, 0) - 1, 6) AS return_60d, round(p0 / nullif(high, 0) - 1, 6) AS distance_from_high
FROM (SELECT symbol, max(p) FILTER (WHERE n = 1) AS p0, max(p) FILTER (WHERE n = 6) AS p5, max(p) FILTER (WHERE n = 21) AS p20, max(p) FILTER (WHERE n = 61) AS p60, max(p) AS high
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS n FROM panel) GROUP BY symbol)"""
MARKET = "SELECT w.symbol, t.* EXCLUDE (symbol), t.symbol IS NOT NULL AS available FROM (VALUES ('MKT'), ('FRANCE'), ('NOWHERE')) w(symbol) LEFT JOIN (" + TRAILING + ") t ON t.symbol = w.symbol"
METHOD = """SELECT ticker, created_day, horizon_days, CASE WHEN raw_return IS NULL OR market_return IS NULL THEN 'unavailable' WHEN sector_return IS NOT NULL THEN 'beta_and_sector_adjusted' ELSE 'beta_adjusted_spy_only' END AS calculation_method
FROM records SEMI JOIN wanted USING (ticker, created_day, horizon_days)"""
WITH_CALENDAR = WITH_KEYS + LEGS + """, estimates AS (
    SELECT q.symbol, q.created_day, b.beta FROM (SELECT symbol, created_day FROM who CROSS JOIN before) q ASOF LEFT JOIN betas b ON q.symbol = b.symbol AND q.created_day > b.session_date),
cdays AS (SELECT created_day, h, created_day + CAST(h AS INTEGER) AS end_day FROM before CROSS JOIN (VALUES (1), (3), (5), (20)) t(h)),
cends AS (SELECT q.symbol, q.end_day, p.p FROM (SELECT symbol, end_day FROM who CROSS JOIN (SELECT DISTINCT end_day FROM cdays)) q ASOF LEFT JOIN panel p ON q.symbol = p.symbol AND q.end_day >= p.session_date),
cmoves AS MATERIALIZED (SELECT s.symbol, c.created_day, c.h, f.p / nullif(s.p, 0) - 1 AS r FROM starts s JOIN cdays c ON c.created_day = s.day JOIN cends f ON f.symbol = s.symbol AND f.end_day = c.end_day),
calendar AS (
    SELECT k.ticker, k.created_day, c.h, t.r AS raw, m.r AS market, CASE WHEN t.r IS NOT NULL AND m.r IS NOT NULL THEN s.r END AS sector, coalesce(b.beta, 1.0) AS beta
    FROM (SELECT DISTINCT ticker, sector_proxy, created_day FROM signals) k JOIN cdays c ON c.created_day = k.created_day
    LEFT JOIN cmoves t ON t.symbol = k.ticker AND t.created_day = k.created_day AND t.h = c.h LEFT JOIN cmoves m ON m.symbol = 'MKT' AND m.created_day = k.created_day AND m.h = c.h
    LEFT JOIN cmoves s ON s.symbol = k.sector_proxy AND s.created_day = k.created_day AND s.h = c.h LEFT JOIN estimates b ON b.symbol = k.ticker AND b.created_day = k.created_day),
studied AS (
    SELECT *, CASE WHEN sector IS NULL THEN raw - beta * market ELSE raw - 0.5 * beta * market - 0.5 * sector END AS ar,
        CASE WHEN raw IS NULL OR market IS NULL THEN 'unavailable' WHEN sector IS NOT NULL THEN 'beta_and_sector_adjusted' ELSE 'beta_adjusted_spy_only' END AS method FROM calendar)
"""
CALENDAR_HORIZONS = """SELECT ticker, created_day, h AS horizon_days, round(raw, 6) AS raw_return, round(raw - market, 6) AS market_adjusted_return, round(raw - beta * market, 6) AS beta_adjusted_abnormal_return,
    round(raw - sector, 6) AS sector_adjusted_abnormal_return, round(ar, 6) AS combined_abnormal_return, method AS calculation_method FROM studied WHERE h IN (1, 3)"""
WIDE_FORWARD = "SELECT ticker, created_day, " + ", ".join(f"round(max({c}) FILTER (WHERE h = {h}), 6) AS forward_{h}d_{name}" for name, c in (("return", "raw"), ("abnormal_return", "ar")) for h in (1, 3, 5, 20)) + " FROM studied GROUP BY ticker, created_day"
VOLUME = """WITH daily AS (SELECT n_name AS symbol, CAST(l_shipdate AS DATE) AS session_date, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT symbol, session_date, round(avg(v) OVER (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) / nullif(avg(v) OVER (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 6) AS volume_reaction FROM daily"""

REACTION_TABLE = "SELECT *, CASE WHEN ar IS NULL OR NOT present THEN 'Inconclusive' WHEN s = 'neutral' AND NOT basket THEN 'Inconclusive' WHEN NOT isnan(ar) AND abs(ar) < 0.01 THEN 'No Meaningful Abnormal Reaction' WHEN s = 'positive' AND ar > 0 AND NOT isnan(ar) THEN 'Positive Abnormal Reaction' WHEN s = 'positive' AND ar < 0 THEN 'Sell the News' WHEN s = 'negative' AND ar >= 0 AND NOT isnan(ar) THEN 'Bad News Absorbed' WHEN s = 'negative' AND ar < 0 THEN 'Negative Abnormal Reaction' WHEN ar > 0 AND NOT isnan(ar) THEN 'Positive Abnormal Reaction' ELSE 'Negative Abnormal Reaction' END AS label FROM (SELECT *, CASE WHEN lower(trim(news)) IN ('positive', 'bullish', 'good', 'upbeat') THEN 'positive' WHEN lower(trim(news)) IN ('negative', 'bearish', 'bad', 'downbeat') THEN 'negative' ELSE 'neutral' END AS s FROM " + values(extras.REACTION_ROWS, "news, ar, present, granularity, basket") + ")"
REACTION_TABLE = (
    "SELECT news, ar, present, granularity, basket, label, CASE WHEN ar IS NULL OR NOT present THEN 'Do not make a strong causal claim.' WHEN granularity = 'daily' THEN 'Daily-only evidence; use as association, not proof of intraday causality.' "
    "ELSE 'Timestamped event evidence; still validate with forward tracking.' END AS causal_claim, CASE WHEN ar IS NULL OR NOT present THEN 'Missing abnormal return or event timestamp.' WHEN label = 'Inconclusive' THEN 'Neutral or unknown catalyst without explicit basket/theme evidence.' "
    "WHEN label = 'No Meaningful Abnormal Reaction' THEN 'Abnormal return did not clear the materiality threshold.' WHEN s = 'positive' AND label = 'Positive Abnormal Reaction' THEN 'Positive catalyst aligned with positive abnormal return.' "
    "WHEN label = 'Sell the News' THEN 'Positive catalyst was met with negative abnormal return.' WHEN label = 'Bad News Absorbed' THEN 'Negative catalyst was absorbed without negative abnormal return.' WHEN s = 'negative' AND NOT isnan(ar) THEN 'Negative catalyst aligned with negative abnormal return.' "
    "WHEN label = 'Positive Abnormal Reaction' THEN 'Abnormal return was positive with explicit basket/theme evidence.' ELSE 'Abnormal return was negative with explicit basket/theme evidence.' END AS reason FROM (" + REACTION_TABLE + ")"
)
CLASS_TABLE = (
    "SELECT news, reaction, extended, setup, volume, setup + CASE WHEN volume THEN 8 ELSE 0 END AS score, "
    "CASE WHEN pos AND reaction = 'Positive Abnormal Reaction' AND extended THEN 'Avoid Chase' WHEN reaction IN ('Sell the News', 'Negative Abnormal Reaction') THEN 'Avoid' WHEN neg AND reaction = 'Bad News Absorbed' THEN 'Watch' "
    "WHEN reaction IN ('Inconclusive', 'No Meaningful Abnormal Reaction') THEN CASE WHEN pos THEN 'Wait for Confirmation' ELSE 'Avoid' END WHEN pos AND reaction = 'Positive Abnormal Reaction' AND setup + CASE WHEN volume THEN 8 ELSE 0 END >= 70 THEN 'Tradeable' "
    "WHEN reaction = 'Positive Abnormal Reaction' THEN 'Watch' ELSE 'Avoid' END AS classification, "
    "CASE WHEN pos AND reaction = 'Positive Abnormal Reaction' AND extended THEN 'Positive catalyst and reaction are real, but the setup is technically overextended.' WHEN reaction IN ('Sell the News', 'Negative Abnormal Reaction') THEN 'Abnormal reaction argues against the bullish thesis.' "
    "WHEN neg AND reaction = 'Bad News Absorbed' THEN 'Bad news was absorbed, but needs forward validation.' WHEN reaction IN ('Inconclusive', 'No Meaningful Abnormal Reaction') THEN CASE WHEN pos THEN 'Positive catalyst has not produced a meaningful abnormal reaction.' ELSE 'No testable positive validation is present.' END "
    "WHEN pos AND reaction = 'Positive Abnormal Reaction' AND setup + CASE WHEN volume THEN 8 ELSE 0 END >= 70 THEN 'Catalyst, abnormal reaction, and setup score align.' WHEN reaction = 'Positive Abnormal Reaction' THEN 'Positive abnormal reaction exists, but setup quality is not high enough.' "
    "ELSE 'Rules did not find a validated setup.' END AS reason FROM (SELECT *, lower(news) IN ('positive', 'bullish', 'good') AS pos, lower(news) IN ('negative', 'bearish', 'bad') AS neg FROM " + values(extras.CLASS_ROWS, "news, reaction, extended, setup, volume") + ")"
)
OVEREXTENDED = "SELECT flag, rsi, return_20d, coalesce(flag, false) OR coalesce(rsi >= 75, false) OR coalesce(return_20d >= 0.25, false) AS overextended FROM " + values(extras.EXTENSION_ROWS, "flag, rsi, return_20d")
OUTCOME_TABLE = (
    "SELECT classification, ar, CASE WHEN ar IS NOT NULL AND classification = 'Tradeable' THEN ar > 0 END AS trade_hit, CASE WHEN ar IS NOT NULL AND classification IN ('Watch', 'Wait for Confirmation') THEN ar > 0 END AS watch_followthrough, "
    "CASE WHEN ar IS NOT NULL AND classification IN ('Avoid', 'Avoid Chase') THEN ar <= 0 END AS avoided_bad_trade, CASE WHEN ar IS NULL OR classification = 'Other' THEN NULL WHEN classification IN ('Avoid', 'Avoid Chase') THEN ar > 0.02 ELSE false END AS false_negative FROM "
    + values(extras.OUTCOME_ROWS, "classification, ar")
)
SENTIMENTS = (
    "SELECT word, CASE WHEN w IN ('positive', 'bullish', 'good', 'upbeat') THEN 'positive' WHEN w IN ('negative', 'bearish', 'bad', 'downbeat') THEN 'negative' ELSE 'neutral' END AS event_sentiment, "
    "CASE WHEN w IN ('positive', 'bullish', 'good') THEN 'positive' WHEN w IN ('negative', 'bearish', 'bad') THEN 'negative' ELSE 'neutral' END AS signal_sentiment FROM (SELECT word, lower(trim(coalesce(word, ''))) AS w FROM "
    + values([(w,) for w in extras.SENTIMENT_WORDS], "word") + ")"
)
HORIZONS = "SELECT horizon, horizon IN (1, 3, 5, 20, 60) AS known, CASE horizon " + "WHEN 1 THEN '1D event reaction' WHEN 3 THEN '3D event digestion' WHEN 5 THEN '5D swing validation' WHEN 20 THEN '20D theme validation' WHEN 60 THEN '60D broader context'" + " END AS label FROM (SELECT DISTINCT CAST(p_size AS INTEGER) AS horizon FROM part)"
DEFAULT_HORIZONS = "SELECT signal_type, CAST(horizon_days AS INTEGER) AS horizon_days FROM (VALUES ('event_reaction', 1), ('event_reaction', 3), ('trade_setup', 5), ('theme_thesis', 20), ('context', 60), ('technical_extension', 5), ('technical_extension', 20), ('basket_confirmation', 5), ('basket_confirmation', 20), ('other', NULL)) t(signal_type, horizon_days)"
WITH_SERIES = """WITH series AS (
    SELECT *, CASE event_id % 4 WHEN 0 THEN ts + INTERVAL 5 HOUR WHEN 1 THEN ts WHEN 2 THEN ts END AS t FROM (
        SELECT event_type AS symbol, date_trunc('second', ts) AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN '-05:00' WHEN 1 THEN 'Z' ELSE '' END AS stamp,
            CASE WHEN event_id % 4 = 3 THEN 'no time' ELSE stamp END AS time, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS price, event_id
        FROM events, range(CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END)))
"""
AVAILABLE = """SELECT w.symbol, w.symbol IN (SELECT symbol FROM series WHERE price IS NOT NULL AND NOT isnan(price)) AS available FROM (VALUES ('click'), ('view'), ('purchase'), ('nowhere')) w(symbol)"""
MERGED = """SELECT n_name AS symbol, DATE '2026-01-01' + CAST(d AS INTEGER) AS session_date, CAST(n_nationkey * CASE WHEN n_nationkey % 6 = 0 THEN 100 WHEN n_nationkey % 2 = 0 THEN 10 ELSE 1 END + d AS DOUBLE) AS adjusted_close
FROM nation, range(1, 4) t(d) WHERE n_nationkey < 15 OR n_nationkey % 2 = 0"""
TYPED = """SELECT '2026-01-02T00:00:00' AS saved_at, decision_id, ticker, event_type, horizon_days, max_loss, status, CAST(NULL AS VARCHAR) AS notes,
    CASE WHEN NOT entry THEN 'proceed' WHEN high_runup THEN 'avoid_chase' WHEN priced_for_perfection_candidate OR earnings_imminent OR no_invalidation_rule THEN 'wait'
    WHEN event_gamble OR short_dated_option OR leveraged_product THEN 'use_spread_or_hedge' WHEN position_too_large THEN 'reduce_size' ELSE 'proceed' END AS verdict, high_runup, event_gamble, 0 AS n_reasons FROM flags"""
UPSERT = """WITH b AS (SELECT l_orderkey AS signal_id, l_linenumber AS batch_seq, min(l_discount) AS forward_return, min(l_returnflag = 'R') AS hit FROM lineitem GROUP BY ALL)
SELECT signal_id, forward_return, hit FROM b QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY batch_seq DESC) = 1"""
V_LABELS = (
    "SELECT *, CASE WHEN ar IS NULL THEN 'Inconclusive' WHEN news = 'positive' AND ar > 0.005 THEN 'Positive Abnormal Reaction' WHEN news = 'positive' AND ar < -0.005 THEN 'Sell the News' WHEN news = 'negative' AND ar >= 0 THEN 'Bad News Absorbed' "
    "WHEN news = 'negative' AND ar < -0.005 THEN 'Negative Abnormal Reaction' WHEN news IN ('neutral', 'mixed') THEN CASE WHEN abs(ar) > 0.005 AND abs(coalesce(peer, 0)) > 0.005 THEN CASE WHEN ar > 0 THEN 'Positive Abnormal Reaction' ELSE 'Negative Abnormal Reaction' END ELSE 'Inconclusive' END "
    "WHEN causality = 'low' THEN 'Inconclusive' WHEN abs(ar) <= 0.005 THEN 'No Meaningful Abnormal Reaction' ELSE 'Inconclusive' END AS label, CAST(CASE WHEN quality <> 'ok' THEN 0.35 WHEN causality = 'medium' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM "
    + values(extras.LABEL_ROWS, "news, ar, peer, causality, quality")
)
V_OUTCOMES = (
    "SELECT *, CASE WHEN ar IS NOT NULL AND classification IN ('Tradeable', 'Watch', 'Wait for Confirmation') THEN ar > 0 END AS hit, CASE WHEN ar IS NOT NULL AND classification IN ('Avoid', 'Avoid Chase') THEN ar <= 0 OR coalesce(drawdown, 0) <= -0.05 END AS avoided_bad_trade, "
    "CASE WHEN ar IS NOT NULL AND classification IN ('Avoid', 'Avoid Chase') THEN ar >= 0.05 END AS false_negative FROM " + values(extras.DRAWDOWN_ROWS, "classification, ar, drawdown")
)

# Values of the pre-trade rules, as they must come out.
FLAGS = ["earnings_imminent", "high_runup", "short_dated_option", "leveraged_product", "no_invalidation_rule", "position_too_large", "event_gamble", "priced_for_perfection_candidate"]
PROMPTS = (
    "No usable invalidation rule / stop basis was provided.|Reflection: what specific price, level, or event would prove this thesis wrong?|Reflection: define your exit basis before entry — where do you get out if it goes against you?"
    "|These are reasoning prompts, not financial advice and not a recommended stop level."
)
REASON_OF = {
    "high_runup": "Recent large run-up flagged; entering here risks chasing.", "event_gamble": "Binary event with a leveraged or naked short-dated instrument reads as an event gamble.",
    "short_dated_option": "Naked short-dated option into a binary event; time-decay and gamma risk are high.", "leveraged_product": "Leveraged product carries path and decay risk.",
    "position_too_large": "Position size exceeds the 10% soft limit.", "priced_for_perfection_candidate": "You rate market expectation as high; the setup may be priced for perfection.",
    "earnings_imminent": "Earnings are imminent; the outcome is binary.",
}
WITH_DECISIONS = """WITH decisions AS (SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE ' t' || (o_orderkey % 50) END AS ticker, 'theme' AS theme, 'thesis' AS entry_thesis,
    ['earnings', 'guidance', 'analyst_day', 'product_launch', 'sympathy_move', 'pullback', 'breakout', 'macro_event', 'other', 'unknown'][CAST(o_orderkey % 10 + 1 AS INTEGER)] AS event_type,
    ['buy', 'add', 'hold', 'trim', 'avoid', 'watch'][CAST(o_orderkey // 3 % 6 + 1 AS INTEGER)] AS planned_action,
    ['stock', 'call', 'put', 'call_spread', 'put_spread', 'leveraged_etf', 'other'][CAST(o_orderkey // 2 % 7 + 1 AS INTEGER)] AS instrument_type,
    ['low', 'medium', 'high'][CAST(o_orderkey // 5 % 3 + 1 AS INTEGER)] AS market_expectation, ['low', 'medium', 'high'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS confidence,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'entered' END AS status, CAST(o_orderkey % 40 AS INTEGER) AS horizon_days,
    ['below the 50 day line', ' IDK ', '', 'tbd', 'close under 90'][CAST(o_orderkey // 7 % 5 + 1 AS INTEGER)] AS invalidation_rule, CAST(o_orderkey % 113 AS DOUBLE) AS position_size,
    CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 9 - 1) / 2.0 END AS max_loss FROM orders)
"""
VIOLATIONS = (
    "SELECT decision_id, upper(trim(ticker)) AS ticker, coalesce(status, 'pending') AS status, concat_ws('|', CASE WHEN trim(ticker) = '' THEN 'ticker is required and cannot be empty' END, CASE WHEN event_type = 'unknown' THEN 'event_type must be one of: "
    "earnings, guidance, analyst_day, product_launch, sympathy_move, pullback, breakout, macro_event, other"
    "' END, CASE WHEN horizon_days <= 0 THEN 'horizon_days must be a positive number of days' END, CASE WHEN position_size > 100 THEN 'position_size must be a percent of portfolio between 0 and 100' END, CASE WHEN max_loss < 0 THEN 'max_loss cannot be negative' END) AS violations FROM decisions"
)
WITH_FLAGS = WITH_DECISIONS + """, shorts AS (SELECT *, instrument_type IN ('call', 'put') AND horizon_days <= 5 AND event_type IN ('earnings', 'guidance') AS short_dated_option, instrument_type = 'leveraged_etf' AS leveraged_product,
    event_type IN ('earnings', 'guidance', 'analyst_day', 'product_launch', 'macro_event') AS binary_event, planned_action IN ('buy', 'add', 'hold') AS entry FROM decisions),
flags AS (SELECT *, event_type = 'earnings' AS earnings_imminent, decision_id % 6 = 0 AS high_runup, lower(trim(invalidation_rule)) IN ('idk', '', 'tbd') AS no_invalidation_rule, position_size > 10 AS position_too_large,
    binary_event AND (short_dated_option OR leveraged_product) AS event_gamble, market_expectation = 'high' AS priced_for_perfection_candidate FROM shorts)
"""
ACTIVE = "SELECT decision_id, concat_ws(',', " + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in FLAGS) + ") AS active, " + " OR ".join(FLAGS) + " AS any_active FROM flags"
VERDICT = """SELECT decision_id, CASE WHEN NOT entry THEN 'proceed' WHEN high_runup THEN 'avoid_chase' WHEN priced_for_perfection_candidate OR earnings_imminent OR no_invalidation_rule THEN 'wait'
    WHEN event_gamble OR short_dated_option OR leveraged_product THEN 'use_spread_or_hedge' WHEN position_too_large THEN 'reduce_size' ELSE 'proceed' END AS verdict, true AS heuristic_only, true AS not_financial_advice FROM flags"""
REASONS = (
    "SELECT decision_id, CASE WHEN r = '' THEN " + quoted("No behavioral risk flags triggered by this heuristic check.") + " ELSE r END AS reasons FROM (SELECT decision_id, concat_ws('|', CASE WHEN entry AND no_invalidation_rule THEN " + quoted(PROMPTS) + " END, "
    + ", ".join(f"CASE WHEN {name} THEN {quoted(reason)} END" for name, reason in REASON_OF.items())
    + ", CASE WHEN instrument_type IN ('call_spread', 'put_spread') AND binary_event AND market_expectation = 'high' THEN " + quoted("Defined-risk spread into a binary event with high expectations; risk is capped but still event-dependent.")
    + " END, CASE WHEN max_loss > 0 THEN CASE WHEN decision_id % 2 = 0 AND position_size > 0 THEN 'Your inputs imply roughly a ' || CAST(CAST(round_even(max_loss / position_size * 100, 0) AS BIGINT) AS VARCHAR) || '% adverse move on this position (max loss ' || "
    "CASE WHEN max_loss = floor(max_loss) THEN CAST(CAST(max_loss AS BIGINT) AS VARCHAR) ELSE CAST(CAST(max_loss AS DECIMAL(10, 1)) AS VARCHAR) END || '% of portfolio / position ' || CAST(CAST(position_size AS BIGINT) AS VARCHAR) || '% of portfolio). This is pure arithmetic from your own numbers, not a recommended stop.' ELSE "
    + quoted("Max loss recorded; define the exit basis. The unit is not specified as % of portfolio, so no implied price move is computed.") + " END END, CASE WHEN NOT entry AND (" + " OR ".join(FLAGS) + ") THEN 'Planned action is ''' || planned_action || ''' (not an entry); risk escalation suppressed.' END) AS r FROM flags)"
)
DECISION_ROWS = "".join(
    f"{'' if i == 0 else ' UNION ALL '}SELECT decision_id, '{label}' AS \"Field\", {expr} AS \"Value\" FROM decisions"
    for i, (label, expr) in enumerate(
        [
            ("Ticker", "ticker"), ("Planned action", "planned_action"), ("Instrument", "instrument_type"), ("Event type", "event_type"), ("Horizon (days)", "CAST(horizon_days AS VARCHAR)"),
            ("Max loss", "coalesce(CAST(CAST(max_loss AS DECIMAL(10, 1)) AS VARCHAR), '')"), ("Invalidation rule", "CASE WHEN invalidation_rule = '' THEN '(none)' ELSE invalidation_rule END"),
            ("Position size (%)", "CAST(CAST(position_size AS INTEGER) AS VARCHAR)"), ("Confidence", "confidence"), ("Market expectation", "market_expectation"), ("Theme", "theme"), ("Status", "coalesce(status, '')"),
        ]
    )
)
JOURNAL = """SELECT CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS saved_at, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE 'T' || (o_orderkey % 50) END AS ticker,
    CASE WHEN o_orderkey % 5 IN (3, 4) THEN '' ELSE 'wait' END AS verdict FROM orders WHERE o_orderkey % 5 NOT IN (1, 2)"""
NEWS = """SELECT o_custkey AS feed, CAST(n AS INTEGER) AS position, t.title, t.publisher, t.link, t.timestamp FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0) o,
LATERAL (VALUES (0, 'Flat ' || o_orderkey, 'Wire', 'http://a/' || o_orderkey, strftime(to_timestamp(1600000000 + o_orderkey) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'),
    (1, 'Nested ' || o_orderpriority, 'Desk', 'http://b', strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')), (3, NULL, NULL, 'http://c', 'oops')) t(n, title, publisher, link, timestamp)"""
NEWS = NEWS.replace("o_custkey AS feed", "o_orderkey AS feed")
HEADLINES = "WITH titles AS (SELECT o_orderkey AS feed, 'Flat ' || o_orderkey AS a, 'Nested ' || o_orderpriority AS b FROM orders WHERE o_orderkey % 3 <> 0) SELECT feed, a || ' / ' || b AS headlines, " + quoted("Summarize ONLY the following public news headlines at a topic level. Do not use any outside knowledge or price data.") + " || chr(10) || chr(10) || 'Headlines:' || chr(10) || '- ' || a || chr(10) || '- ' || b AS prompt FROM titles"
FORMATS = "SELECT n, whole, short, pct FROM " + values([(i, f"{v:.0f}", f"{v:g}", f"{v / 100 * 100:.1f}%") for i, v in enumerate(extras.FORMAT_NUMBERS)], "n, whole, short, pct")
TEXTS = """SELECT o_orderkey AS id, o_orderstatus AS symbol, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS key, replace(o_orderpriority, ' ', '_') || '_é_' AS part FROM orders"""
SETS = """WITH n AS (SELECT n_name AS symbol, n_nationkey AS k FROM nation) SELECT symbol, 'union' AS kind FROM n WHERE k < 15 OR k % 2 = 0 UNION ALL SELECT symbol, 'difference' FROM n WHERE k < 15 AND k % 2 <> 0 UNION ALL SELECT symbol, 'intersection' FROM n WHERE k < 15 AND k % 2 = 0"""
# The demo run from its prices: five sessions ahead of the first one; no beta has a history, so all are 1.
WITH_LAB = """WITH sessions AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DATE '2026-01-01' + CAST(i AS INTEGER) AS day FROM range(16) t(i)) WHERE isodow(day) < 6),
series AS (SELECT symbol, unnest(p) AS p, generate_subscripts(p, 1) AS n FROM (VALUES
    ('SPY', [100, 100.5, 101, 101.5, 102, 102.5, 102.8, 103, 103.2, 103.4, 103.5, 103.7]), ('SMH', [100, 101, 102, 102.5, 103, 104, 104.5, 105, 105.5, 106, 106.2, 106.4]),
    ('JETS', [100, 99.5, 99, 98.8, 99, 99.4, 99.7, 100, 100.1, 100.3, 100.5, 100.8]), ('HACK', [100, 101, 102, 103, 104, 104.5, 104.7, 105, 105.2, 105.4, 105.5, 105.7]),
    ('NVDA', [100, 102, 104, 105, 108, 112, 111, 113, 114, 116, 118, 119]), ('UAL', [50, 49, 48, 47, 47.5, 48, 48.2, 48.5, 49, 49.4, 49.6, 50]),
    ('CRWD', [70, 72, 75, 78, 82, 84, 83, 82, 81, 80, 79, 78]), ('MSFT', [200, 201, 202, 202, 203, 204, 204, 205, 205, 206, 206, 207]),
    ('DAL', [40, 39.8, 39.6, 39.5, 39.4, 39.7, 39.9, 40.1, 40.2, 40.3, 40.5, 40.6])) t(symbol, p)),
moves AS (SELECT symbol, h, CAST(max(p) FILTER (WHERE n = 1 + h) AS DOUBLE) / CAST(max(p) FILTER (WHERE n = 1) AS DOUBLE) - 1 AS r FROM series CROSS JOIN (VALUES (1), (5)) t(h) GROUP BY symbol, h),
members AS (SELECT * FROM (VALUES ('NVDA', 'SMH'), ('UAL', 'JETS'), ('CRWD', 'HACK'), ('MSFT', NULL), ('DAL', 'JETS')) t(ticker, proxy)),
abnormal AS (
    SELECT c.ticker, t.h, t.r AS raw, CASE WHEN s.r IS NULL THEN t.r - m.r ELSE t.r - 0.5 * m.r - 0.5 * s.r END AS ar
    FROM members c JOIN moves t ON t.symbol = c.ticker JOIN moves m ON m.symbol = 'SPY' AND m.h = t.h LEFT JOIN moves s ON s.symbol = c.proxy AND s.h = t.h),
inputs AS (SELECT * FROM (VALUES ('NVDA', 62.0, 0.12, 78.0), ('UAL', 51.0, 0.02, 58.0), ('CRWD', 81.0, 0.31, 82.0)) t(ticker, rsi, return_20d, setup)),
classed AS (
    SELECT i.ticker, CASE WHEN abs(e.ar) < 0.01 THEN 'Wait for Confirmation' WHEN e.ar < 0 THEN 'Avoid' WHEN rsi >= 75 OR return_20d >= 0.25 THEN 'Avoid Chase' WHEN setup + 8 >= 70 THEN 'Tradeable' ELSE 'Watch' END AS classification,
        f.raw, f.ar AS far FROM inputs i JOIN abnormal e ON e.ticker = i.ticker AND e.h = 1 JOIN abnormal f ON f.ticker = i.ticker AND f.h = 5),
base AS (SELECT avg(CAST(ar > 0 AS INTEGER)) AS rate FROM abnormal WHERE h = 5)
"""
LAB_GROUPS = """SELECT CAST(5 AS INTEGER) AS horizon_days, classification, count(*) AS sample_size, round(avg(CAST(far > 0 AS INTEGER)), 6) AS sample_positive_rate, round(any_value(rate), 6) AS base_rate,
    round(avg(CASE WHEN classification = 'Tradeable' THEN CAST(far > 0 AS INTEGER) END), 6) AS trade_hit_rate, round(avg(CASE WHEN classification = 'Tradeable' THEN CAST(far > 0 AS INTEGER) END) - any_value(rate), 6) AS excess_trade_hit_rate,
    round(avg(CASE WHEN classification IN ('Watch', 'Wait for Confirmation') THEN CAST(far > 0 AS INTEGER) END), 6) AS watch_followthrough_rate,
    round(avg(CASE WHEN classification IN ('Avoid', 'Avoid Chase') THEN CAST(far <= 0 AS INTEGER) END), 6) AS avoided_bad_trade_rate,
    count(*) FILTER (WHERE classification IN ('Avoid', 'Avoid Chase') AND far > 0.02) AS false_negatives, round(avg(far), 6) AS average_forward_abnormal_return
FROM classed CROSS JOIN base GROUP BY classification"""
LAB_SUMMARY = """SELECT count(*) AS sample_size, round(avg(CAST(far > 0 AS INTEGER)), 6) AS sample_positive_rate, round(avg(far), 6) AS average_forward_abnormal_return, round(median(far), 6) AS median_forward_abnormal_return,
    count(*) FILTER (WHERE classification = 'Tradeable' AND far <= 0) AS false_positives, count(*) FILTER (WHERE classification IN ('Avoid', 'Avoid Chase') AND far > 0.02) AS false_negatives,
    count(*) FILTER (WHERE classification = 'Avoid Chase') AS avoid_chase_count FROM classed"""
LAB_OUTCOMES = """SELECT c.ticker, classification, (SELECT day FROM sessions WHERE n = 6) AS horizon_end, 'matured' AS status, round(raw, 6) AS raw_return, round(far, 6) AS forward_abnormal_return,
    round(low / first - 1, 6) AS max_drawdown, round(high / first - 1, 6) AS max_runup, true AS beta_fallback_used, 'demo' AS price_source, 'synthetic' AS price_adjustment
FROM classed c JOIN (SELECT symbol, CAST(min(p) AS DOUBLE) AS low, CAST(max(p) AS DOUBLE) AS high, CAST(max(p) FILTER (WHERE n = 1) AS DOUBLE) AS first FROM series WHERE n <= 6 GROUP BY symbol) w ON w.symbol = c.ticker"""
# The lab's run over the tables: all signals on the first session, when no beta has a history.
WITH_FIRST_DAY = WITH_SIGNALS + """, spans AS (SELECT CAST(h AS INTEGER) AS h, c.session_date AS e FROM (VALUES (1), (3), (5), (20), (60)) t(h) LEFT JOIN cal c ON c.ord = 1 + h),
opening AS (SELECT symbol, arg_min(p, session_date) AS p FROM panel WHERE session_date >= (SELECT min(session_date) FROM cal) GROUP BY symbol),
runs AS (
    SELECT o.symbol, s.h, s.e, arg_max(q.p, q.session_date) / nullif(o.p, 0) - 1 AS r FROM opening o CROSS JOIN spans s JOIN panel q ON q.symbol = o.symbol AND q.session_date <= s.e GROUP BY o.symbol, s.h, s.e, o.p),
abnormal AS (
    SELECT n.ticker, s.h, s.e, t.r AS raw, CASE WHEN p.r IS NULL THEN t.r - m.r ELSE t.r - 0.5 * m.r - 0.5 * p.r END AS ar, n.ticker IN (SELECT symbol FROM opening) AS priced
    FROM nations n CROSS JOIN spans s LEFT JOIN runs t ON t.symbol = n.ticker AND t.h = s.h LEFT JOIN runs m ON m.symbol = 'MKT' AND m.h = s.h LEFT JOIN runs p ON p.symbol = n.sector_proxy AND p.h = s.h),
labelled AS (
    SELECT s.*, CASE WHEN a.ar IS NULL OR sentiment = 'neutral' THEN 'none' WHEN abs(a.ar) < 0.01 THEN 'none' WHEN sentiment = 'positive' THEN CASE WHEN a.ar > 0 THEN 'good' ELSE 'against' END WHEN a.ar >= 0 THEN 'absorbed' ELSE 'against' END AS label
    FROM signals s JOIN abnormal a ON a.ticker = s.ticker AND a.h = 1),
ruled AS (
    SELECT *, CASE WHEN label = 'good' AND rsi >= 75 THEN 'Avoid Chase' WHEN label = 'against' THEN 'Avoid' WHEN label = 'absorbed' THEN 'Watch' WHEN label = 'none' THEN CASE WHEN sentiment = 'positive' THEN 'Wait for Confirmation' ELSE 'Avoid' END
        WHEN setup_score + CASE WHEN volume THEN 8 ELSE 0 END >= 70 THEN 'Tradeable' ELSE 'Watch' END AS classification FROM labelled),
ended AS (
    SELECT r.id, r.classification, r.horizon_days, a.e AS horizon_end, CASE WHEN NOT a.priced THEN 'missing_prices' WHEN a.e IS NULL THEN 'insufficient_calendar' ELSE 'matured' END AS status,
        CASE WHEN a.priced AND a.e IS NOT NULL THEN a.raw END AS raw, CASE WHEN a.priced AND a.e IS NOT NULL THEN a.ar END AS far, CASE WHEN a.priced AND a.e IS NOT NULL THEN a.ar IS NOT NULL END AS fallback
    FROM ruled r JOIN abnormal a ON a.ticker = r.ticker AND a.h = r.horizon_days),
done AS (SELECT *, classification LIKE 'Avoid%' AS avoided FROM ended WHERE status = 'matured' AND far IS NOT NULL)
"""
FIRST_DAY_GROUPS = """, base AS (SELECT h, avg(CASE WHEN ar > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM abnormal WHERE priced AND ar IS NOT NULL GROUP BY h),
sums AS (
    SELECT horizon_days, classification, count(*) AS sample_size, avg(CAST(far > 0 AS INTEGER)) AS up, avg(CASE WHEN classification = 'Tradeable' THEN CAST(far > 0 AS INTEGER) END) AS hit,
        avg(CASE WHEN classification IN ('Watch', 'Wait for Confirmation') THEN CAST(far > 0 AS INTEGER) END) AS followed, avg(CASE WHEN avoided THEN CAST(far <= 0 AS INTEGER) END) AS spared,
        count(*) FILTER (WHERE avoided AND far > 0.02) AS false_negatives, avg(far) AS mean FROM done GROUP BY ALL)
SELECT horizon_days, classification, sample_size, round(up, 6) AS sample_positive_rate, round(rate, 6) AS base_rate, round(hit, 6) AS trade_hit_rate, round(hit - rate, 6) AS excess_trade_hit_rate, round(followed, 6) AS watch_followthrough_rate,
    round(spared, 6) AS avoided_bad_trade_rate, false_negatives, round(mean, 6) AS average_forward_abnormal_return FROM sums LEFT JOIN base ON h = horizon_days"""
FIRST_DAY_OUTCOMES = """SELECT id, classification, horizon_end, status, round(raw, 6) AS forward_return, round(far, 6) AS forward_abnormal_return, fallback AS beta_fallback_used, 'lines' AS price_source, 'average' AS price_adjustment FROM ended"""
FIRST_DAY_SUMMARY = """SELECT count(*) AS sample_size, round(avg(CAST(far > 0 AS INTEGER)), 6) AS sample_positive_rate, round(avg(far), 6) AS average_forward_abnormal_return, round(median(far), 6) AS median_forward_abnormal_return,
    count(*) FILTER (WHERE classification = 'Tradeable' AND far <= 0) AS false_positives, count(*) FILTER (WHERE avoided AND far > 0.02) AS false_negatives, count(*) FILTER (WHERE classification = 'Avoid Chase') AS avoid_chase_count FROM done"""
# Inputs of the rule tables from the orders, and what the rules make of them.
WITH_ORDER_INPUTS = """WITH inputs AS (SELECT o_orderkey AS id, ['positive', ' Bullish ', 'good', 'upbeat', 'negative', 'BEARISH', 'bad', 'downbeat', 'mixed', '', NULL][CAST(o_orderkey % 11 + 1 AS INTEGER)] AS word,
    ['positive', 'negative', 'neutral', 'mixed', 'other'][CAST(o_orderkey // 5 % 5 + 1 AS INTEGER)] AS news, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 41 - 20) / 200.0 END AS ar,
    CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 23 - 11) / 500.0 END AS peer, ['low', 'medium', 'high'][CAST(o_orderkey // 2 % 3 + 1 AS INTEGER)] AS causality,
    ['ok', 'beta_fallback_used'][CAST(o_orderkey // 3 % 2 + 1 AS INTEGER)] AS quality, ['Tradeable', 'Watch', 'Wait for Confirmation', 'Avoid', 'Avoid Chase', 'Other'][CAST(o_orderkey // 7 % 6 + 1 AS INTEGER)] AS classification,
    CASE WHEN o_orderkey % 4 <> 0 THEN -(o_orderkey % 13) / 100.0 END AS drawdown, [true, false, NULL][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS flag, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 101 END AS rsi,
    CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 61) / 100.0 END AS return_20d,
    ['event_reaction', 'trade_setup', 'theme_thesis', 'context', 'technical_extension', 'basket_confirmation', 'another'][CAST(o_orderkey // 4 % 7 + 1 AS INTEGER)] AS signal_type FROM orders)
"""
ORDER_SENTIMENTS = """SELECT id, CASE WHEN w IN ('positive', 'bullish', 'good', 'upbeat') THEN 'positive' WHEN w IN ('negative', 'bearish', 'bad', 'downbeat') THEN 'negative' ELSE 'neutral' END AS event_sentiment,
    CASE WHEN w IN ('positive', 'bullish', 'good') THEN 'positive' WHEN w IN ('negative', 'bearish', 'bad') THEN 'negative' ELSE 'neutral' END AS signal_sentiment FROM (SELECT id, lower(trim(coalesce(word, ''))) AS w FROM inputs)"""
ORDER_EXTENDED = "SELECT id, coalesce(flag, false) OR coalesce(rsi >= 75, false) OR coalesce(return_20d >= 0.25, false) AS overextended FROM inputs"
ORDER_OUTCOMES = """SELECT id, CASE WHEN ar IS NOT NULL AND classification = 'Tradeable' THEN ar > 0 END AS trade_hit, CASE WHEN ar IS NOT NULL AND classification IN ('Watch', 'Wait for Confirmation') THEN ar > 0 END AS watch_followthrough,
    CASE WHEN ar IS NOT NULL AND classification LIKE 'Avoid%' THEN ar <= 0 END AS avoided_bad_trade, CASE WHEN ar IS NULL OR classification = 'Other' THEN NULL WHEN classification LIKE 'Avoid%' THEN ar > 0.02 ELSE false END AS false_negative FROM inputs"""
ORDER_HORIZONS = """SELECT id, signal_type, CAST(h AS INTEGER) AS horizon_days FROM inputs LEFT JOIN (VALUES ('event_reaction', 1), ('event_reaction', 3), ('trade_setup', 5), ('theme_thesis', 20), ('context', 60),
    ('technical_extension', 5), ('technical_extension', 20), ('basket_confirmation', 5), ('basket_confirmation', 20)) d(kind, h) ON kind = signal_type"""
ORDER_LABELS = """SELECT id, CASE WHEN ar IS NULL THEN 'Inconclusive' WHEN news = 'positive' AND ar > 0.005 THEN 'Positive Abnormal Reaction' WHEN news = 'positive' AND ar < -0.005 THEN 'Sell the News'
    WHEN news = 'negative' AND ar >= 0 THEN 'Bad News Absorbed' WHEN news = 'negative' AND ar < -0.005 THEN 'Negative Abnormal Reaction'
    WHEN news IN ('neutral', 'mixed') THEN CASE WHEN abs(ar) <= 0.005 OR coalesce(abs(peer), 0) <= 0.005 THEN 'Inconclusive' WHEN ar > 0 THEN 'Positive Abnormal Reaction' ELSE 'Negative Abnormal Reaction' END
    WHEN causality = 'low' THEN 'Inconclusive' WHEN abs(ar) <= 0.005 THEN 'No Meaningful Abnormal Reaction' ELSE 'Inconclusive' END AS label,
    CAST(CASE WHEN quality <> 'ok' THEN 0.35 WHEN causality = 'medium' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM inputs"""
ORDER_DRAWDOWNS = """SELECT id, CASE WHEN ar IS NOT NULL AND classification IN ('Tradeable', 'Watch', 'Wait for Confirmation') THEN ar > 0 END AS hit, CASE WHEN ar IS NOT NULL AND classification LIKE 'Avoid%' THEN ar <= 0 OR coalesce(drawdown, 0) <= -0.05 END AS avoided_bad_trade,
    CASE WHEN ar IS NOT NULL AND classification LIKE 'Avoid%' THEN ar >= 0.05 END AS false_negative FROM inputs"""
# The sentences of a thesis, by the condition under which each is listed, and what its class says.
THESIS_FOR = [
    ("ma", "Ticker is above the 20D moving average."), ("ar > 0", "5D abnormal return is positive."), ("breadth > 0.5", "Basket breadth is above 50%."),
    ("vol > 1.2", "Volume is above 1.2x its recent average."), ("ev", "Event study shows a positive abnormal reaction."),
]
THESIS_AGAINST = [
    ("NOT ma", "Ticker is not above the 20D moving average."), ("ar <= 0", "5D abnormal return is negative."), ("breadth <= 0.5", "Basket breadth is not broad enough."), ("rsi", "RSI is above 75."),
    ("far", "Price is more than 10% above the 20D moving average."), ("risk", "Macro regime is Risk-Off."), ("news AND down", "Positive news produced a negative abnormal reaction."),
]
THESIS_OPEN = [("ar IS NULL", "Need 5D abnormal return validation.")]
THESIS_INVALID = [("rsi", "Overextension risk remains high."), ("far", "Wait for price to digest the move.")]
THESIS_REASON = {
    "Tradeable": "Rule-based evidence is broad enough and extension risk is not high.", "Watch": "Evidence is constructive but still has conflicts or missing confirmation.",
    "Avoid Chase": "Setup has positive evidence but extension risk is high.", "Avoid": "Evidence conflicts or score is negative.", "Wait for Confirmation": "More forward-return confirmation is needed.",
}


def listed(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {condition} THEN {quoted(text)} END" for condition, text in pairs) + ")"


THESIS = f"""WITH x AS (
    SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS ma, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 7 - 3) / 100.0 END AS ar, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 10) / 10.0 END AS breadth,
        (o_orderkey % 20) / 10.0 AS vol, o_orderkey % 101 > 75 AS rsi, o_orderkey % 17 > 10 AS far, o_orderkey % 4 = 0 AS risk, o_orderkey % 3 = 0 AS news, o_orderkey % 11 < 4 AS ev, o_orderkey % 11 < 6 AS up, o_orderkey % 13 < 3 AS down
    FROM orders),
points AS (
    SELECT *, CASE WHEN ma THEN 2 ELSE -1 END + CASE WHEN ar > 0 THEN 2 WHEN ar <= 0 THEN -2 ELSE 0 END + CASE WHEN breadth > 0.5 THEN 2 WHEN breadth <= 0.5 THEN -1 ELSE 0 END + CASE WHEN vol > 1.2 THEN 1 ELSE 0 END
            - CASE WHEN rsi THEN 3 ELSE 0 END - CASE WHEN far THEN 3 ELSE 0 END - CASE WHEN risk THEN 2 ELSE 0 END + CASE WHEN ev THEN 2 ELSE 0 END - CASE WHEN news AND down THEN 3 ELSE 0 END AS total,
        NOT ma OR coalesce(ar <= 0, false) OR coalesce(breadth <= 0.5, false) OR rsi OR far OR risk OR (news AND down) AS doubted, news AND up AND (rsi OR far) AND vol > 1.5 AS caught
    FROM x),
classed AS (
    SELECT *, CASE WHEN caught THEN 'Avoid Chase' WHEN total < 0 THEN 'Avoid' WHEN (rsi OR far) AND total > 0 THEN 'Avoid Chase' WHEN doubted AND total >= 3 THEN 'Watch' WHEN total >= 6 THEN 'Tradeable' WHEN total >= 2 THEN 'Watch'
        ELSE 'Wait for Confirmation' END AS classification FROM points)
SELECT id, CAST(total AS INTEGER) AS score, classification, CASE WHEN caught THEN 'The catalyst was positively received, but the stock is already technically extended.' ELSE CASE classification {" ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in THESIS_REASON.items())} END END AS reason,
    {listed(THESIS_FOR)} AS evidence_for, {listed(THESIS_AGAINST)} AS evidence_against, {listed(THESIS_OPEN)} AS confirmation_needed, {listed(THESIS_INVALID)} AS invalidation_signals,
    CASE WHEN caught OR ev THEN 'Confirmed on 1D event reaction' ELSE 'Inconclusive on 1D event reaction' END AS status_1d,
    CASE WHEN NOT caught AND ar > 0 THEN 'Confirmed on 5D swing horizon' ELSE 'Unconfirmed on 5D forward return' END AS status_5d, 'Still open on 20D theme horizon' AS status_20d
FROM classed"""
MATURITY_STREAM = """SELECT event_type, CAST(ts AS DATE) AS session_date, count(*) AS n FROM events GROUP BY ALL"""
