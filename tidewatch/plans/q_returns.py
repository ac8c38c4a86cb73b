"""Queries for calendars, cleaning, returns and window boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.expr import r
from tidewatch.operators import calendar as cl
from tidewatch.operators import returns as rt
from tidewatch.plans import fixtures as fx
from tidewatch.plans import sqlgen as sg
from tidewatch.plans.catalog import query
from tidewatch.sources.tables import handoff

CAL_START, CAL_END = "2016-01-01", "2024-12-31"
START, END = "2017-02-01", "2021-12-31"
DEV_START, DEV_END = "2017-01-01", "2023-12-31"
YEARS = (2020, 2021, 2022, 2023)

_EQ = ", ".join(f"({y}, DATE '{a}', DATE '{b}')" for y, a, b in cl.JPX_EQUINOXES)
_SP = ", ".join(f"(DATE '{d}', '{n}')" for d, n in cl.JPX_SPECIAL)
_AH = ", ".join(f"(DATE '{d}', '{n.replace(chr(39), chr(39) * 2)}')" for d, n in cl.AD_HOC_CLOSURES)


def _nth(m, wd, n):
    f = f"make_date(y, {m}, 1)"
    return f"({f} + CAST(({wd} - (isodow({f}) - 1) + 7) % 7 + {7 * (n - 1)} AS INTEGER))"


def _obs(d):
    return f"(CASE isodow({d}) WHEN 6 THEN {d} - 1 WHEN 7 THEN {d} + 1 ELSE {d} END)"


def _sun(d):
    return f"(CASE isodow({d}) WHEN 7 THEN {d} + 1 ELSE {d} END)"


def _md(m, d):
    return f"make_date(y, {m}, {d})"


_NYSE = [("New Year''s Day", _obs(_md(1, 1))), ("Martin Luther King Jr. Day", _nth(1, 0, 3)), ("Washington''s Birthday", _nth(2, 0, 3)),
         # Gauss rule, valid for 1900-2099
         ("Good Friday", "(make_date(y, 3, 22) + CAST(gd + ge - CASE WHEN gd = 29 AND ge = 6 THEN 7 WHEN gd = 28 AND ge = 6 AND y % 19 > 10 THEN 7 ELSE 0 END AS INTEGER) - 2)"),
         ("Memorial Day", "(make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) - 1) AS INTEGER))"),
         ("Juneteenth National Independence Day", f"CASE WHEN y >= 2022 THEN {_obs(_md(6, 19))} END"), ("Independence Day", _obs(_md(7, 4))),
         ("Labor Day", _nth(9, 0, 1)), ("Thanksgiving Day", _nth(11, 3, 4)), ("Christmas Day", _obs(_md(12, 25)))]
_KEPT = "y NOT IN (2020, 2021)"
_JPX = [("January holiday, no session", _md(1, 1)), ("January holiday, no session", _md(1, 2)), ("January holiday, no session", _md(1, 3)),
        ("December holiday, no session", _md(12, 31)), ("Coming of Age Day", _nth(1, 0, 2)), ("National Foundation Day", _sun(_md(2, 11))),
        ("Emperor''s Birthday", f"CASE WHEN y >= 2020 THEN {_sun(_md(2, 23))} END"), ("Emperor''s Birthday", f"CASE WHEN y <= 2018 THEN {_sun(_md(12, 23))} END"),
        ("Vernal Equinox", _sun("ve")), ("Autumnal Equinox", _sun("ae")), ("Showa Day", _sun(_md(4, 29))),
        ("Constitution Memorial Day", _sun(_md(5, 3))),
        ("Greenery Day", f"CASE WHEN isodow({_md(5, 3)}) = 7 OR isodow({_md(5, 4)}) = 7 THEN {_md(5, 5)} ELSE {_md(5, 4)} END"),
        ("Children''s Day", f"CASE WHEN isodow({_md(5, 3)}) = 7 OR isodow({_md(5, 4)}) = 7 OR isodow({_md(5, 5)}) = 7 THEN {_md(5, 6)} ELSE {_md(5, 5)} END"),
        ("Marine Day", f"CASE WHEN {_KEPT} THEN {_nth(7, 0, 3)} END"), ("Mountain Day", f"CASE WHEN {_KEPT} THEN {_sun(_md(8, 11))} END"),
        ("Respect for the Aged Day", _nth(9, 0, 3)), ("Sports Day", f"CASE WHEN {_KEPT} THEN {_nth(10, 0, 2)} END"),
        ("Culture Day", _sun(_md(11, 3))), ("Labour Thanksgiving Day", _sun(_md(11, 23)))]

SQL_CAL = f"""
yr AS (SELECT CAST(y AS INTEGER) AS y, ge0 AS gd, (2 * (y % 4) + 4 * (y % 7) + 6 * ge0 + 5) % 7 AS ge
  FROM (SELECT y, (19 * (y % 19) + 24) % 30 AS ge0 FROM (SELECT unnest(range(2015, 2026)) AS y))),
ny AS ({' UNION ALL '.join(f"SELECT y, '{n}' AS name, {d} AS date FROM yr" for n, d in _NYSE)}),
jyr AS (SELECT yr.y, e.ve, e.ae FROM yr JOIN (VALUES {_EQ}) e(y, ve, ae) ON e.y = yr.y),
jp AS ({' UNION ALL '.join(f"SELECT y, '{n}' AS name, {d} AS date FROM jyr" for n, d in _JPX)}),
sp(date, name) AS (VALUES {_SP}),
ah(date, name) AS (VALUES {_AH}),
clo AS MATERIALIZED (
  SELECT 'nyse' AS calendar, date, name FROM ny WHERE date IS NOT NULL AND year(date) = y AND isodow(date) < 6
  UNION ALL SELECT 'nyse', date, name FROM ah
  UNION ALL SELECT 'jpx', date, name FROM jp WHERE date IS NOT NULL AND year(date) = y AND isodow(date) < 6 AND date NOT IN (SELECT date FROM sp)
  UNION ALL SELECT 'jpx', date, name FROM sp WHERE isodow(date) < 6),
cal0 AS (SELECT c.calendar, d.date, k.name, CASE c.calendar WHEN 'jpx' THEN year(d.date) BETWEEN 2017 AND 2023 ELSE true END AS covered
  FROM (VALUES ('nyse'), ('jpx')) c(calendar) CROSS JOIN (SELECT CAST(unnest(range(DATE '{CAL_START}', DATE '{CAL_END}' + 1, INTERVAL 1 DAY)) AS DATE) AS date) d
  LEFT JOIN clo k ON k.calendar = c.calendar AND k.date = d.date),
cal AS MATERIALIZED (SELECT *, covered AND isodow(date) < 6 AND name IS NULL AS is_open,
  CAST(sum(CAST(covered AND isodow(date) < 6 AND name IS NULL AS INTEGER)) OVER (PARTITION BY calendar ORDER BY date) AS BIGINT) AS ordinal FROM cal0)"""


def calendar(spark, sf):
    """The date dimension (two rows per calendar day), written once per session."""
    return rt.small(handoff(spark, ("calendar", sf, CAL_START, CAL_END), lambda: cl.trading_calendar(spark, CAL_START, CAL_END)))


def _cal_of(c="asset"):
    return F.when(F.col(c).isin("2-HIGH", "4-NOT SPECIFIED"), "jpx").otherwise("nyse")


_CALSQL = "CASE WHEN asset IN ('2-HIGH', '4-NOT SPECIFIED') THEN 'jpx' ELSE 'nyse' END"


def level(spark, sf):
    return fx.level_daily(spark, sf).withColumn("calendar", _cal_of())


SQL_LV = f"{fx.SQL_LEVEL}, lv AS MATERIALIZED (SELECT *, {_CALSQL} AS calendar FROM level)"
SQL_BOTH = f"WITH {SQL_CAL}, {SQL_LV}"
WIN = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
NOT_SHUT = "NOT EXISTS (SELECT 1 FROM clo c WHERE c.calendar = l.calendar AND c.date = l.date)"


@query("source_census", f"""WITH {fx.SQL_LEVEL_RAW}
SELECT asset, count(*) AS rows_in_file, count(value) AS rows_with_value, count(*) FILTER (WHERE value IS NULL) AS rows_blank, min(date) AS first_date, max(date) AS last_date FROM level_raw GROUP BY asset""")
def source_census(spark, sf):
    return rt.source_census(fx.level_raw(spark, sf))


@query("trading_calendar", f"""WITH {SQL_CAL}, u AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + {fx.SHIFT_DAYS} AS date FROM orders)
SELECT calendar, date, is_open, name, covered, ordinal, u.date IS NOT NULL AS has_data FROM cal LEFT JOIN u USING (date)""".replace("u.date IS NOT NULL", "date IN (SELECT date FROM u)"))
def trading_calendar(spark, sf):
    seen = fx.level_daily(spark, sf).select("date").distinct().withColumn("has_data", F.lit(True))
    c = calendar(spark, sf).join(seen, "date", "left")
    return c.select("calendar", "date", "is_open", "name", "covered", "ordinal", F.coalesce("has_data", F.lit(False)).alias("has_data"))


@query("expected_trading_days", f"""{SQL_BOTH}
SELECT l.asset, year(c.date) AS year, count(*) AS n_expected, count(v.date) AS n_observed FROM (SELECT DISTINCT asset, calendar FROM lv) l JOIN cal c ON c.calendar = l.calendar AND c.is_open AND c.{WIN}
LEFT JOIN lv v ON v.asset = l.asset AND v.date = c.date GROUP BY l.asset, year(c.date)""")
def expected_trading_days(spark, sf):
    lv = level(spark, sf)
    want = lv.select("asset", "calendar").distinct().join(
        (rt.expected_trading_days(calendar(spark, sf), START, END)), "calendar")
    got = lv.select("asset", "date", F.lit(1).alias("_h"))
    return want.join(got, ["asset", "date"], "left").groupBy("asset", F.year("date").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("n_expected"), F.count("_h").alias("n_observed"))


@query("clean_price_series", f"""{SQL_BOTH}
SELECT asset, calendar, date, {sg.rnd('value', 6)} AS price FROM lv l WHERE {WIN} AND value IS NOT NULL AND {NOT_SHUT}""")
def clean_price_series(spark, sf):
    return rt.clean_prices(level(spark, sf), calendar(spark, sf), START, END).select("asset", "calendar", "date", r("price", 6).alias("price"))


def _lst(cond):
    return f"coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (WHERE {cond}), '')"


_DEF = [("n_dup > 0", "'duplicate_dates=' || n_dup"), ("n_np > 0", "'nonpositive_prices=' || n_np"), ("n_blank_open > 0", "'blank_on_open_day=' || n_blank_open"),
        ("n_absent > 0", "'open_day_absent=' || n_absent"), ("n_closed > 0", "'value_on_closed_day=' || n_closed"), ("ooo", "'unsorted_dates'"), ("NOT covers", "'range_not_covered'")]


@query("cleaning_report", f"""WITH {SQL_CAL}, {fx.SQL_LEVEL_RAW}, lr AS (SELECT *, {_CALSQL} AS calendar FROM level_raw),
oo AS (SELECT asset, bool_or(coalesce(bad, false)) AS ooo FROM (SELECT asset, date <= lag(date) OVER (PARTITION BY asset ORDER BY pos) AS bad FROM lr) GROUP BY asset),
per AS (SELECT asset, calendar, date, count(*) AS n, count(value) AS nv, count(*) FILTER (WHERE value <= 0) AS nnp FROM lr GROUP BY ALL),
f AS (SELECT asset, calendar, CAST(sum(n) AS BIGINT) AS rows_in_file, CAST(sum(CASE WHEN {WIN} THEN n ELSE 0 END) AS BIGINT) AS rows_in_window FROM per GROUP BY ALL),
g AS (SELECT f.asset, f.calendar, c.date, c.is_open, c.name IS NOT NULL AS shut, p.n, coalesce(p.nv, 0) AS nv, p.nnp FROM f JOIN cal c ON c.calendar = f.calendar AND c.{WIN} LEFT JOIN per p ON p.asset = f.asset AND p.date = c.date),
a AS (SELECT asset, calendar, count(*) FILTER (WHERE is_open) AS trading_days_expected, CAST(sum(nv) AS BIGINT) AS trading_days_observed, count(*) FILTER (WHERE n > 0 AND nv = 0) AS blank_days,
  count(*) FILTER (WHERE n > 0 AND nv = 0 AND shut) AS blank_days_matching_closure, {_lst('n > 0 AND nv = 0 AND is_open')} AS blank_on_open_day, {_lst('n IS NULL AND is_open')} AS open_day_absent,
  {_lst('nv > 0 AND shut')} AS value_on_closed_day, {_lst('n > 1')} AS duplicate_dates, {_lst('nnp > 0')} AS nonpositive_prices,
  count(*) FILTER (WHERE n > 0 AND nv = 0 AND is_open) AS n_blank_open, count(*) FILTER (WHERE n IS NULL AND is_open) AS n_absent, count(*) FILTER (WHERE nv > 0 AND shut) AS n_closed, count(*) FILTER (WHERE n > 1) AS n_dup, count(*) FILTER (WHERE nnp > 0) AS n_np,
  CAST(coalesce(sum(nv) FILTER (WHERE shut), 0) AS BIGINT) AS closed_day_prints, min(date) FILTER (WHERE nv > 0) AS available_from, max(date) FILTER (WHERE nv > 0) AS available_to FROM g GROUP BY asset, calendar),
x AS (SELECT a.*, f.rows_in_file, f.rows_in_window, oo.ooo, available_from <= DATE '{START}' + 7 AND available_to >= DATE '{END}' - 7 AS covers FROM a JOIN f USING (asset, calendar) JOIN oo USING (asset))
SELECT asset, calendar, rows_in_file, rows_in_window, trading_days_expected, trading_days_observed, blank_days, blank_days_matching_closure, closed_day_prints, trading_days_observed - closed_day_prints AS prints_used, blank_on_open_day, open_day_absent, value_on_closed_day, duplicate_dates, nonpositive_prices,
  available_from, available_to, ooo AS out_of_order, covers AS covers_request, concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN {t} END" for c, t in _DEF)}) AS defects FROM x""")
def cleaning_report(spark, sf):
    rep = rt.cleaning_report(fx.level_raw(spark, sf).withColumn("calendar", _cal_of()), calendar(spark, sf), START, END)
    lists = ("blank_on_open_day", "open_day_absent", "value_on_closed_day", "duplicate_dates", "nonpositive_prices")
    return rep.select("asset", "calendar", "rows_in_file", "rows_in_window", "trading_days_expected", "trading_days_observed", "blank_days",
                      "blank_days_matching_closure", "closed_day_prints", "prints_used", *[F.array_join(c, ",").alias(c) for c in lists], "available_from", "available_to",
                      "out_of_order", "covers_request", F.array_join("defects", "; ").alias("defects"))


_GAP = """CASE WHEN c1.covered AND c0.covered THEN CAST(c1.ordinal - c0.ordinal AS INTEGER) ELSE 0 END"""
_RJOIN = "LEFT JOIN cal c1 ON c1.calendar = q.calendar AND c1.date = q.date LEFT JOIN cal c0 ON c0.calendar = q.calendar AND c0.date = q.prev_date"
_RCOLS = f"q.asset, q.date, q.prev_date, {sg.rnd('q.price', 6)} AS price, {sg.rnd('q.ret')} AS ret, {_GAP} AS gap_trading_days, {_GAP} > 1 AS spans_missing_day"


def _lagged(where):
    return (f"q AS (SELECT * FROM (SELECT asset, calendar, date, value AS price, lag(date) OVER w AS prev_date, value / lag(value) OVER w - 1.0 AS ret "
            f"FROM lv l WHERE {where} AND value IS NOT NULL AND {NOT_SHUT} WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE ret IS NOT NULL)")


def _ret_out(df):
    return df.select("asset", "date", "prev_date", r("price", 6).alias("price"), r("ret").alias("ret"), "gap_trading_days", "spans_missing_day")


@query("simple_returns", f"{SQL_BOTH}, {_lagged(WIN)}\nSELECT {_RCOLS} FROM q {_RJOIN}")
def simple_returns(spark, sf):
    cal = calendar(spark, sf)
    return _ret_out(rt.simple_returns(rt.clean_prices(level(spark, sf), cal, START, END), cal))


_RUNUP = f"date BETWEEN DATE '{START}' - {rt.RUN_UP_DAYS} AND DATE '{END}'"


@query("returns_from_prices", f"{SQL_BOTH}, {_lagged(_RUNUP)}\nSELECT {_RCOLS} FROM q {_RJOIN} WHERE q.date >= DATE '{START}'")
def returns_from_prices(spark, sf):
    return _ret_out(rt.returns_from_prices(level(spark, sf), calendar(spark, sf), START, END))


@query("returns_from_prices_drop", f"{SQL_BOTH}, {_lagged(WIN)}\nSELECT {_RCOLS} FROM q {_RJOIN} WHERE NOT ({_GAP} > 1)")
def returns_from_prices_drop(spark, sf):
    return _ret_out(rt.returns_from_prices(level(spark, sf), calendar(spark, sf), START, END, prior_close=False, on_missing_day="drop"))


@query("returns_from_factor", f"""WITH {SQL_LV}, f AS (SELECT asset, date, lag(date) OVER (PARTITION BY asset ORDER BY date) AS prev_date, value AS ret FROM lv WHERE value IS NOT NULL)
SELECT asset, date, prev_date, {sg.rnd('ret', 6)} AS ret, CAST(1 AS INTEGER) AS gap_trading_days, false AS spans_missing_day FROM f WHERE {WIN}""")
def returns_from_factor(spark, sf):
    return rt.returns_from_factor(level(spark, sf), START, END).select("asset", "date", "prev_date", r("ret", 6).alias("ret"), "gap_trading_days", "spans_missing_day")


@query("factor_date_set_check", f"""{SQL_BOTH}, got AS (SELECT DISTINCT asset, calendar, date FROM lv WHERE {WIN} AND value IS NOT NULL),
want AS (SELECT a.asset, a.calendar, c.date FROM (SELECT DISTINCT asset, calendar FROM got) a JOIN cal c ON c.calendar = a.calendar AND c.is_open AND c.{WIN}),
s AS (SELECT 'm' AS side, * FROM (SELECT * FROM want EXCEPT SELECT * FROM got) UNION ALL SELECT 'u', * FROM (SELECT * FROM got EXCEPT SELECT * FROM want))
SELECT asset, calendar, count(*) FILTER (WHERE side = 'm') AS n_missing, count(*) FILTER (WHERE side = 'u') AS n_unexpected,
  array_to_string((list(CAST(date AS VARCHAR) ORDER BY date) FILTER (WHERE side = 'm'))[1:20], ',') AS first_missing, array_to_string((list(CAST(date AS VARCHAR) ORDER BY date) FILTER (WHERE side = 'u'))[1:20], ',') AS first_unexpected
FROM s GROUP BY asset, calendar""")
def factor_date_set_check(spark, sf):
    return rt.date_set_check(level(spark, sf), calendar(spark, sf), START, END)


SQL_SAMPLE = f"""WITH {SQL_CAL}, {fx.SQL_LEVEL}, {fx.SQL_REGISTRY},
lv AS MATERIALIZED (SELECT level.*, r.calendar, r.category FROM level JOIN registry r USING (asset)),
q AS (SELECT * FROM (SELECT asset, calendar, date, value AS price, lag(date) OVER w AS prev_date, value / lag(value) OVER w - 1.0 AS ret FROM lv l
  WHERE category = 'price_change' AND {_RUNUP} AND {NOT_SHUT} WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE ret IS NOT NULL),
smp AS MATERIALIZED (SELECT q.asset, q.date, q.prev_date, q.price, q.ret, {_GAP} AS gap_trading_days, 'price' AS kind FROM q {_RJOIN} WHERE q.date >= DATE '{START}'
  UNION ALL SELECT asset, date, prev_date, NULL, value, 1, 'factor' FROM (SELECT asset, date, lag(date) OVER (PARTITION BY asset ORDER BY date) AS prev_date, value FROM lv WHERE category = 'return') WHERE {WIN})"""


def sample(spark, sf):
    return rt.sample_returns(fx.level_daily(spark, sf), fx.registry(spark), calendar(spark, sf), START, END)


@query("sample_returns", f"""{SQL_SAMPLE}
SELECT asset, kind, count(*) AS n_returns, min(date) AS first_return_date, arg_min(prev_date, date) AS first_prev_date, kind = 'price' AND coalesce(arg_min(prev_date, date) < DATE '{START}', false) AS used_prior_close,
  count(*) FILTER (WHERE gap_trading_days > 1) AS n_spans_missing FROM smp GROUP BY asset, kind""".replace("kind = 'price' AND coalesce", "any_value(kind) = 'price' AND coalesce"))
def sample_returns(spark, sf):
    return rt.sample_provenance(sample(spark, sf), START)


@query("load_object", f"""WITH {SQL_CAL}, {fx.SQL_LEVEL}, {fx.SQL_REGISTRY},
lv AS MATERIALIZED (SELECT level.*, r.calendar, r.category FROM level JOIN registry r USING (asset)),
q AS (SELECT * FROM (SELECT asset, calendar, date, value AS price, lag(date) OVER w AS prev_date, value / lag(value) OVER w - 1.0 AS ret FROM lv l
  WHERE category = 'price_change' AND {WIN} AND {NOT_SHUT} WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE ret IS NOT NULL)
SELECT q.asset, q.date, q.prev_date, {sg.rnd('q.ret', 7)} AS ret, {_GAP} AS gap_trading_days, 'price' AS kind FROM q {_RJOIN}
UNION ALL SELECT asset, date, prev_date, {sg.rnd('value', 7)}, 1, 'factor' FROM (SELECT asset, date, lag(date) OVER (PARTITION BY asset ORDER BY date) AS prev_date, value FROM lv WHERE category = 'return') WHERE {WIN}""")
def load_object(spark, sf):
    """Window-internal convention: no close from before the window is used."""
    s = rt.sample_returns(fx.level_daily(spark, sf), fx.registry(spark), calendar(spark, sf), START, END, prior_close=False)
    return s.select("asset", "date", "prev_date", r("ret", 7).alias("ret"), "gap_trading_days", "kind")


@query("period_slice", f"""WITH {SQL_LV} SELECT asset, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM lv WHERE {WIN} GROUP BY asset""")
def period_slice(spark, sf):
    return rt.period_slice(level(spark, sf), START, END).groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


SQL_RET = f"{SQL_BOTH}, {_lagged(f"date BETWEEN DATE '{DEV_START}' AND DATE '{DEV_END}'")}, ret AS MATERIALIZED (SELECT asset, date, prev_date, price, ret, year(date) AS yr FROM q)"


def dev_returns(spark, sf):
    """Clean returns of every asset over the development years."""
    cal = calendar(spark, sf)
    return rt.simple_returns(rt.clean_prices(level(spark, sf), cal, DEV_START, DEV_END), cal)


_ORIG = ("2019-12-31", "2021-06-30")


@query("as_of_cut", f"""{SQL_RET} SELECT asset, o AS origin, count(*) AS n, max(date) AS last_date, {sg.rnd('sum(ret)', 7)} AS sum_ret FROM ret JOIN (VALUES {', '.join(f"(DATE '{o}')" for o in _ORIG)}) v(o) ON date <= o GROUP BY asset, o""")
def as_of_cut(spark, sf):
    o = spark.createDataFrame([(x,) for x in _ORIG], "o string").select(F.to_date("o").alias("origin"))
    return rt.as_of_cut(dev_returns(spark, sf), o).groupBy("asset", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"), r(F.sum("ret"), 7).alias("sum_ret"))


SQL_WF = f"""wf AS (SELECT CAST(y AS INTEGER) AS eval_year, rule, CASE rule WHEN 'rolling3y' THEN make_date(y - 3, 1, 1) ELSE DATE '{DEV_START}' END AS start, make_date(y - 1, 12, 31) AS stop
  FROM (VALUES {', '.join(f'({y})' for y in YEARS)}) a(y) CROSS JOIN (VALUES ('rolling3y'), ('expanding')) b(rule))"""


@query("walk_forward_windows", f"""{SQL_RET}, {SQL_WF}
SELECT eval_year, rule, start AS window_start, stop AS window_end, asset, count(*) AS n FROM wf JOIN ret ON date BETWEEN start AND stop GROUP BY ALL""")
def walk_forward_windows(spark, sf):
    w = rt.walk_forward_windows(spark, YEARS, DEV_START, DEV_END)
    return rt.assign_periods(dev_returns(spark, sf), w).groupBy(
        "eval_year", "rule", F.col("start").alias("window_start"), F.col("end").alias("window_end"), "asset").agg(F.count(F.lit(1)).alias("n"))


@query("scale_from_window", f"""{SQL_RET}, {SQL_WF}
SELECT eval_year, rule, asset, count(*) AS n, {sg.rnd('stddev_samp(ret) * sqrt(252)', 8)} AS sigma_annual FROM wf JOIN ret ON date BETWEEN start AND stop GROUP BY eval_year, rule, asset""")
def scale_from_window(spark, sf):
    w = rt.walk_forward_windows(spark, YEARS, DEV_START, DEV_END)
    s = rt.window_scale(rt.assign_periods(dev_returns(spark, sf), w), ["eval_year", "rule", "asset"])
    return s.select("eval_year", "rule", "asset", "n", r("sigma_annual", 8).alias("sigma_annual"))


@query("compare_return_sources", f"""{SQL_BOTH}, {_lagged(WIN)}, {_lagged(_RUNUP).replace('q AS', 'q2 AS')}, nw AS (SELECT * FROM q2 WHERE date >= DATE '{START}')
SELECT coalesce(q.asset, nw.asset) AS asset, count(q.ret) AS n_old, count(nw.ret) AS n_new, count(*) FILTER (WHERE q.ret IS NOT NULL AND nw.ret IS NOT NULL) AS n_shared, count(*) FILTER (WHERE q.ret IS NULL) AS rows_added, count(*) FILTER (WHERE nw.ret IS NULL) AS rows_dropped,
  {sg.rnd('max(abs(q.ret - nw.ret))')} AS max_abs_diff, {sg.rnd('stddev_samp(q.ret) * sqrt(252)', 8)} AS scale_old, {sg.rnd('stddev_samp(nw.ret) * sqrt(252)', 8)} AS scale_new
FROM q FULL JOIN nw ON q.asset = nw.asset AND q.date = nw.date GROUP BY 1""")
def compare_return_sources(spark, sf):
    lv, cal = level(spark, sf), calendar(spark, sf)
    c = rt.compare_sources(rt.returns_from_prices(lv, cal, START, END, prior_close=False), rt.returns_from_prices(lv, cal, START, END))
    return c.select("asset", "n_old", "n_new", "n_shared", "rows_added", "rows_dropped", r("max_abs_diff").alias("max_abs_diff"),
                    r("scale_old", 8).alias("scale_old"), r("scale_new", 8).alias("scale_new"))
