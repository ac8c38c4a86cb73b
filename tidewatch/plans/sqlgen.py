"""SQL text shared by the oracle queries (parameters come from the configs)."""

from __future__ import annotations

from collections.abc import Iterable

from tidewatch.config import SUPPLIER, MonitorConfig
from tidewatch.operators.evidence import resolve


def rnd(expr: str, digits: int = 9) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def t_gap(x: str, loc1: float, loc0: float, scale2: str, nu: float) -> str:
    k = -(nu + 1.0) / 2.0
    return (f"({k!r} * (ln(1.0 + power({x} - ({loc1!r}), 2) / ({scale2} * {nu!r})) "
            f"- ln(1.0 + power({x} - ({loc0!r}), 2) / ({scale2} * {nu!r}))))")


def truncated_variance(cfg: MonitorConfig, source: str = "panel") -> str:
    """Day-by-day recursion, as a recursive CTE."""
    lam, m, c2, s2 = cfg.ewma_lambda, cfg.midpoint, cfg.truncation_c ** 2, cfg.sigma_daily ** 2
    return f""",
trunc AS (
  SELECT entity, 1 AS day, {s2!r}::DOUBLE AS v, (SELECT max(ret) FROM {source} q WHERE q.entity = p.entity AND q.day = 1) AS ret
  FROM (SELECT DISTINCT entity FROM {source}) p
  UNION ALL
  SELECT t.entity, t.day + 1, {lam!r} * t.v + {1.0 - lam!r} * least(power(t.ret - {m!r}, 2), {c2!r} * t.v), p.ret
  FROM trunc t JOIN {source} p ON p.entity = t.entity AND p.day = t.day + 1)"""


def statistics(cfg: MonitorConfig, methods: Iterable[str], source: str = "panel",
               extra: str = "", part: str = "scenario, path_set, entity") -> str:
    """CTE `wide`: one column per method, NULL before the first eligible day."""
    names = [d.name for d in resolve(methods)]
    w, sd, D = cfg.window, cfg.sigma_daily, cfg.days_per_year
    lam, m, s2 = cfg.ewma_lambda, cfg.midpoint, cfg.sigma_daily ** 2
    s, nu = cfg.sharpe_valid, cfg.student_t_df
    gap = cfg.drift_valid - cfg.drift_invalid
    trunc = any(n.startswith("ewma_trunc") for n in names)
    out = truncated_variance(cfg, source) if trunc else ""
    join = f" JOIN trunc tv ON tv.entity = p.entity AND tv.day = p.day" if trunc else ""
    tcol = ", tv.v AS v_trunc" if trunc else ""
    out += f""",
st_a AS (
  SELECT p.*{tcol},
    power({lam!r}, p.day - 1) * ({s2!r} + {1.0 - lam!r} * coalesce(sum(power(p.ret - {m!r}, 2) * power({lam!r}, -p.day))
       OVER (PARTITION BY {', '.join('p.' + x.strip() for x in part.split(','))} ORDER BY p.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS v_ewma
  FROM {source} p{join})"""
    step = {
        "binary_gaussian": f"ret / {sd!r} * {s / cfg.sqrt_days!r} - {s * s / (2.0 * D)!r}",
        "binary_student_t": t_gap(f"ret / {sd!r}", s / cfg.sqrt_days, 0.0, repr((nu - 2) / nu), nu),
        "ewma_gaussian": f"{gap!r} * (ret - {m!r}) / v_ewma",
        "ewma_student_t": t_gap("ret", cfg.drift_valid, cfg.drift_invalid,
                                f"(v_ewma * {(cfg.ewma_df - 2) / cfg.ewma_df!r})", cfg.ewma_df),
        "ewma_trunc_gaussian": f"{gap!r} * (ret - {m!r}) / v_trunc",
        "ewma_trunc_student_t": t_gap("ret", cfg.drift_valid, cfg.drift_invalid,
                                      f"(v_trunc * {(cfg.ewma_df - 2) / cfg.ewma_df!r})", cfg.ewma_df),
        "known_variance": f"{gap!r} * (ret - {m!r}) / true_var",
    }
    cols = []
    for n in names:
        if n == "trailing_sharpe":
            cols.append(f"CASE WHEN day >= {w} THEN {cfg.sqrt_days!r} * avg(ret) OVER roll "
                        f"/ nullif(stddev_samp(ret) OVER roll, 0) END AS {n}")
        elif n == "known_vol_rolling":
            cols.append(f"CASE WHEN day >= {w} THEN {cfg.sqrt_days!r} * avg(ret) OVER roll / {sd!r} END AS {n}")
        else:
            cols.append(f"{cfg.prior_log_odds!r} + sum({step[n]}) OVER run AS {n}")
    out += f""",
wide AS MATERIALIZED (
  SELECT {part}, day{extra}, {', '.join(cols)}
  FROM st_a
  WINDOW run AS (PARTITION BY {part} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         roll AS (PARTITION BY {part} ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))"""
    return out


def long_stats(methods: Iterable[str], part: str = "scenario, path_set, entity") -> str:
    """CTE `stat`: long form of `wide`."""
    names = [d.name for d in resolve(methods)]
    return ",\nstat AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {part}, day, '{n}' AS method, {n} AS stat FROM wide" for n in names) + ")"


def minima(cfg: MonitorConfig = SUPPLIER, horizon: int | None = None) -> str:
    """CTE `minima` over eligible days (ineligible days are NULL and skipped by min)."""
    return f""",
minima AS MATERIALIZED (
  SELECT scenario, path_set, entity, method, min(stat) AS min_stat
  FROM stat WHERE day <= {horizon or cfg.horizon} GROUP BY ALL)"""


def thresholds(cfg: MonitorConfig = SUPPLIER, by: str = "method", name: str = "thr",
               source: str = "minima") -> str:
    """CTE of nominal thresholds: the floor(alpha N)-th order statistic, 0-based."""
    alphas = ", ".join(f"({a!r}::DOUBLE)" for a in cfg.far_targets)
    return f""",
{name}_r AS (SELECT {by}, min_stat, row_number() OVER (PARTITION BY {by} ORDER BY min_stat) AS rk,
               count(*) OVER (PARTITION BY {by}) AS n
          FROM {source} WHERE path_set = 'calibration_valid'),
{name} AS MATERIALIZED (
  SELECT {by}, far_target, n AS n_paths, rk AS rank, min_stat AS threshold
  FROM {name}_r CROSS JOIN (VALUES {alphas}) a(far_target)
  WHERE rk = least(CAST(floor(far_target * n) AS BIGINT), n - 1) + 1)"""


def first_passage(cfg: MonitorConfig = SUPPLIER, on: str = "method", horizon: int | None = None) -> str:
    """CTE `fp`: first alarm day per entity, method and budget (-1 when never)."""
    h = horizon or cfg.horizon
    using = " AND ".join(f"s.{k.strip()} = t.{k.strip()}" for k in on.split(","))
    return f""",
fp AS MATERIALIZED (
  SELECT s.scenario, s.path_set, s.entity, s.method, t.far_target, t.threshold,
         coalesce(min(CASE WHEN s.stat < t.threshold AND s.day <= {h} THEN s.day END), -1) AS tau
  FROM stat s JOIN thr t ON {using}
  GROUP BY ALL)"""


def wilson(k: str, n: str, z: float) -> tuple[str, str]:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST(nullif({n}, 0) AS DOUBLE)"
    z2 = z * z
    mid = f"(({k}/{n} + {z2!r}/(2.0*{n})) / (1.0 + {z2!r}/{n}))"
    half = (f"({z!r} / (1.0 + {z2!r}/{n}) * sqrt(({k}/{n}) * (1.0 - {k}/{n}) / {n} "
            f"+ {z2!r}/(4.0*{n}*{n})))")
    lo = f"(CASE WHEN {n} IS NULL THEN NULL WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, {mid} - {half}) END)"
    hi = f"(CASE WHEN {n} IS NULL THEN NULL WHEN {k} = {n} THEN 1.0 ELSE least(1.0, {mid} + {half}) END)"
    return lo, hi
