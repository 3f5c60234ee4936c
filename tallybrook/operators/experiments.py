"""Outcomes with censoring, propensities, and policies scored off-line. Research only."""

from __future__ import annotations

from ..functions.scalar import count_if
from ..plans.layer import Dialect, view

HORIZON = 365


@view("outcome_mart")
def _(d: Dialect) -> str:
    return f"""
SELECT c.ticket_no, coalesce(c.category, 'none') AS stratum, c.district, c.dept, coalesce(r.rung, 'open') AS rung,
       CASE WHEN r.rung = 'benefit' THEN 'S' WHEN r.rung IS NOT NULL THEN 'C' ELSE 'open' END AS state, CASE WHEN c.resolved_on IS NULL THEN 0 ELSE 1 END AS event,
       least(greatest({d.days("coalesce(c.resolved_on, a.snapshot)", "c.created_on")}, 0), {HORIZON}) AS observed_days, {d.days("coalesce(c.resolved_on, a.snapshot)", "c.created_on")} > {HORIZON} AS capped
FROM complaints c CROSS JOIN as_of a LEFT JOIN closure_rung r ON r.ticket_no = c.ticket_no"""


@view("outcome_snapshot_guard")
def _(d: Dialect) -> str:
    return f"SELECT a.snapshot, {count_if('c.created_on > a.snapshot')} AS filed_after FROM complaints c CROSS JOIN as_of a GROUP BY a.snapshot"


@view("km_censoring")
def _(d: Dialect) -> str:
    """Per stratum the Kaplan-Meier curve of censoring: at each time the hazard of being censored, and what is left."""
    return f"""
SELECT stratum, t, at_risk, censored, {d.number("exp(sum(ln(greatest(1 - censored * 1e0 / at_risk, 1e-12))) OVER (PARTITION BY stratum ORDER BY t))")} AS g
FROM (SELECT stratum, observed_days AS t, {count_if("event = 0")} AS censored, sum(count(*)) OVER (PARTITION BY stratum ORDER BY observed_days DESC)::bigint AS at_risk FROM outcome_mart GROUP BY stratum, observed_days) x"""


@view("ipcw")
def _(d: Dialect) -> str:
    """Weights 1 / G just before the time observed, at most 20. Cases still open at the horizon are known as well: only rows
    censored before it weigh nothing."""
    return f"""
SELECT ticket_no, stratum, observed_days, event, {d.number(f"CASE WHEN event = 1 OR observed_days >= {HORIZON} THEN 1 / greatest(coalesce(g, 1), 0.05) ELSE 0 END")} AS weight
FROM (SELECT o.ticket_no, o.stratum, o.observed_days, o.event, k.g_before AS g FROM outcome_mart o
      JOIN (SELECT stratum, t, lag(g) OVER (PARTITION BY stratum ORDER BY t) AS g_before FROM km_censoring) k ON k.stratum = o.stratum AND k.t = o.observed_days) x"""


@view("restricted_mean")
def _(d: Dialect) -> str:
    return f"SELECT stratum, {d.number('sum(weight * observed_days) / nullif(sum(weight), 0)')} AS restricted_mean, {d.number('sum(weight) * sum(weight) / nullif(sum(weight * weight), 0)')} AS ess FROM ipcw GROUP BY stratum"


@view("propensity")
def _(d: Dialect) -> str:
    """The share of a department in its cell, in all cases where the cell is small, within 0.01 and 0.99."""
    return f"""
SELECT c.category, c.district, c.dept, c.weight, {d.number("greatest(least(CASE WHEN c.total >= 30 THEN c.weight * 1e0 / c.total ELSE m.p END, 0.99), 0.01)")} AS propensity
FROM (SELECT category, district, dept, sum(weight)::bigint AS weight, sum(sum(weight)) OVER (PARTITION BY category, district) AS total FROM route_cells GROUP BY category, district, dept) c
JOIN (SELECT dept, sum(weight) * 1e0 / sum(sum(weight)) OVER () AS p FROM route_cells GROUP BY dept) m ON m.dept = c.dept"""


@view("eligible_sets")
def _(d: Dialect) -> str:
    return "SELECT category, district, dept, weight, k::bigint AS k FROM (SELECT p.*, row_number() OVER (PARTITION BY category, district ORDER BY weight DESC, dept) AS k FROM propensity p WHERE weight >= 10) x WHERE k <= 3"


@view("dept_effect")
def _(d: Dialect) -> str:
    return f"SELECT dept, {d.number('avg(observed_days)')} AS mu, count(*) AS n FROM outcome_mart WHERE dept IS NOT NULL GROUP BY dept"


@view("greedy_policy")
def _(d: Dialect) -> str:
    """Of a cell's eligible departments the fastest with a propensity of 0.1; else the likeliest."""
    return """
SELECT category, district, dept FROM (
  SELECT e.category, e.district, e.dept, row_number() OVER (PARTITION BY e.category, e.district ORDER BY CASE WHEN p.propensity >= 0.1 THEN 0 ELSE 1 END, CASE WHEN p.propensity >= 0.1 THEN m.mu ELSE -p.propensity END, e.dept) AS k
  FROM eligible_sets e JOIN propensity p ON p.category = e.category AND p.district = e.district AND p.dept = e.dept JOIN dept_effect m ON m.dept = e.dept) x WHERE k = 1"""


@view("augmented_score")
def _(d: Dialect) -> str:
    """The policy's mean by the model, corrected by the weighted residuals of the cases that it would have sent the same way."""
    return f"""
SELECT {d.number("avg(mu) + sum(w * (y - mu_obs)) / nullif(sum(w), 0)")} AS value, {d.number("avg(mu)")} AS direct, count(*) AS n
FROM (SELECT m.mu, o.mu AS mu_obs, f.observed_days AS y, CASE WHEN f.dept = g.dept THEN 1 / p.propensity ELSE 0 END AS w
      FROM outcome_mart f JOIN greedy_policy g ON g.category = f.stratum AND g.district = f.district JOIN dept_effect m ON m.dept = g.dept JOIN dept_effect o ON o.dept = f.dept
      JOIN propensity p ON p.category = f.stratum AND p.district = f.district AND p.dept = f.dept) x"""


@view("overlap_quantiles")
def _(d: Dialect) -> str:
    return f"SELECT {d.number(d.percentile('propensity', 0.05))} AS p05, {d.number(d.percentile('propensity', 0.5))} AS p50, {d.number(d.percentile('propensity', 0.95))} AS p95, {count_if('propensity < 0.05')} AS thin FROM propensity"


@view("duan_smearing")
def _(d: Dialect) -> str:
    return f"""
SELECT stratum, CASE WHEN count(*) >= 50 THEN {d.number("avg(exp(r))")} ELSE {d.number("max(pooled)")} END AS factor
FROM (SELECT stratum, r, avg(exp(r)) OVER () AS pooled FROM (SELECT stratum, ln(1 + observed_days) - avg(ln(1 + observed_days)) OVER (PARTITION BY stratum) AS r FROM outcome_mart WHERE event = 1) x) y
GROUP BY stratum"""


@view("frontier_sweep")
def _(d: Dialect) -> str:
    return f"SELECT tau::double AS tau, {count_if('propensity >= tau')} AS feasible, count(*) AS cells FROM propensity CROSS JOIN (SELECT * FROM (VALUES (0.01), (0.05), (0.1), (0.2)) AS g(tau)) g GROUP BY tau"


@view("remark_bucket")
def _(d: Dialect) -> str:
    return "SELECT coalesce(l.rung, 'other') AS bucket, count(*) AS cases FROM outcome_closing o LEFT JOIN disposal_ladder l ON l.template = lower(o.action_taken_remark) GROUP BY 1"


@view("feature_encoder")
def _(d: Dialect) -> str:
    return "SELECT o.ticket_no, coalesce(l.code, -1)::bigint AS code FROM outcome_mart o LEFT JOIN (SELECT stratum, row_number() OVER (ORDER BY stratum) - 1 AS code FROM (SELECT DISTINCT stratum FROM outcome_mart WHERE event = 1 AND stratum <> 'none') x) l ON l.stratum = o.stratum"


@view("fold_assignment")
def _(d: Dialect) -> str:
    return "SELECT district, ((row_number() OVER (ORDER BY n DESC, district) - 1) % 5)::bigint AS fold, n FROM (SELECT district, count(*) AS n FROM outcome_mart GROUP BY district) x"
