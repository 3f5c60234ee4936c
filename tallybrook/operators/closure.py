"""How cases are closed: the closing action, its rung on the disposal ladder, and what the ladder covers."""

from __future__ import annotations

from ..functions.scalar import count_if, remark_norm_closure, share
from ..plans.layer import Dialect, view

#: Normalised closing remarks, their rung, and the rung's place.
LADDER = [
    ("the grievance has been disposed", "bare", 1),
    ("the grievance has been resolved", "bare", 1),
    ("the grievance has been disposed with appropriate action", "with_action", 2),
    ("the grievance has been resolved with appropriate action", "with_action", 2),
    ("the grievance has been disposed & beneficiary benefited", "benefit", 3),
    ("the grievance has been resolved & beneficiary benefited", "benefit", 3),
]
#: A template that is off the ladder is reported from this use on; no rarer text is, as it may be a citizen's.
TEMPLATE_FLOOR = 1000


@view("disposal_ladder")
def _(d: Dialect) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{r}', {p})" for t, r, p in LADDER) + ") AS t(template, rung, ladder_position)"


@view("join_inner_ticket")
def _(d: Dialect) -> str:
    """Dated actions of resolved cases, up to the day of resolution."""
    return """
SELECT a.ticket_no, a.id, a.action_taken_date, a.action_taken_remark, a.action_status
FROM action_history a JOIN complaints c ON c.ticket_no = a.ticket_no
WHERE c.resolved_on IS NOT NULL AND a.action_taken_date <= c.resolved_on"""


@view("closing_action")
def _(d: Dialect) -> str:
    """The last of them, and how many there were."""
    return """
SELECT ticket_no, action_taken_remark, action_status, action_steps
FROM (SELECT j.*, row_number() OVER (PARTITION BY ticket_no ORDER BY action_taken_date DESC NULLS LAST, id DESC) AS back,
             count(*) OVER (PARTITION BY ticket_no) AS action_steps FROM join_inner_ticket j) x
WHERE back = 1"""


@view("join_left_closing")
def _(d: Dialect) -> str:
    return f"""
SELECT c.ticket_no, c.created_on, c.resolved_on, c.benefitted, c.category, c.district, c.dept, c.mode, c.created_year,
       a.action_status AS closing_status, {remark_norm_closure(d, "a.action_taken_remark")} AS closing_remark,
       coalesce(a.action_steps, 0) AS action_steps, {d.days("c.resolved_on", "c.created_on")} AS elapsed_days
FROM complaints c LEFT JOIN closing_action a ON a.ticket_no = c.ticket_no WHERE c.resolved_on IS NOT NULL"""


@view("closure_rung")
def _(d: Dialect) -> str:
    return """
SELECT c.*, coalesce(l.rung, 'off_ladder') AS rung, l.ladder_position, CASE WHEN l.rung IS NULL THEN 0 ELSE 1 END AS on_ladder,
       CASE WHEN action_steps = 0 THEN '0 steps' WHEN action_steps = 1 THEN '1 step' WHEN action_steps = 2 THEN '2 steps'
            WHEN action_steps < 6 THEN '3-5 steps' ELSE '6+ steps' END AS steps_bucket,
       CASE WHEN elapsed_days IS NULL THEN 'unknown' WHEN elapsed_days < 0 THEN 'invalid' WHEN elapsed_days < 3 THEN '0-2 days'
            WHEN elapsed_days < 8 THEN '3-7 days' WHEN elapsed_days < 31 THEN '8-30 days' ELSE '31+ days' END AS elapsed_bucket
FROM join_left_closing c LEFT JOIN disposal_ladder l ON l.template = c.closing_remark"""


@view("closure_summary")
def _(d: Dialect) -> str:
    bare = count_if("rung = 'bare'")
    return f"""
SELECT count(*) AS resolved_complaints, sum(on_ladder)::bigint AS ladder_closures, {bare} AS bare,
       {count_if("rung = 'with_action'")} AS with_action, {count_if("rung = 'benefit'")} AS benefit,
       {count_if("ladder_position > 1")} AS claims_action, {count_if("on_ladder = 0")} AS off_ladder,
       {d.number(share(bare, "sum(on_ladder)"))} AS bare_share_of_ladder_pct, {d.number(share(bare, "count(*)"))} AS bare_share_of_resolved_pct,
       {d.number(share("sum(on_ladder)", "count(*)"))} AS ladder_coverage_pct, {d.number(share(count_if("on_ladder = 0"), "count(*)"))} AS off_ladder_share_pct
FROM closure_rung"""


@view("closure_trajectory")
def _(d: Dialect) -> str:
    return f"""
SELECT steps_bucket, elapsed_bucket, count(*) AS resolved_complaints, sum(on_ladder)::bigint AS ladder_closures,
       {count_if("rung = 'bare'")} AS bare, {d.number(share(count_if("rung = 'bare'"), "sum(on_ladder)"))} AS bare_share_of_ladder_pct
FROM closure_rung GROUP BY steps_bucket, elapsed_bucket"""


@view("closure_two_day")
def _(d: Dialect) -> str:
    quick = count_if("rung = 'bare' AND elapsed_days BETWEEN 0 AND 2")
    return f"""
SELECT {quick} AS two_day_bare, {count_if("rung = 'bare' AND elapsed_days BETWEEN 0 AND 2 AND action_steps = 3")} AS two_day_bare_min_trajectory,
       {count_if("rung = 'bare'")} AS bare, sum(on_ladder)::bigint AS ladder_closures, count(*) AS resolved_complaints,
       {d.number(share(quick, count_if("rung = 'bare'")))} AS share_of_bare_pct, {d.number(share(quick, "sum(on_ladder)"))} AS share_of_ladder_pct,
       {d.number(share(quick, "count(*)"))} AS share_of_resolved_pct
FROM closure_rung"""


@view("closure_benefitted_overlap")
def _(d: Dialect) -> str:
    return "SELECT rung, coalesce(trim(lower(benefitted)), '(null)') AS benefitted_value, count(*) AS resolved_complaints FROM closure_rung GROUP BY 1, 2"


@view("closure_off_ladder")
def _(d: Dialect) -> str:
    return f"SELECT closing_remark, count(*) AS resolved_complaints FROM closure_rung WHERE on_ladder = 0 AND closing_remark IS NOT NULL GROUP BY closing_remark HAVING count(*) >= {TEMPLATE_FLOOR}"


@view("closure_reconciliation")
def _(d: Dialect) -> str:
    """The summary's counts by another way: the latest non-null remark by maximum instead of by rank."""
    return f"""
SELECT count(*) AS resolved_complaints, {count_if("l.rung IS NOT NULL")} AS ladder_closures, {count_if("l.rung = 'bare'")} AS bare
FROM complaints c LEFT JOIN (
  SELECT ticket_no, {remark_norm_closure(d, "max_by(action_taken_remark, action_taken_date::string || lpad(id::string, 20, '0')) FILTER (WHERE action_taken_remark IS NOT NULL)")} AS remark
  FROM join_inner_ticket GROUP BY ticket_no) a ON a.ticket_no = c.ticket_no
LEFT JOIN disposal_ladder l ON l.template = a.remark WHERE c.resolved_on IS NOT NULL"""
