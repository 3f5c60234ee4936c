"""The published release: open and closed cases, pages of a queue, facets, funnel."""

from __future__ import annotations

from ..functions.scalar import count_if, share
from ..plans.layer import Dialect, view
from .journey import PHASES


@view("as_of")
def _(d: Dialect) -> str:
    return "SELECT greatest((SELECT max(created_on) FROM complaints), (SELECT max(resolved_on) FROM complaints WHERE status = 'Disposed'), (SELECT max(action_taken_date) FROM action_history)) AS snapshot"


@view("status_counts")
def _(d: Dialect) -> str:
    return "SELECT entry_route, year, outcome, count(*) AS cases FROM grievance_base GROUP BY entry_route, year, outcome"


@view("open_actions")
def _(d: Dialect) -> str:
    return "SELECT o.ticket_no, o.id, o.action_taken_date, o.code, (row_number() OVER (PARTITION BY o.ticket_no ORDER BY o.action_taken_date, o.id))::bigint AS seq FROM acting_office o JOIN grievance_base g ON g.ticket_no = o.ticket_no WHERE g.outcome = 'Open' AND o.action_taken_date IS NOT NULL"


@view("open_base")
def _(d: Dialect) -> str:
    return "SELECT ticket_no, count(DISTINCT code) AS offices, max(action_taken_date) AS last_date, max_by(code, lpad(seq::string, 12, '0')) FILTER (WHERE code IS NOT NULL) AS current_office FROM open_actions GROUP BY ticket_no"


@view("open_cases")
def _(d: Dialect) -> str:
    return f"""
SELECT g.ticket_no, g.district, g.category, g.year, g.entry_route, greatest({d.days("a.snapshot", "g.created_on")}, 0) AS days_open,
       coalesce(o.offices, 0) <= 1 AS awaiting_assignment, o.current_office, greatest({d.days("a.snapshot", "o.last_date")}, 0) AS days_at_current
FROM grievance_base g CROSS JOIN as_of a LEFT JOIN open_base o ON o.ticket_no = g.ticket_no WHERE g.outcome = 'Open'"""


@view("dash_queue")
def _(d: Dialect) -> str:
    return "SELECT ticket_no, district, days_open, awaiting_assignment, current_office FROM open_cases ORDER BY awaiting_assignment DESC, days_open DESC, ticket_no LIMIT 50"


@view("history_page")
def _(d: Dialect) -> str:
    return """
SELECT p.ticket_no, p.created_on, p.district, p.category, t.total
FROM (SELECT ticket_no, created_on, district, category FROM complaints WHERE lower(coalesce(category, '')) = 'building' AND lower(ticket_no) LIKE '%1%' ORDER BY created_on DESC NULLS LAST, ticket_no LIMIT 20 OFFSET 20) p
CROSS JOIN (SELECT count(*) AS total FROM complaints WHERE lower(coalesce(category, '')) = 'building' AND lower(ticket_no) LIKE '%1%') t"""


@view("null_safe_facet")
def _(d: Dialect) -> str:
    return "SELECT count(*) AS cases, count(DISTINCT district) AS districts FROM complaints WHERE category IS NOT DISTINCT FROM NULL"


@view("age_buckets")
def _(d: Dialect) -> str:
    return f"SELECT district, {count_if('days_open BETWEEN 0 AND 30')} AS d0_30, {count_if('days_open BETWEEN 31 AND 60')} AS d31_60, {count_if('days_open >= 61')} AS d61_up, count(*) AS cases FROM open_cases GROUP BY district"


@view("dash_status")
def _(d: Dialect) -> str:
    return f"SELECT year, {count_if(chr(39) + 'Open' + chr(39) + ' = outcome')} AS open_cases, {count_if('is_disposed')} AS disposed, {count_if(chr(39) + 'Discarded' + chr(39) + ' = outcome')} AS discarded, count(*) AS filed FROM grievance_base GROUP BY year"


@view("dash_live")
def _(d: Dialect) -> str:
    return f"SELECT count(*) AS open_cases, {count_if('awaiting_assignment')} AS awaiting, {d.percentile('days_open', 0.5)} AS median_days_open, max(days_open) AS oldest FROM open_cases"


@view("dash_facets")
def _(d: Dialect) -> str:
    """Each facet counts under the other facets' filter only."""
    return """
SELECT 'district' AS facet, coalesce(district, 'Not stated') AS value, count(*) AS cases FROM open_cases WHERE category = 'BUILDING' GROUP BY 2
UNION ALL SELECT 'category' AS facet, coalesce(category, 'Not stated') AS value, count(*) AS cases FROM open_cases WHERE district = 'FRANCE' GROUP BY 2"""


@view("dash_timeline")
def _(d: Dialect) -> str:
    """An open case's stays: from filing to its first action, then from each action to the next, the last to the snapshot."""
    return f"""
SELECT g.ticket_no, 0 AS seq, 'Filed' AS office, greatest({d.days("o.action_taken_date", "g.created_on")}, 0) AS days FROM grievance_base g JOIN open_actions o ON o.ticket_no = g.ticket_no WHERE o.seq = 1
UNION ALL SELECT x.ticket_no, x.seq::int AS seq, x.code AS office, greatest({d.days("coalesce(x.next_date, a.snapshot)", "x.action_taken_date")}, 0) AS days
FROM (SELECT o.*, lead(o.action_taken_date) OVER (PARTITION BY o.ticket_no ORDER BY o.seq) AS next_date FROM open_actions o) x CROSS JOIN as_of a"""


@view("disposed_phases")
def _(d: Dialect) -> str:
    return "SELECT p.*, r.rungs AS route FROM phases p JOIN route r ON r.ticket_no = p.ticket_no"


@view("dash_disposed")
def _(d: Dialect) -> str:
    return f"SELECT route, count(*) AS cases, {', '.join(f'{d.number(f"avg({p})")} AS {p}' for p in PHASES)} FROM disposed_phases GROUP BY route"


@view("dash_routes")
def _(d: Dialect) -> str:
    return "SELECT route, cases FROM (SELECT route, count(*) AS cases FROM disposed_phases GROUP BY route) x ORDER BY cases DESC, route LIMIT 10"


@view("years_meta")
def _(d: Dialect) -> str:
    return f"SELECT year, fy_start, min(created_on) AS first_filing, max(created_on) AS last_filing, {d.days('max(created_on)', 'min(created_on)')} < 360 AS part_year FROM grievance_base GROUP BY year, fy_start"


@view("entry_groups")
def _(d: Dialect) -> str:
    return "SELECT CASE WHEN office = 'Departments' THEN 'direct' WHEN office = 'Office of Chief Minister' THEN 'chief minister' WHEN office IS NOT NULL THEN 'other office' ELSE 'not recorded' END AS entry_group, count(*) AS cases FROM grievance_base GROUP BY 1"


@view("funnel_counts")
def _(d: Dialect) -> str:
    return f"""
SELECT count(*) AS s0, {count_if("is_routed")} AS s1, {count_if("is_routed AND is_disposed")} AS s2, {count_if("is_routed AND g.days_to_close IS NOT NULL")} AS s3, {count_if("is_routed AND g.days_to_close IS NOT NULL AND b.ticket_no IS NOT NULL")} AS p0,
       {count_if("is_routed AND g.days_to_close IS NOT NULL AND p.ticket_no IS NOT NULL")} AS p1
FROM grievance_base g LEFT JOIN phase_bounds b ON b.ticket_no = g.ticket_no LEFT JOIN phases p ON p.ticket_no = g.ticket_no"""


@view("funnel_steps")
def _(d: Dialect) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS step, '{c}' AS name, {c} AS cases FROM funnel_counts" for i, c in enumerate(("s0", "s1", "s2", "s3", "p0", "p1")))
    return f"SELECT step, name, cases, {d.number('1e2 * cases / nullif(lag(cases) OVER (ORDER BY step), 0)')} AS pct_of_previous FROM ({rows}) x"


@view("unpivot_scalars")
def _(d: Dialect) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::bigint AS value FROM closure_summary" for c in ("resolved_complaints", "ladder_closures", "bare", "with_action", "benefit", "off_ladder"))


@view("pivot_population")
def _(d: Dialect) -> str:
    return f"SELECT channel, {', '.join(count_if(f'outcome = {chr(39)}{o}{chr(39)}') + ' AS ' + o.lower().replace(' ', '_') for o in ('Disposed with benefit', 'Disposed', 'Discarded', 'Open'))} FROM grievance_base GROUP BY channel"


@view("phase_loss")
def _(d: Dialect) -> str:
    return f"""
SELECT kept, count(*) AS cases, {d.number("avg(days_to_close)")} AS mean_days, {d.percentile("days_to_close", 0.5)} AS median_days
FROM (SELECT g.days_to_close, CASE WHEN p.ticket_no IS NOT NULL THEN 'tiled' WHEN b.ticket_no IS NOT NULL THEN 'bounded only' ELSE 'no bounds' END AS kept
      FROM grievance_base g LEFT JOIN phase_bounds b ON b.ticket_no = g.ticket_no LEFT JOIN phases p ON p.ticket_no = g.ticket_no WHERE g.days_to_close IS NOT NULL) x
GROUP BY kept"""


@view("release_guard")
def _(d: Dialect) -> str:
    return f"SELECT abs({' + '.join(f'avg({p})' for p in PHASES)} - avg(days_to_close)) <= 0.01 AS consistent FROM phases"


@view("density_clip")
def _(d: Dialect) -> str:
    return f"SELECT count(*) AS kept, max(g.days_to_close) AS longest FROM grievance_base g CROSS JOIN (SELECT {d.percentile('days_to_close', 0.95)} AS p95 FROM grievance_base) c WHERE g.days_to_close <= c.p95"


@view("phases_pop")
def _(d: Dialect) -> str:
    return f"SELECT g.channel, p.deepest_rung, count(*) AS cases, {d.number(share(count_if('p.went_to_review'), 'count(*)'))} AS review_pct FROM phases p JOIN grievance_base g ON g.ticket_no = p.ticket_no JOIN route r ON r.ticket_no = p.ticket_no GROUP BY g.channel, p.deepest_rung"
