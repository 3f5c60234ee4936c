"""How cases pass one desk and its peers."""

from __future__ import annotations

from ..functions.scalar import count_if, share
from ..plans.layer import Dialect, view
from .journey import PHASES

ROLE, PLACE = "District social security officer", "Puri"


@view("desk_entry_rows")
def _(d: Dialect) -> str:
    return f"""
SELECT entry_route, count(*) AS cases, {d.number(share("count(*)", "sum(count(*)) OVER ()"))} AS share_pct, {d.number(share(count_if("block IS NULL"), "count(*)"))} AS no_block_pct,
       {d.percentile("days_to_close", 0.5)} AS median_days, {d.number("avg(days_to_close)")} AS mean_days
FROM grievance_base GROUP BY entry_route"""


@view("desk_passed")
def _(d: Dialect) -> str:
    return f"SELECT DISTINCT ticket_no FROM office_wait WHERE role_name = '{ROLE}' AND place = '{PLACE}'"


@view("desk_pass")
def _(d: Dialect) -> str:
    return f"SELECT g.entry_route, count(*) AS cases, count(p.ticket_no) AS passed, {d.number(share('count(p.ticket_no)', 'count(*)'))} AS passed_pct FROM grievance_base g LEFT JOIN desk_passed p ON p.ticket_no = g.ticket_no GROUP BY g.entry_route"


@view("close_by_desk")
def _(d: Dialect) -> str:
    return f"SELECT p.ticket_no IS NOT NULL AS passed, count(*) AS n, {d.percentile('g.days_to_close', 0.5)} AS median_days, {d.number('avg(g.days_to_close)')} AS mean_days FROM grievance_base g LEFT JOIN desk_passed p ON p.ticket_no = g.ticket_no WHERE g.days_to_close IS NOT NULL GROUP BY 1"


@view("desk_wait")
def _(d: Dialect) -> str:
    return f"SELECT role_name, place, count(*) AS hand_offs, count(DISTINCT ticket_no) AS cases, {d.percentile('wait_days', 0.5)} AS median_wait, {d.number('avg(wait_days)')} AS mean_wait FROM office_wait GROUP BY role_name, place"


@view("peer_desks")
def _(d: Dialect) -> str:
    return f"SELECT * FROM desk_wait WHERE role_name = '{ROLE}' AND hand_offs >= 30"


@view("slowest_desks")
def _(d: Dialect) -> str:
    return "SELECT * FROM desk_wait WHERE hand_offs >= 100 ORDER BY median_wait DESC, hand_offs DESC, role_name, place LIMIT 15"


@view("first_touch")
def _(d: Dialect) -> str:
    return "SELECT ticket_no, role_name, min(action_taken_date) AS first_date, max(action_taken_date) AS last_date, count(*) AS actions FROM office_named WHERE role_name IS NOT NULL AND ticket_no IS NOT NULL AND action_taken_date IS NOT NULL GROUP BY ticket_no, role_name"


@view("legs")
def _(d: Dialect) -> str:
    return f"""
SELECT t.role_name, count(*) AS n, {d.percentile(d.days("t.first_date", "g.created_on"), 0.5)} AS filing_to_touch, {d.percentile(d.days("g.resolved_on", "t.first_date"), 0.5)} AS touch_to_close, {d.percentile("g.days_to_close", 0.5)} AS total
FROM first_touch t JOIN grievance_base g ON g.ticket_no = t.ticket_no WHERE g.days_to_close IS NOT NULL GROUP BY t.role_name"""


@view("desk_same_day")
def _(d: Dialect) -> str:
    return f"SELECT role_name, count(*) AS n, {d.number(share(count_if('first_date = last_date'), 'count(*)'))} AS same_day_pct FROM first_touch GROUP BY role_name"


@view("next_after")
def _(d: Dialect) -> str:
    return f"""
SELECT role_name, next_role, count(*) AS n, {d.percentile(d.days("next_date", "action_taken_date"), 0.5)} AS median_days
FROM (SELECT role_name, action_taken_date, lead(role_name) OVER w AS next_role, lead(action_taken_date) OVER w AS next_date FROM office_named WHERE ticket_no IS NOT NULL AND action_taken_date IS NOT NULL WINDOW w AS (PARTITION BY ticket_no ORDER BY action_taken_date, id)) x
WHERE role_name = '{ROLE}' AND next_role IS NOT NULL GROUP BY role_name, next_role HAVING count(*) >= 100"""


@view("phase_by_desk")
def _(d: Dialect) -> str:
    return f"SELECT t.ticket_no IS NOT NULL AS passed, count(*) AS cases, {', '.join(f'{d.number(f"avg(p.{x})")} AS {x}' for x in PHASES)} FROM phases p LEFT JOIN desk_passed t ON t.ticket_no = p.ticket_no GROUP BY 1"


@view("office_spread")
def _(d: Dialect) -> str:
    return f"""
SELECT role_name, count(*) AS offices, {d.number("avg(m)")} AS mean_of_means, {d.number("min(m)")} AS lowest, {d.number("max(m)")} AS highest, {d.number("stddev_samp(m)")} AS spread
FROM (SELECT o.role_name, c.district, avg(o.wait_days) AS m FROM office_wait o JOIN complaints c ON c.ticket_no = o.ticket_no GROUP BY o.role_name, c.district HAVING count(*) >= 30) x
GROUP BY role_name HAVING count(*) >= 3"""
