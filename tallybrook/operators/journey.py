"""A case's way through offices: base attributes, acting offices, steps, routes, phases of time."""

from __future__ import annotations

from ..functions.scalar import channel, count_if, entry_route, fiscal_label, fiscal_start, outcome, share, text_quote
from ..plans.layer import Dialect, view

#: Prefixes of an office's code by level of government, 1 the state's apex to 5 the field. The first match counts.
RUNGS: dict[int, tuple[str, ...]] = {
    1: ("CM Grievance Cell", "Chief Minister Office", "Office of The Governor", "Chief Secretary", "Governor"),
    2: ("Secretary ", "Director", "Directorate", "Engineer-in-Chief", "Labour Commissioner", "DGP", "President, BSE", "CEO,"),
    3: ("Collector,", "SP,", "DCP", "DEO,", "CDMO", "DLO", "DSWO", "CDAO", "DSSO", "CSO", "DWO", "DFO", "DRCS", "DRDA", "PDDRDA", "DPO", "DIC", "Commissioner, ", "R.W Division", "R&B Division"),
    4: ("Sub-Collector", "Sub-Divisional", "SDPO"),
    5: ("BDO", "ABDO", "Tehsildar", "IIC", "Executive Officer", "Sarpanch"),
}
#: The office's code before the comma, and its name.
ROLES = {
    "BDO": "Block Development Officer",
    "Tehsildar": "Tahasildar",
    "Collector": "District Collector",
    "Sub-Collector": "Sub-Collector",
    "SP": "Superintendent of Police",
    "IIC": "Police station",
    "DEO": "District education officer",
    "CDMO": "District medical officer",
    "DSSO": "District social security officer",
    "DSWO": "District social welfare officer",
    "PDDRDA": "DRDA Project Director",
    "CM Grievance Cell": "Chief Minister's Grievance Cell",
    "Secretary": "Department Secretary",
}
#: Names of offices without a role, by rung.
UNNAMED = {1: "State apex office", 2: "Department head office", 3: "District office", 4: "Sub-district office", 5: "Field office"}
PHASES = ("registration", "first_assignment", "field_action", "review", "closure")


@view("grievance_base")
def _(d: Dialect) -> str:
    fy = fiscal_start("created_on")
    return f"""
SELECT ticket_no, created_on, resolved_on, status, mode, mode_id, dept, dept_id, category, subcategory, district, block, transfer_status, office,
       {fy} AS fy_start, {fiscal_label(fy)} AS year, {channel("mode_id")} AS channel, {outcome("status", "benefitted")} AS outcome,
       coalesce(dept_id <> 0, false) AS is_routed, coalesce(status = 'Disposed', false) AS is_disposed,
       CASE WHEN status = 'Disposed' AND resolved_on >= created_on THEN {d.days("resolved_on", "created_on")} END AS days_to_close,
       {entry_route(d, "office")} AS entry_route, coalesce(office = 'Departments', false) AS received_directly
FROM complaints"""


@view("acting_office")
def _(d: Dialect) -> str:
    return f"""
SELECT id, ticket_no, action_taken_date, action_status,
       CASE WHEN {d.starts("complaint_status_with_authority", "action_status || ' - '")} THEN substr(complaint_status_with_authority, length(action_status) + 4) END AS code
FROM action_history"""


@view("acting_rung")
def _(d: Dialect) -> str:
    when = " ".join(f"WHEN {' OR '.join(d.starts('code', text_quote(d, p)) for p in ps)} THEN {k}" for k, ps in RUNGS.items())
    return f"SELECT o.*, CASE {when} END AS rung FROM acting_office o"


@view("office_named")
def _(d: Dialect) -> str:
    role = "trim(split_part(code, ',', 1))"
    when = " ".join(f"WHEN {role} = {text_quote(d, k)} THEN {text_quote(d, v)}" for k, v in ROLES.items())
    return f"SELECT r.*, {role} AS role_code, trim(split_part(code, ',', 2)) AS place, CASE {when} WHEN {d.starts(role, chr(39) + 'Secretary ' + chr(39))} THEN 'Department Secretary' END AS role_name FROM acting_rung r"


@view("compressed_steps")
def _(d: Dialect) -> str:
    """An office's consecutive actions are one step; a null office never continues one."""
    return """
SELECT ticket_no, action_taken_date, id, code, prev_code
FROM (SELECT ticket_no, action_taken_date, id, code, lag(code) OVER (PARTITION BY ticket_no ORDER BY action_taken_date, id) AS prev_code
      FROM acting_office WHERE ticket_no IS NOT NULL AND action_taken_date IS NOT NULL) s
WHERE prev_code IS NULL OR code IS NULL OR code <> prev_code"""


@view("steps")
def _(d: Dialect) -> str:
    return """
SELECT n.ticket_no, n.action_taken_date, n.id, n.code, n.rung, n.role_name, n.place, (row_number() OVER o)::bigint AS step_index, lag(n.rung) OVER o AS prev_rung,
       lag(n.action_taken_date) OVER o AS prev_date, max(n.rung) OVER t AS deepest_rung, count(*) OVER t AS n_steps, bool_or(n.rung IS NULL) OVER t AS has_unranked
FROM office_named n JOIN compressed_steps c ON c.id = n.id
WINDOW o AS (PARTITION BY n.ticket_no ORDER BY n.action_taken_date, n.id), t AS (PARTITION BY n.ticket_no)"""


@view("office_wait")
def _(d: Dialect) -> str:
    return f"""
SELECT ticket_no, role_name, place, {d.days("next_date", "action_taken_date")} AS wait_days
FROM (SELECT n.*, lead(action_taken_date) OVER (PARTITION BY ticket_no ORDER BY action_taken_date, id) AS next_date
      FROM office_named n WHERE ticket_no IS NOT NULL AND action_taken_date IS NOT NULL) x
WHERE next_date IS NOT NULL AND role_name IS NOT NULL AND place <> ''"""


@view("route")
def _(d: Dialect) -> str:
    """The levels, and the roles, of a wholly ranked case in order; repeats in a row count once, apart for each."""
    unnamed = "CASE rung " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in UNNAMED.items()) + " END"
    return f"""
SELECT x.ticket_no, {d.text_agg("CASE WHEN new_rung THEN rung::string END", ">", "step_index")} AS rungs, max(t.levels_touched) AS levels_touched,
       {d.text_agg("CASE WHEN new_role THEN role END", " > ", "step_index")} AS roles, max(t.offices_touched) AS offices_touched
FROM (SELECT ticket_no, rung, role, step_index, coalesce(rung <> lag(rung) OVER w, true) AS new_rung, coalesce(role <> lag(role) OVER w, true) AS new_role
      FROM (SELECT ticket_no, rung, step_index, coalesce(role_name, {unnamed}) AS role FROM steps WHERE NOT has_unranked) s
      WINDOW w AS (PARTITION BY ticket_no ORDER BY step_index)) x
JOIN (SELECT ticket_no, count(DISTINCT rung) AS levels_touched, count(DISTINCT coalesce(role_name, {unnamed})) AS offices_touched FROM steps WHERE NOT has_unranked GROUP BY ticket_no) t ON t.ticket_no = x.ticket_no
GROUP BY x.ticket_no"""


@view("returns")
def _(d: Dialect) -> str:
    return f"SELECT ticket_no, {count_if('rung = deepest_rung AND (prev_rung IS NULL OR prev_rung < deepest_rung)')} AS arrivals FROM steps WHERE NOT has_unranked GROUP BY ticket_no"


@view("phase_bounds")
def _(d: Dialect) -> str:
    return """
SELECT ticket_no, max(deepest_rung) AS deepest_rung, min(action_taken_date) AS first_action, max(action_taken_date) AS last_action,
       min(action_taken_date) FILTER (WHERE rung > prev_rung) AS first_routed,
       min(action_taken_date) FILTER (WHERE rung < prev_rung AND step_index > first_deepest) AS returned_up
FROM (SELECT s.*, min(CASE WHEN rung = deepest_rung THEN step_index END) OVER (PARTITION BY ticket_no) AS first_deepest FROM steps s WHERE NOT has_unranked) x
GROUP BY ticket_no"""


@view("phase_spans")
def _(d: Dialect) -> str:
    """Five spans of a disposed case; a boundary never lies before the one it follows."""
    return f"""
SELECT ticket_no, year, days_to_close, deepest_rung, went_to_review, has_handoff, {d.days("p1", "d0")} AS registration, {d.days("p2", "p1")} AS first_assignment,
       {d.days("p3", "p2")} AS field_action, {d.days("p4", "p3")} AS review, {d.days("greatest(d5, p4)", "p4")} AS closure
FROM (SELECT x.*, greatest(d4, p3) AS p4 FROM (SELECT y.*, greatest(d3, p2) AS p3 FROM (SELECT z.*, greatest(d2, p1) AS p2 FROM (
  SELECT g.ticket_no, g.year, g.days_to_close, b.deepest_rung, b.returned_up IS NOT NULL AS went_to_review, b.first_routed IS NOT NULL AS has_handoff,
         g.created_on AS d0, greatest(b.first_action, g.created_on) AS p1, coalesce(b.first_routed, b.last_action) AS d2, coalesce(b.returned_up, b.last_action) AS d3,
         b.last_action AS d4, g.resolved_on AS d5
  FROM grievance_base g JOIN phase_bounds b ON b.ticket_no = g.ticket_no WHERE g.is_disposed AND g.days_to_close IS NOT NULL) z) y) x) w"""


@view("phases")
def _(d: Dialect) -> str:
    return f"SELECT p.*, {' + '.join(PHASES)} AS span_total FROM phase_spans p WHERE {' + '.join(PHASES)} = days_to_close"


@view("phase_means")
def _(d: Dialect) -> str:
    return f"SELECT count(*) AS cases, {', '.join(f'{d.number(f"avg({p})")} AS {p}' for p in PHASES)}, {d.number('avg(days_to_close)')} AS total FROM phases"


@view("transferred")
def _(d: Dialect) -> str:
    return "SELECT DISTINCT ticket_no FROM action_history WHERE action_status = 'Forwarded' AND ticket_no IS NOT NULL"


def stats(d: Dialect, x: str) -> str:
    return f"count({x}) AS n, {d.rint(d.percentile(x, 0.5))} AS median_days, {d.number(f'avg({x})')} AS mean_days, {d.rint(d.percentile(x, 0.9))} AS p90_days"


@view("time_stats")
def _(d: Dialect) -> str:
    return f"SELECT year, {stats(d, 'days_to_close')} FROM grievance_base WHERE days_to_close IS NOT NULL GROUP BY year"


@view("office_stats")
def _(d: Dialect) -> str:
    return f"SELECT * FROM (SELECT role_name, place, {stats(d, 'wait_days')} FROM office_wait GROUP BY role_name, place) x WHERE n >= 30 ORDER BY n DESC, role_name, place LIMIT 50"


@view("level_table")
def _(d: Dialect) -> str:
    return f"""
SELECT s.rung, s.steps, s.cases, w.median_wait, w.mean_wait
FROM (SELECT rung, count(*) AS steps, count(DISTINCT ticket_no) AS cases FROM steps WHERE rung IS NOT NULL GROUP BY rung) s
JOIN (SELECT prev_rung AS rung, {d.percentile(d.days("action_taken_date", "prev_date"), 0.5)} AS median_wait, {d.number("avg(" + d.days("action_taken_date", "prev_date") + ")")} AS mean_wait
      FROM steps WHERE prev_rung IS NOT NULL GROUP BY prev_rung) w ON w.rung = s.rung"""


@view("route_top")
def _(d: Dialect) -> str:
    return f"""
SELECT r.rungs, count(*) AS cases, {d.percentile("g.days_to_close", 0.5)} AS median_days, {d.number("avg(g.days_to_close)")} AS mean_days, {d.number(share("count(*)", "sum(count(*)) OVER ()"))} AS share_pct
FROM route r JOIN grievance_base g ON g.ticket_no = r.ticket_no WHERE g.days_to_close IS NOT NULL GROUP BY r.rungs ORDER BY cases DESC, r.rungs LIMIT 20"""


@view("route_cover")
def _(d: Dialect) -> str:
    """Routes by volume until 95 per cent are covered, at most ten and with ten cases each; the rest is Other."""
    return """
SELECT CASE WHEN kept THEN rungs ELSE 'Other' END AS route, sum(n)::bigint AS cases, count(*) AS routes
FROM (SELECT rungs, n, row_number() OVER w <= 10 AND n >= 10 AND (sum(n) OVER w) - n < 0.95 * sum(n) OVER () AS kept
      FROM (SELECT rungs, count(*) AS n FROM route GROUP BY rungs) r WINDOW w AS (ORDER BY n DESC, rungs)) x
GROUP BY CASE WHEN kept THEN rungs ELSE 'Other' END"""


def _shares(name: str, column: str, floor: int = 0) -> None:
    @view(name)
    def _(d: Dialect) -> str:
        having = f" HAVING count(*) >= {floor}" if floor else ""
        return f"SELECT {column} AS grp, count(*) AS cases, {d.number(share('count(*)', 'sum(count(*)) OVER ()'))} AS share_pct FROM grievance_base GROUP BY {column}{having}"


for _n, _c, _f in (("category_share", "category", 0), ("mode_volume", "mode", 0), ("entry_share", "entry_route", 0), ("outcome_share", "outcome", 0), ("filings_by_year", "year", 0), ("channel_share", "channel", 0), ("subcategory_share", "subcategory", 10)):
    _shares(_n, _c, _f)


@view("filings_by_month")
def _(d: Dialect) -> str:
    return f"SELECT {d.month('created_on')} AS month, count(*) AS filings FROM grievance_base GROUP BY 1"


@view("subcategory_time")
def _(d: Dialect) -> str:
    return f"SELECT subcategory, {stats(d, 'days_to_close')} FROM grievance_base WHERE days_to_close IS NOT NULL GROUP BY subcategory HAVING count(*) >= 30"


@view("notebook_mode_office")
def _(d: Dialect) -> str:
    return f"""
SELECT channel, entry_route, count(*) AS cases, {d.percentile("days_to_close", 0.5)} AS median_days, {d.percentile("days_to_close", 0.9)} AS p90_days,
       {d.number(share(count_if("outcome = 'Open'"), "count(*)"))} AS still_open_pct
FROM grievance_base GROUP BY channel, entry_route"""


@view("chain_length")
def _(d: Dialect) -> str:
    return "SELECT least(n, 9) AS steps, count(*) AS cases FROM (SELECT ticket_no, count(*) AS n FROM compressed_steps GROUP BY ticket_no) x GROUP BY least(n, 9)"


@view("stage_position")
def _(d: Dialect) -> str:
    return f"SELECT role_name, {d.number('avg(step_index - 1)')} AS mean_position, count(*) AS steps FROM steps WHERE role_name IS NOT NULL GROUP BY role_name"


@view("district_spread")
def _(d: Dialect) -> str:
    return f"SELECT year, {d.percentile('m', 0.5)} AS median_of_medians, min(m) AS lowest, max(m) AS highest FROM (SELECT year, district, {d.percentile('days_to_close', 0.5)} AS m FROM grievance_base WHERE days_to_close IS NOT NULL GROUP BY year, district) x GROUP BY year"


@view("count_window")
def _(d: Dialect) -> str:
    return "SELECT ticket_no, year, district, count(*) OVER (PARTITION BY year, district) AS n FROM grievance_base"


@view("notebook_tier")
def _(d: Dialect) -> str:
    return f"""
SELECT CASE WHEN code IS NULL THEN 'Unknown' WHEN {d.starts("code", "'Secretary'")} THEN 'Department' WHEN {d.starts("code", "'Collector'")} OR {d.starts("code", "'SP,'")} THEN 'District'
            WHEN {d.starts("code", "'Sub-Collector'")} THEN 'Sub-division' WHEN {d.starts("code", "'BDO'")} OR {d.starts("code", "'Tehsildar'")} THEN 'Block' WHEN rung = 1 THEN 'State' ELSE 'Other' END AS tier, count(*) AS actions
FROM acting_rung GROUP BY 1"""


@view("outcome_closing")
def _(d: Dialect) -> str:
    return "SELECT ticket_no, action_taken_remark, action_status FROM (SELECT j.*, row_number() OVER (PARTITION BY ticket_no ORDER BY action_taken_date DESC, id DESC) AS k FROM join_inner_ticket j) x WHERE k = 1"


@view("transfer_audit")
def _(d: Dialect) -> str:
    return f"""
SELECT count(*) AS cases, count(t.ticket_no) AS with_transfer_event, {count_if("g.transfer_status = 'Transferred'")} AS flagged, {count_if("g.transfer_status = 'Transferred' AND t.ticket_no IS NOT NULL")} AS flagged_with_event,
       {count_if("g.transfer_status IS NULL AND t.ticket_no IS NOT NULL")} AS event_without_flag, {count_if("t.ticket_no IS NOT NULL AND g.is_disposed")} AS transferred_disposed, {count_if("t.ticket_no IS NULL AND g.is_disposed")} AS other_disposed,
       {d.number("avg(g.days_to_close) FILTER (WHERE t.ticket_no IS NOT NULL)")} AS transferred_mean_days, {d.number("avg(g.days_to_close) FILTER (WHERE t.ticket_no IS NULL)")} AS other_mean_days
FROM grievance_base g LEFT JOIN transferred t ON t.ticket_no = g.ticket_no"""


@view("office_divergence")
def _(d: Dialect) -> str:
    return f"SELECT office, count(*) AS cases, sum(CASE WHEN received_directly AND NOT is_routed THEN 1 ELSE 0 END)::bigint AS direct_unrouted, sum(CASE WHEN NOT received_directly AND is_routed THEN 1 ELSE 0 END)::bigint AS routed_elsewhere FROM grievance_base GROUP BY office"


@view("flow_census")
def _(d: Dialect) -> str:
    return f"""
SELECT entry_code, last_code, count(*) AS cases, {d.number("avg(n)")} AS mean_length
FROM (SELECT ticket_no, count(*) AS n, min_by(code, action_taken_date::string || lpad(id::string, 20, '0')) AS entry_code, max_by(code, action_taken_date::string || lpad(id::string, 20, '0')) AS last_code
      FROM compressed_steps WHERE code IS NOT NULL GROUP BY ticket_no) x
GROUP BY entry_code, last_code"""
