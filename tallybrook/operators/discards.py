"""Discards by the reason given, and the audit of weak labels taken from them."""

from __future__ import annotations

from ..functions.scalar import count_if, remark_norm_discard, share
from ..plans.layer import Dialect, view

#: Normalised remarks by family.
FAMILIES: dict[str, tuple[str, ...]] = {
    "details_inadequate": ("complaint details inadequate", "complaint details inadequate. may file a detail grievance"),
    "documents_not_attached": ("relevant/requisite document/s not attached",),
    "case_already_taken_up": ("case already taken up for examination", "case taken up earlier hence closed"),
    "no_specific_grievance": ("no specific grievance", "no specific grievance. may file a detail grievance"),
    "duplicate_copy": ("duplicate copy",),
    "policy_decision_required": ("can be considered only after a policy decision is made by the government",),
    "outside_grievance_cell_purview": ("this is not within the purview of this grievance cell",),
    "address_not_given": ("detail address of the complainant not given",),
}


@view("discard_templates")
def _(d: Dialect) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{f}')" for f, ts in FAMILIES.items() for t in ts) + ") AS t(template, family)"


@view("remark_norm_discard")
def _(d: Dialect) -> str:
    return f"SELECT id, ticket_no, action_taken_date, {remark_norm_discard(d, 'action_taken_remark')} AS remark_norm FROM action_history"


@view("discard_families")
def _(d: Dialect) -> str:
    return "SELECT t.family, count(*) AS action_rows, count(DISTINCT n.ticket_no) AS tickets FROM remark_norm_discard n JOIN discard_templates t ON t.template = n.remark_norm GROUP BY t.family"


@view("discard_reconcile")
def _(d: Dialect) -> str:
    return "SELECT " + ", ".join(f"{count_if('remark_norm IN (' + ', '.join(chr(39) + t + chr(39) for t in ts) + ')')} AS {f}" for f, ts in FAMILIES.items()) + " FROM remark_norm_discard"


@view("weak_labels")
def _(d: Dialect) -> str:
    """One label a ticket: the only family that its actions name; more than one is a conflict."""
    return """
SELECT n.ticket_no, count(DISTINCT t.family) AS families, CASE WHEN count(DISTINCT t.family) = 1 THEN min(t.family) END AS label
FROM remark_norm_discard n JOIN discard_templates t ON t.template = n.remark_norm WHERE n.ticket_no IS NOT NULL GROUP BY n.ticket_no"""


@view("weak_label_audit")
def _(d: Dialect) -> str:
    return f"""
SELECT c.created_year, count(*) AS tickets, count(w.label) AS valid, {count_if("w.families > 1")} AS conflicts,
       {d.percentile(d.days("c.resolved_on", "c.created_on"), 0.5)} AS median_days
FROM weak_labels w JOIN complaints c ON c.ticket_no = w.ticket_no GROUP BY c.created_year"""


@view("office_variation")
def _(d: Dialect) -> str:
    """Total variation distance of each office's label shares from all offices', where it has ten labels."""
    return f"""
SELECT o.office, max(o.n) AS labels, {d.number("sum(abs(coalesce(x.k, 0) * 1e0 / o.n - g.k * 1e0 / g.n)) / 2")} AS total_variation
FROM (SELECT coalesce(c.office, 'none') AS office, count(*) AS n FROM weak_labels w JOIN complaints c ON c.ticket_no = w.ticket_no WHERE w.label IS NOT NULL GROUP BY 1 HAVING count(*) >= 10) o
CROSS JOIN (SELECT label, count(*) AS k, sum(count(*)) OVER () AS n FROM weak_labels WHERE label IS NOT NULL GROUP BY label) g
LEFT JOIN (SELECT coalesce(c.office, 'none') AS office, w.label, count(*) AS k FROM weak_labels w JOIN complaints c ON c.ticket_no = w.ticket_no WHERE w.label IS NOT NULL GROUP BY 1, 2) x
  ON x.office = o.office AND x.label = g.label
GROUP BY o.office"""


@view("adjudication_frame")
def _(d: Dialect) -> str:
    return f"""
SELECT c.ticket_no, min(c.district) AS district, count(t.family) AS discard_actions, min(n.action_taken_date) FILTER (WHERE t.family IS NOT NULL) AS first_discard,
       bool_or(t.family = 'duplicate_copy') AS excluded, CASE WHEN count(DISTINCT t.family) = 1 THEN min(t.family) END AS label
FROM complaints c JOIN remark_norm_discard n ON n.ticket_no = c.ticket_no LEFT JOIN discard_templates t ON t.template = n.remark_norm
GROUP BY c.ticket_no HAVING count(t.family) > 0"""


@view("discard_share")
def _(d: Dialect) -> str:
    return f"SELECT family, action_rows, {d.number(share('action_rows', 'sum(action_rows) OVER ()'))} AS share_pct FROM discard_families"
