"""What kind of action each row of the log is, by template, and the templates' coverage."""

from __future__ import annotations

from ..functions.scalar import remark_norm_action, share, spaced
from ..plans.layer import Dialect, view

#: Normalised remarks by type of action.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "disposed_no_claim": ("the grievance has been disposed", "the grievance has been resolved"),
    "disposed_with_action": ("the grievance has been disposed with appropriate action", "the grievance has been resolved with appropriate action"),
    "benefit_delivered": ("the grievance has been disposed & beneficiary benefited", "the grievance has been resolved & beneficiary benefited"),
    "forwarded_delegated": (
        "forwarded to concerned officer for necessary action",
        "forwarded to collector for necessary action",
        "forwarded to block development officer for necessary action",
        "forwarded to tahasildar for necessary action",
        "forwarded to executive engineer for necessary action",
        "forwarded to district level officer",
        "forwarded to concerned department",
        "forwarded to superintendent of police for necessary action",
        "delegated to concerned officer",
        "transferred to concerned authority",
    ),
    "reported_back": (
        "atr received from concerned officer",
        "compliance report received",
        "enquiry report received",
        "field enquiry report submitted",
        "action taken report furnished",
        "report received from collector",
        "report received from block development officer",
        "joint enquiry report received",
        "atr submitted by concerned officer",
        "reply received from concerned department",
    ),
    "discarded_with_reason": (
        "complaint details inadequate",
        "grievance details inadequate",
        "required documents not attached",
        "documents not attached",
        "case already taken up earlier",
        "grievance already taken up earlier",
        "no specific grievance",
        "duplicate copy of grievance",
        "duplicate grievance",
        "needs policy decision",
        "can be considered only after policy decision",
        "not within the purview of this grievance cell",
        "not within purview of this grievance cell",
        "address not given",
        "complete address not provided",
    ),
    "reopened_escalated": (
        "grievance reopened as per direction",
        "grievance reopened for re-enquiry",
        "escalated to higher authority",
        "escalated to appellate authority",
        "reopened on request of petitioner",
        "grievance reopened",
    ),
    "admin_noise": (".", "ok", "other", "pmay", "mgnrega", "bsky", "kala", "-", "na", "nil", "noted", "ଅଭିଯୋଗଟି ସମାଧାନ ହୋଇଛି"),
}
#: Remarks that mean something else under a status.
BY_STATUS = [
    ("the grievance has been disposed", ("disposed", "resolved", "closed", "forwarded", "atr received", "pending"), "disposed_no_claim"),
    ("the grievance has been resolved", ("disposed", "resolved", "closed"), "disposed_no_claim"),
    ("the grievance has been disposed with appropriate action", ("disposed", "resolved"), "disposed_with_action"),
    ("the grievance has been resolved with appropriate action", ("disposed", "resolved"), "disposed_with_action"),
    ("noted", ("forwarded",), "forwarded_delegated"),
    ("ok", ("atr received",), "reported_back"),
]


@view("action_templates")
def _(d: Dialect) -> str:
    rows = [(t, "NULL", k) for k, ts in TEMPLATES.items() for t in ts] + [(t, f"'{s}'", k) for t, ss, k in BY_STATUS for s in ss]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {s}, '{k}')" for t, s, k in rows) + ") AS t(template, status, action_type)"


@view("remark_norm_action")
def _(d: Dialect) -> str:
    return f"SELECT a.*, {remark_norm_action(d, 'action_taken_remark')} AS remark_norm, {spaced(d, 'action_status')} AS status_norm FROM action_history a"


@view("action_history_typed")
def _(d: Dialect) -> str:
    """One pass over the log: the lookup by status first, then the one for any status."""
    return """
SELECT n.id, n.ticket_no, n.action_taken_date, n.action_taken_by, n.action_status, n.remark_norm, n.status_norm,
       coalesce(s.action_type, t.action_type) AS action_type, CASE WHEN coalesce(s.action_type, t.action_type) IS NULL THEN 0 ELSE 1 END AS is_known_template
FROM remark_norm_action n LEFT JOIN (SELECT * FROM action_templates WHERE status IS NOT NULL) s ON s.template = n.remark_norm AND s.status = n.status_norm
LEFT JOIN (SELECT * FROM action_templates WHERE status IS NULL) t ON t.template = n.remark_norm"""


@view("action_type_summary")
def _(d: Dialect) -> str:
    return f"""
SELECT coalesce(action_type, 'unclassified_tail') AS action_type, count(*) AS action_rows, count(DISTINCT ticket_no) AS distinct_complaints,
       {d.number(share("count(*)", "sum(count(*)) OVER ()"))} AS share_of_actions_pct
FROM action_history_typed GROUP BY coalesce(action_type, 'unclassified_tail')"""


@view("action_type_by_status")
def _(d: Dialect) -> str:
    return "SELECT coalesce(action_status, '(null)') AS status, coalesce(action_type, 'unclassified_tail') AS action_type, count(*) AS action_rows FROM action_history_typed GROUP BY 1, 2"


@view("action_type_drift")
def _(d: Dialect) -> str:
    return "SELECT remark_norm AS template, count(*) AS action_rows FROM action_history_typed WHERE action_type IS NULL AND remark_norm <> '' GROUP BY remark_norm HAVING count(*) >= 1000"


@view("lookup_equi_left")
def _(d: Dialect) -> str:
    return "SELECT action_type, is_known_template, count(*) AS action_rows FROM action_history_typed GROUP BY 1, 2"
