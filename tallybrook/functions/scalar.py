"""Scalar expressions on SQL text x, for either dialect."""

from __future__ import annotations

from ..plans.layer import Dialect

#: Modes of filing that are online.
ONLINE_MODES = (1, 5, 6, 7, 8, 9)
#: The desk of entry in words.
ENTRY_ROUTES = {
    "Departments": "Received directly by the department",
    "Office of Chief Minister": "Forwarded from the Chief Minister's Cell",
    "Collector": "Forwarded from a District Collector",
    "Chief Secretary": "Forwarded from the Chief Secretary",
    "Governor": "Forwarded from the Governor's office",
    "Superintendent of Police": "Forwarded from the police",
    "DG & IG Police": "Forwarded from the police",
}
ENTRY_UNKNOWN = "Entry point not recorded"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_quote(d: Dialect, s: str) -> str:
    """A literal; Spark takes doubled quotes as two literals joined, so it gets them escaped."""
    return "'" + s.replace("'", "\\'") + "'" if d.name == "spark" else quote(s)


def spaced(d: Dialect, x: str) -> str:
    """Lower case, white space collapsed, trimmed."""
    return f"trim({d.replace(f'lower({x})', chr(92) + 's+', ' ')})"


def remark_norm_closure(d: Dialect, x: str) -> str:
    return d.replace(spaced(d, x), r"\.+$", "")


def remark_norm_action(d: Dialect, x: str) -> str:
    return f"CASE WHEN trim(lower({x})) IN ('.', '-') THEN trim(lower({x})) ELSE {remark_norm_closure(d, x)} END"


def remark_norm_discard(d: Dialect, x: str) -> str:
    return d.replace(d.replace(f"lower(trim({x}))", r"\s+", " "), r"\.$", "")


def fiscal_start(x: str) -> str:
    """The year in which the fiscal year (from July) of date x begins."""
    return f"(extract(year FROM {x}) - CASE WHEN extract(month FROM {x}) >= 7 THEN 0 ELSE 1 END)::bigint"


def fiscal_label(start: str) -> str:
    return f"({start})::string || '-' || right(({start} + 1)::string, 2)"


def channel(x: str) -> str:
    return f"CASE WHEN {x} IN ({', '.join(map(str, ONLINE_MODES))}) THEN 'Online' ELSE 'Offline' END"


def outcome(status: str, benefitted: str) -> str:
    return f"CASE WHEN {status} = 'Disposed' AND trim(lower({benefitted})) = 'yes' THEN 'Disposed with benefit' WHEN {status} = 'Disposed' THEN 'Disposed' WHEN {status} = 'Discard' THEN 'Discarded' ELSE 'Open' END"


def entry_route(d: Dialect, x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {text_quote(d, k)} THEN {text_quote(d, v)}" for k, v in ENTRY_ROUTES.items()) + f" ELSE {text_quote(d, ENTRY_UNKNOWN)} END"


def share(part: str, whole: str) -> str:
    """Per cent as a double, null over nothing."""
    return f"1e2 * ({part}) / nullif({whole}, 0)"


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"
