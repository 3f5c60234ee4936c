"""Personal data in texts, by shape; and the scoring of redaction spans."""

from __future__ import annotations

from ..functions.scalar import count_if
from ..plans.layer import Dialect, view

#: Shapes without look-around, so that both engines run them: the character before is part of the match.
SHAPES = {
    "mobile": r"(^|[^0-9])[6-9][0-9]{9}($|[^0-9])",
    "aadhaar": r"(^|[^0-9])[2-9][0-9]{3} [0-9]{4} [0-9]{4}($|[^0-9])",
    "pan": r"(^|[^A-Z0-9])[A-Z]{5}[0-9]{4}[A-Z]($|[^A-Z0-9])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+",
    "landline": r"(^|[^0-9])0[0-9]{2,4}-[0-9]{6,8}($|[^0-9])",
}
GOVERNMENT = ("nic.in", "gov.in", "mil.in")


@view("shaped_pii_scan")
def _(d: Dialect) -> str:
    return "SELECT ticket_no, " + ", ".join(f"{d.count_matches('grievance_redacted', p)} AS {k}" for k, p in SHAPES.items()) + " FROM grievance_redactions"


@view("pii_counts")
def _(d: Dialect) -> str:
    return "SELECT " + ", ".join(f"sum({k})::bigint AS {k}, {count_if(k + ' > 0')} AS texts_with_{k}" for k in SHAPES) + " FROM shaped_pii_scan"


@view("government_email")
def _(d: Dialect) -> str:
    domain = "lower(split_part(email, '@', 2))"
    rule = " OR ".join(f"{domain} = '{g}' OR {domain} LIKE '%.{g}'" for g in GOVERNMENT)
    return f"SELECT ticket_no, email, ({rule}) AS government FROM (SELECT ticket_no, {d.extract('grievance_redacted', SHAPES['email'], 0)} AS email FROM grievance_redactions) x WHERE email <> ''"


@view("redact_shapes")
def _(d: Dialect) -> str:
    x = "grievance_redacted"
    for name, p in (("EMAIL", SHAPES["email"]), ("PHONE", "[6-9][0-9]{9}"), ("AADHAAR", "[2-9][0-9]{3} [0-9]{4} [0-9]{4}")):
        x = d.replace(x, p, f"[{name}]")
    return f"SELECT ticket_no, length(grievance_redacted)::bigint AS before, {x} AS redacted FROM grievance_redactions"


@view("pii_spans")
def _(d: Dialect) -> str:
    """Gold and predicted spans of made-up records."""
    return """
SELECT doc_id AS record, 'gold' AS side, (doc_id % 17)::bigint AS start, (doc_id % 17 + 6)::bigint AS stop, CASE WHEN doc_id % 2 = 0 THEN 'PERSON' ELSE 'PHONE' END AS entity, lang FROM documents
UNION ALL SELECT doc_id AS record, 'predicted' AS side, (doc_id % 19)::bigint AS start, (doc_id % 19 + 5)::bigint AS stop, CASE WHEN doc_id % 3 = 0 THEN 'PERSON' ELSE 'PHONE' END AS entity, lang FROM documents WHERE doc_id % 5 <> 0"""


@view("span_scoring")
def _(d: Dialect) -> str:
    return f"""
SELECT entity, count(*) AS gold, sum(exact)::bigint AS exact, sum(overlap)::bigint AS overlap, {d.number("avg(overlap)")} AS overlap_recall, {d.number("avg(exact)")} AS exact_recall, {d.number("sum(covered) * 1e0 / sum(stop - start)")} AS coverage
FROM (SELECT g.record, g.start, g.stop, g.entity, max(CASE WHEN p.start = g.start AND p.stop = g.stop AND p.entity = g.entity THEN 1 ELSE 0 END) AS exact,
             max(CASE WHEN p.entity = g.entity THEN 1 ELSE 0 END) AS overlap, max(greatest(coalesce(least(p.stop, g.stop) - greatest(p.start, g.start), 0), 0)) AS covered
      FROM (SELECT * FROM pii_spans WHERE side = 'gold') g LEFT JOIN (SELECT * FROM pii_spans WHERE side = 'predicted') p ON p.record = g.record AND p.start < g.stop AND g.start < p.stop
      GROUP BY g.record, g.start, g.stop, g.entity) x
GROUP BY entity"""


@view("overlapping_spans")
def _(d: Dialect) -> str:
    return "SELECT a.record, a.start, a.stop, b.start AS other_start, b.stop AS other_stop FROM pii_spans a JOIN pii_spans b ON a.record = b.record AND a.start < b.stop AND b.start < a.stop WHERE a.side = 'gold' AND b.side = 'predicted'"


@view("span_language_slices")
def _(d: Dialect) -> str:
    return f"SELECT lang, count(*) AS gold FROM pii_spans WHERE side = 'gold' GROUP BY lang HAVING {count_if('true')} >= 20"


@view("span_ensemble")
def _(d: Dialect) -> str:
    return "SELECT agreement, count(*) AS spans FROM (SELECT record, start, stop, CASE WHEN count(DISTINCT side) = 2 THEN 'unanimous' ELSE 'contested' END AS agreement FROM pii_spans GROUP BY record, start, stop) x GROUP BY agreement"


@view("span_recall_report")
def _(d: Dialect) -> str:
    return f"""
SELECT entity, count(*) AS gold, {count_if("hit = 1")} AS found, {d.number("avg(hit)")} AS untyped_recall
FROM (SELECT g.record, g.start, g.entity, max(CASE WHEN p.record IS NULL THEN 0 ELSE 1 END) AS hit FROM pii_spans g LEFT JOIN (SELECT * FROM pii_spans WHERE side = 'predicted') p ON p.record = g.record AND p.start < g.stop AND g.start < p.stop
      WHERE g.side = 'gold' GROUP BY g.record, g.start, g.entity) x
GROUP BY entity"""


@view("residual_screen")
def _(d: Dialect) -> str:
    return f"SELECT ticket_no FROM grievance_redactions WHERE NOT {d.matches('grievance_redacted', '[0-9]{10}')} AND NOT {d.matches('grievance_redacted', '@')}"
