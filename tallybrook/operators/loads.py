"""Loading: keys, upserts, resumable work, and document text put together."""

from __future__ import annotations

from ..functions.scalar import spaced
from ..plans.layer import Dialect, view


@view("lake_scan")
def _(d: Dialect) -> str:
    return "SELECT 'complaints' AS name, count(*) AS n FROM complaints UNION ALL SELECT 'action_history' AS name, count(*) AS n FROM action_history UNION ALL SELECT 'grievance_redactions' AS name, count(*) AS n FROM grievance_redactions"


@view("insert_ignore")
def _(d: Dialect) -> str:
    """New rows for keys that the target doesn't have, one a key."""
    return """
SELECT ticket_no, id FROM (SELECT a.ticket_no, a.id, row_number() OVER (PARTITION BY a.ticket_no ORDER BY a.id) AS k FROM action_history a WHERE a.ticket_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM complaints c WHERE c.ticket_no = a.ticket_no AND c.status = 'Disposed')) x WHERE k = 1"""


@view("unique_action_key")
def _(d: Dialect) -> str:
    """The first row of each (ticket, by, status, remark) key, where nulls are equal; the date isn't part of it."""
    key = f"coalesce(ticket_no, ''), action_taken_by, coalesce(action_status, ''), {d.sha256('coalesce(action_taken_remark, ' + chr(39) * 2 + ')')}"
    return f"SELECT id, ticket_no FROM (SELECT a.id, a.ticket_no, row_number() OVER (PARTITION BY {key} ORDER BY id) AS k FROM action_history a) x WHERE k = 1"


@view("upsert_complaints")
def _(d: Dialect) -> str:
    return """
SELECT coalesce(n.ticket_no, o.ticket_no) AS ticket_no, coalesce(n.status, o.status) AS status, CASE WHEN o.ticket_no IS NULL THEN 'insert' WHEN n.ticket_no IS NULL THEN 'keep' WHEN n.status IS DISTINCT FROM o.status THEN 'update' ELSE 'same' END AS change
FROM (SELECT ticket_no, status FROM complaints WHERE mode_id <> 3) o FULL OUTER JOIN (SELECT ticket_no, CASE WHEN dept_id = 2 THEN 'Reopened' ELSE status END AS status FROM complaints WHERE mode_id <> 5) n ON n.ticket_no = o.ticket_no"""


@view("document_rollup")
def _(d: Dialect) -> str:
    return "SELECT source AS tracking_id, min('T' || lpad(doc_id::string, 8, '0')) AS ticket_no, count(*) AS documents FROM documents GROUP BY source"


@view("page_to_document")
def _(d: Dialect) -> str:
    """The relevant turns of a conversation in order, as one text with blank lines between, and the roles as first seen."""
    return f"SELECT conv_id, {d.text_agg('text', ' | ', 'turn')} AS body, count(*) AS parts, min(turn) AS first_turn FROM conversations WHERE role <> 'system' AND text IS NOT NULL GROUP BY conv_id"


@view("grievance_plus_pages")
def _(d: Dialect) -> str:
    return "SELECT c.ticket_no, concat_ws(' ', nullif(trim(c.category), ''), nullif(trim(c.subcategory), ''), nullif(trim(r.grievance_redacted), '')) AS body FROM complaints c JOIN grievance_redactions r ON r.ticket_no = c.ticket_no"


@view("page_type_class")
def _(d: Dialect) -> str:
    return "SELECT page_id, CASE WHEN html LIKE '%<article%' THEN 'article' WHEN html LIKE '%<p%' THEN 'text' ELSE 'other' END AS kind, CASE WHEN html LIKE '%<article%' OR html LIKE '%<p%' THEN 1 ELSE 0 END AS relevant FROM pages"


@view("shard")
def _(d: Dialect) -> str:
    return "SELECT ticket_no, ((row_number() OVER (ORDER BY ticket_no) - 1) % 8)::bigint AS shard FROM complaints"


@view("shard_sizes")
def _(d: Dialect) -> str:
    return "SELECT mode_id % 8 AS shard, count(*) AS n FROM complaints GROUP BY 1"


@view("pending_resume")
def _(d: Dialect) -> str:
    """Rows without current output: none, or one of another version."""
    return "SELECT c.ticket_no FROM complaints c WHERE NOT EXISTS (SELECT 1 FROM grievance_redactions r WHERE r.ticket_no = c.ticket_no AND r.analyzer_version = 'v1')"


@view("document_pending")
def _(d: Dialect) -> str:
    """Pages with an address that weren't downloaded: without html."""
    return "SELECT page_id, url FROM pages WHERE url IS NOT NULL AND upper(url) <> 'N/A' AND coalesce(trim(html), '') = ''"


@view("api_freshness")
def _(d: Dialect) -> str:
    """Cases to fetch again: never fetched, or the last success over seven days before the last event of all; with fewer
    than three errors since."""
    return f"""
SELECT ticket, last_seen, errors
FROM (SELECT e.ticket, l.last_seen, count(*) FILTER (WHERE e.status = 'error' AND (l.last_seen IS NULL OR e.date > l.last_seen)) AS errors
      FROM case_events e JOIN (SELECT ticket, max(date) FILTER (WHERE status <> 'error') AS last_seen FROM case_events GROUP BY ticket) l ON l.ticket = e.ticket
      GROUP BY e.ticket, l.last_seen) x
WHERE errors < 3 AND (last_seen IS NULL OR {d.days("(SELECT max(date) FROM case_events)", "last_seen")} > 7)"""


@view("min_ticket_map")
def _(d: Dialect) -> str:
    return "SELECT a.id, m.ticket_no AS canonical FROM action_history a JOIN complaints c ON c.ticket_no = a.ticket_no JOIN (SELECT petitioner_name, min(ticket_no) AS ticket_no FROM complaints GROUP BY petitioner_name) m ON m.petitioner_name = c.petitioner_name"


@view("column_denylist")
def _(d: Dialect) -> str:
    return "SELECT page_id, url FROM pages"


@view("row_validation")
def _(d: Dialect) -> str:
    """Rows that hold, with the reason for those that don't."""
    return "SELECT CASE WHEN ticket_no IS NULL THEN 'no ticket' WHEN action_taken_date IS NULL THEN 'no date' WHEN action_taken_remark IS NULL THEN 'no remark' ELSE 'ok' END AS verdict, count(*) AS n FROM action_history GROUP BY 1"


@view("label_norm")
def _(d: Dialect) -> str:
    return f"SELECT DISTINCT subcategory, {spaced(d, 'subcategory')} AS label FROM complaints"


@view("hash_split")
def _(d: Dialect) -> str:
    """By the sha256 of the id: 3 of 10 are held out."""
    return f"SELECT ticket_no, {d.hash_bits('ticket_no')} % 10 < 3 AS held_out FROM complaints"


@view("group_split")
def _(d: Dialect) -> str:
    h = f"({d.hash_bits(chr(39) + 'salt:' + chr(39) + ' || petitioner_name')} % 100)"
    return f"SELECT petitioner_name, CASE WHEN {h} < 70 THEN 'train' WHEN {h} < 80 THEN 'validation' ELSE 'test' END AS split FROM (SELECT DISTINCT petitioner_name FROM complaints) x"


@view("opaque_id")
def _(d: Dialect) -> str:
    return f"SELECT ticket_no, {d.sha256(chr(39) + 'salt|ticket|' + chr(39) + ' || ticket_no')} AS opaque FROM complaints"


@view("record_digest")
def _(d: Dialect) -> str:
    fields = "concat_ws('|', ticket_no, created_on::string, coalesce(status, '~'), coalesce(category, '~'), coalesce(district, '~'))"
    return f"SELECT ticket_no, {d.sha256(fields)} AS digest FROM complaints"


@view("scope_digest")
def _(d: Dialect) -> str:
    return f"SELECT c.district, count(*) AS members, {d.sha256(d.text_agg('r.digest', ',', 'r.ticket_no'))} AS digest FROM record_digest r JOIN complaints c ON c.ticket_no = r.ticket_no GROUP BY c.district"


@view("source_reconciliation")
def _(d: Dialect) -> str:
    return "SELECT CASE WHEN r.ticket_no IS NULL THEN 'no text' WHEN c.ticket_no IS NULL THEN 'no case' ELSE 'both' END AS state, count(*) AS n FROM complaints c FULL OUTER JOIN grievance_redactions r ON r.ticket_no = c.ticket_no GROUP BY 1"


@view("scope_guard")
def _(d: Dialect) -> str:
    """Petitioners with cases in a district and outside it."""
    return "SELECT DISTINCT a.petitioner_name FROM complaints a WHERE a.category = 'BUILDING' AND EXISTS (SELECT 1 FROM complaints b WHERE b.petitioner_name = a.petitioner_name AND b.category <> 'BUILDING')"


@view("ticket_from_path")
def _(d: Dialect) -> str:
    return f"SELECT page_id, {d.extract('url', '://[^/]+/[a-z]+/([0-9]+)', 1)} AS ticket FROM pages"


@view("stacked_populations")
def _(d: Dialect) -> str:
    return "SELECT 'all' AS population, status, count(*) AS n FROM complaints GROUP BY status UNION ALL SELECT 'routed' AS population, status, count(*) AS n FROM complaints WHERE dept_id <> 0 GROUP BY status"


@view("slice_filter")
def _(d: Dialect) -> str:
    return "SELECT c.ticket_no, c.district FROM complaints c JOIN grievance_redactions r ON r.ticket_no = c.ticket_no WHERE c.district = 'FRANCE' AND c.created_year = 1996 AND r.grievance_redacted IS NOT NULL"


@view("membership_equal")
def _(d: Dialect) -> str:
    return "SELECT count(*) AS differences FROM ((SELECT ticket_no FROM complaints WHERE dept_id = 1 EXCEPT SELECT ticket_no FROM grievance_base WHERE dept = 'dept 1') UNION ALL (SELECT ticket_no FROM grievance_base WHERE dept = 'dept 1' EXCEPT SELECT ticket_no FROM complaints WHERE dept_id = 1)) x"


@view("artifact_upsert")
def _(d: Dialect) -> str:
    """The latest version of each key after a second load."""
    return "SELECT page_id, url, version FROM (SELECT x.*, row_number() OVER (PARTITION BY page_id ORDER BY version DESC) AS k FROM (SELECT page_id, url, 1 AS version FROM pages UNION ALL SELECT page_id, url || '#new' AS url, 2 AS version FROM pages WHERE page_id % 4 = 0) x) y WHERE k = 1"
