"""Text and identity de-duplication: shingles, exact similarity, keys, blocks, groups."""

from __future__ import annotations

from ..functions.scalar import count_if
from ..plans.layer import Dialect, view


@view("dedup_texts")
def _(d: Dialect) -> str:
    """The benchmark items and all turns, as short texts without placeholders."""
    strip = lambda x: f"trim({d.replace(d.replace(x, r'\[[A-Z_]+\]', ' '), r'\s+', ' ')})"
    return f"SELECT 'b' || item_id::string AS item, lower({strip('text')}) AS body, 'benchmark' AS block FROM benchmark UNION ALL SELECT 'c' || conv_id::string || '-' || turn::string AS item, lower({strip('text')}) AS body, role AS block FROM conversations"


@view("shingles")
def _(d: Dialect) -> str:
    """Character 5-grams as a set; none below five characters."""
    grams = d.shingles("body", 5)
    if d.name == "spark":
        return f"SELECT item, block, s FROM dedup_texts LATERAL VIEW explode({grams}) g AS s WHERE length(body) >= 5"
    return f"SELECT item, block, unnest({grams}) AS s FROM dedup_texts WHERE length(body) >= 5"


@view("shingle_counts")
def _(d: Dialect) -> str:
    return "SELECT item, block, count(*) AS n FROM shingles GROUP BY item, block"


@view("rare_prefix")
def _(d: Dialect) -> str:
    """Each item's rarest shingles, n - ceil(0.8 n) + 1 of its n: two items of similarity 0.8 or more share one of them."""
    return "SELECT item, block, s, n FROM (SELECT x.item, x.block, x.s, c.n, row_number() OVER (PARTITION BY x.item ORDER BY f.n, x.s) AS k FROM shingles x JOIN (SELECT s, count(*) AS n FROM shingles GROUP BY s) f ON f.s = x.s JOIN shingle_counts c ON c.item = x.item) y WHERE k <= n - ceil(n * 4 / 5e0) + 1"


@view("text_classes")
def _(d: Dialect) -> str:
    """Texts of one body and block, and the least of their items, which represents them."""
    return f"SELECT block, body, {d.sha256('body')} AS digest, min(item) AS rep FROM dedup_texts WHERE length(body) >= 5 AND item IS NOT NULL AND block IS NOT NULL GROUP BY block, body"


@view("class_shingles")
def _(d: Dialect) -> str:
    grams = d.shingles("body", 5)
    return f"SELECT block, rep, digest, {d.size('grams')} AS n, {d.items('grams')} AS s FROM (SELECT block, rep, digest, {grams} AS grams FROM text_classes) x"


@view("jaccard_pairs")
def _(d: Dialect) -> str:
    """Exact similarity of all pairs of 0.8 or more, within blocks, between the representatives of different texts, and each
    representative with its copies (same_text). The query is pairs.py; this says what it gives."""
    return f"""
SELECT a, b, {d.number("common * 1e0 / (na + nb - common)")} AS jaccard, false AS same_text
FROM (SELECT x.rep AS a, y.rep AS b, x.digest AS da, y.digest AS db, x.n AS na, y.n AS nb, count(*) AS common FROM class_shingles x JOIN class_shingles y ON x.s = y.s AND x.block = y.block WHERE (x.rep < y.rep OR x.rep = y.rep AND x.digest < y.digest) AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) GROUP BY x.rep, y.rep, x.digest, y.digest, x.block, x.n, y.n) p
WHERE 9 * common >= 4 * (na + nb)
UNION ALL
SELECT c.rep AS a, t.item AS b, 1e0 AS jaccard, true AS same_text FROM text_classes c JOIN (SELECT DISTINCT item, block, body FROM dedup_texts) t ON t.block = c.block AND t.body = c.body WHERE t.item > c.rep"""


@view("near_pairs")
def _(d: Dialect) -> str:
    return "SELECT a, b, jaccard FROM jaccard_pairs WHERE jaccard >= 0.8"


@view("exact_text_groups")
def _(d: Dialect) -> str:
    return f"SELECT {d.sha256('lower(trim(text))')} AS digest, min(doc_id) AS first_doc, count(*) AS members, count(DISTINCT lang) AS langs FROM documents WHERE text IS NOT NULL GROUP BY lower(trim(text))"


@view("dedup_groups")
def _(d: Dialect) -> str:
    return f"SELECT t.doc_id, t.lang, g.digest AS group_id, g.members FROM documents t JOIN exact_text_groups g ON g.digest = {d.sha256('lower(trim(t.text))')}"


@view("dedup_summary")
def _(d: Dialect) -> str:
    return f"SELECT count(*) AS filings, count(DISTINCT group_id) AS claims, {count_if('members > 1')} AS in_groups, max(members) AS largest FROM dedup_groups"


@view("dedup_size_bands")
def _(d: Dialect) -> str:
    return "SELECT CASE WHEN members = 1 THEN '1' WHEN members < 5 THEN '2-4' WHEN members < 20 THEN '5-19' ELSE '20+' END AS band, count(*) AS grps, sum(members)::bigint AS filings FROM exact_text_groups GROUP BY 1"


@view("primary_filing")
def _(d: Dialect) -> str:
    return "SELECT doc_id, group_id, k = 1 AS is_primary FROM (SELECT g.*, row_number() OVER (PARTITION BY group_id ORDER BY doc_id) AS k FROM dedup_groups g) x"


@view("phone_canonical")
def _(d: Dialect) -> str:
    """Digits only, without the country's or trunk prefix; null unless ten are left."""
    digits = "replace(replace(c_phone, '-', ''), ' ', '')"
    return f"SELECT c_custkey, CASE WHEN length(p) = 12 AND {d.starts('p', chr(39) + '91' + chr(39))} THEN substr(p, 3) WHEN length(p) = 11 AND {d.starts('p', chr(39) + '0' + chr(39))} THEN substr(p, 2) WHEN length(p) = 10 THEN p END AS phone FROM (SELECT c_custkey, {digits} AS p FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '91-' WHEN 1 THEN '0' WHEN 2 THEN '' ELSE '+' END || '98765 ' || lpad((c_custkey % 100000)::string, 5, '0') AS c_phone FROM customer) x) y"


@view("identity_keys")
def _(d: Dialect) -> str:
    """The salted key of the masked mobile's tail, the name's letters and the block."""
    key = f"concat_ws('|', 'masked', right(petitioner_mobile, 4), {d.replace('lower(petitioner_name)', '[^a-z]', '')}, coalesce(block, ''))"
    return f"SELECT ticket_no, district, created_year, CASE WHEN length({d.replace('lower(petitioner_name)', '[^a-z]', '')}) >= 4 THEN {d.sha256(chr(39) + 'salt|' + chr(39) + ' || ' + key)} END AS citizen_key FROM complaints"


@view("identity_buckets")
def _(d: Dialect) -> str:
    return "SELECT citizen_key, count(*) AS members, min(ticket_no) AS first_ticket FROM identity_keys WHERE citizen_key IS NOT NULL GROUP BY citizen_key HAVING count(*) > 1"


@view("identity_anchors")
def _(d: Dialect) -> str:
    """In a bucket each member meets its first 32 only."""
    return "SELECT citizen_key, ticket_no FROM (SELECT k.*, row_number() OVER (PARTITION BY citizen_key ORDER BY ticket_no) AS r FROM identity_keys k WHERE citizen_key IS NOT NULL) x WHERE r <= 32"


@view("block_key")
def _(d: Dialect) -> str:
    """District, script of the text, and 30-day window from 2000 on, or undated."""
    window = f"(floor({d.days('c.created_on', chr(39) + '2000-01-01' + chr(39) + '::date')} / 30e0)::bigint)::string"
    script = f"CASE WHEN {d.matches('coalesce(r.grievance_redacted, ' + chr(39) * 2 + ')', '[\\x{0B00}-\\x{0B7F}]')} THEN 'odia' ELSE 'latin' END"
    return f"SELECT c.ticket_no, coalesce(c.district, 'unknown') || ':' || {script} || ':' || CASE WHEN c.created_on IS NULL THEN 'undated' ELSE {window} END AS block FROM complaints c LEFT JOIN grievance_redactions r ON r.ticket_no = c.ticket_no"


@view("themes_first_word")
def _(d: Dialect) -> str:
    """Clusters by first word where no model is at hand: size, the share of the commonest district, and whether it rises."""
    return f"""
SELECT theme, sum(n)::bigint AS size, {d.number("max(n) * 1e0 / sum(n)")} AS concentration, max(n) * 1e0 / sum(n) >= 0.55 AS concentrated
FROM (SELECT split_part(lower(r.grievance_redacted), ' ', 1) AS theme, c.district, count(*) AS n FROM grievance_redactions r JOIN complaints c ON c.ticket_no = r.ticket_no GROUP BY 1, 2) x
GROUP BY theme HAVING sum(n) >= 3"""


@view("recall_increment")
def _(d: Dialect) -> str:
    """Officer-confirmed duplicates, and how many of them share an identity with another case."""
    return f"SELECT count(*) AS confirmed, {count_if('b.citizen_key IS NOT NULL')} AS also_by_identity FROM dup_confirmed c JOIN identity_keys k ON k.ticket_no = c.ticket_no LEFT JOIN identity_buckets b ON b.citizen_key = k.citizen_key WHERE c.duplicate_family IS NOT NULL"
