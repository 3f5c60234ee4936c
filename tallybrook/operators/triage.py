"""Texts that carry no case, and how a filing relates to an earlier one."""

from __future__ import annotations

from ..functions.scalar import count_if
from ..plans.layer import Dialect, view

#: Patterns of texts without content, matched against the whole text in lower case.
GENERIC = r"^\W*(test|demo|asdf+|hello|hi|no\s*specific\s*grievance|no\s*grievance|blank|empty|nothing|na|n/a|nil|none)\W*$"
ABUSE = r"^\W*(?:i\s+am|you\s+are|(?:he|she|they)\s+(?:is|are))\s+(?:an?\s+)?(?:idiot|fool|stupid|useless)\W*$"
#: Scores of the rules in their order.
SCORES = {"collapse": 0.92, "abuse": 0.78, "short": 0.85, "generic": 0.78, "vague": 0.68, "clean": 0.07}


@view("triage_texts")
def _(d: Dialect) -> str:
    return "SELECT 'd' || doc_id::string AS item, text FROM documents UNION ALL SELECT 'c' || conv_id::string || '-' || turn::string AS item, text FROM conversations UNION ALL SELECT * FROM (VALUES ('x1', 'You are an idiot!'), ('x2', 'no grievance'), ('x3', '[NAME] [PHONE]'), ('x4', ''), ('x5', 'please help me soon, thanks'), ('x6', NULL)) AS v(item, text)"


@view("trigram_shares")
def _(d: Dialect) -> str:
    """Words, and the share of a text's word trigrams that occur more than once; over half of them is a collapse."""
    return f"""
SELECT item, n + 2 AS words, {d.number("again * 1e0 / n")} AS repeated_share, n + 2 >= 20 AND again * 2 > n AS collapsed
FROM (SELECT item, sum(CASE WHEN k > 1 THEN k ELSE 0 END)::bigint AS again, sum(k)::bigint AS n FROM (
  SELECT item, gram, count(*) AS k FROM (SELECT item, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM (
    SELECT item, i, w FROM trigram_words) x WINDOW o AS (PARTITION BY item ORDER BY i)) y WHERE gram IS NOT NULL GROUP BY item, gram) z GROUP BY item) q"""


@view("trigram_words")
def _(d: Dialect) -> str:
    words = d.words("text")
    if d.name == "spark":
        return f"SELECT item, i::bigint AS i, w FROM triage_texts LATERAL VIEW posexplode({words}) p AS i, w"
    return f"SELECT item, i - 1 AS i, words[i] AS w FROM (SELECT item, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT item, {words} AS words FROM triage_texts) a) b"


@view("spam_score")
def _(d: Dialect) -> str:
    """The first rule that fits gives the score. Lengths are those of the text with its placeholders; one of placeholders
    alone is generic."""
    whole = "trim(coalesce(t.text, ''))"
    bare = f"trim({d.replace(whole, r'\[[^]]*\]', '')})"
    words = f"length({d.replace(whole, r'\s+', ' ')}) - length({d.replace(whole, r'\s+', '')}) + 1"
    return f"""
SELECT item, rule, CASE rule {" ".join(f"WHEN '{k}' THEN {v}e0" for k, v in SCORES.items())} END AS score
FROM (SELECT t.item, CASE WHEN coalesce(s.collapsed, false) THEN 'collapse' WHEN {d.matches(f"lower({whole})", ABUSE)} THEN 'abuse' WHEN length({whole}) < 20 THEN 'short'
             WHEN {d.matches(f"lower({whole})", GENERIC)} OR {bare} = '' THEN 'generic' WHEN {words} < 8 OR length({whole}) < 40 THEN 'vague' ELSE 'clean' END AS rule
      FROM triage_texts t LEFT JOIN trigram_shares s ON s.item = t.item) x"""


@view("spam_flag")
def _(d: Dialect) -> str:
    return "SELECT rule, score >= 0.5 AS flagged, count(*) AS n FROM spam_score GROUP BY rule, score"


@view("triage_review")
def _(d: Dialect) -> str:
    return "SELECT item, CASE WHEN score >= 0.5 THEN 'review' ELSE 'abstained' END AS decision FROM spam_score"


@view("spam_prevalence")
def _(d: Dialect) -> str:
    return f"SELECT t.lang, count(*) AS n, {count_if('s.score >= 0.5')} AS flagged, {d.number('avg(CASE WHEN s.score >= 0.5 THEN 1e0 ELSE 0e0 END)')} AS share FROM spam_score s JOIN documents t ON s.item = 'd' || t.doc_id::string GROUP BY t.lang"


@view("relationship_label")
def _(d: Dialect) -> str:
    """How two filings in a row of one petitioner relate; unknown where a kind is missing."""
    return f"""
SELECT ticket_no, CASE WHEN prev_category IS NULL OR category IS NULL THEN 'uncertain' WHEN category = prev_category AND subcategory = prev_sub THEN 'pure_duplicate' WHEN category = prev_category THEN 'follow_up' ELSE 'campaign' END AS relation, gap
FROM (SELECT ticket_no, category, subcategory, lag(category) OVER w AS prev_category, lag(subcategory) OVER w AS prev_sub, {d.days("created_on", "lag(created_on) OVER w")} AS gap, lag(ticket_no) OVER w AS prev
      FROM complaints WINDOW w AS (PARTITION BY petitioner_name ORDER BY created_on, ticket_no)) x WHERE prev IS NOT NULL"""


@view("english_test")
def _(d: Dialect) -> str:
    hits = " + ".join(f"{d.count_matches('lower(text)', f'(^|[^a-z]){w}($|[^a-z])')}" for w in ("the", "and", "of", "is"))
    return f"SELECT doc_id, {hits} AS hits, {hits} >= 3 AND length(text) >= 20 AND NOT {d.matches('text', '[\\x{0B00}-\\x{0B7F}]')} AS english FROM documents"


@view("script_tag")
def _(d: Dialect) -> str:
    return f"SELECT item, CASE WHEN {d.matches('text', '[\\x{0B00}-\\x{0B7F}]')} THEN 'odia' ELSE 'latin' END AS script FROM triage_texts"


@view("latin_share")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, {d.number(d.count_matches('text', '[A-Za-z]') + ' * 1e0 / nullif(length(text), 0)')} AS latin FROM documents"
