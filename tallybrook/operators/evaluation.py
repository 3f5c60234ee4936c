"""Evaluation statistics over scored examples."""

from __future__ import annotations

from ..functions.scalar import count_if
from ..plans.layer import Dialect, view

Z = 1.959963984540054


def wilson(k: str, n: str, upper: bool) -> str:
    """A bound of the Wilson interval at 95 per cent."""
    z2 = Z * Z
    return f"(({k} * 1e0 / {n} + {z2 / 2} / {n} {'+' if upper else '-'} {Z} * sqrt({k} * 1e0 / {n} * (1 - {k} * 1e0 / {n}) / {n} + {z2 / 4} / ({n} * 1e0 * {n}))) / (1 + {z2} / {n}))"


@view("scored_examples")
def _(d: Dialect) -> str:
    """labels with a made-up score, a group and a language."""
    return f"""
SELECT l.doc_id AS item_id, l.toxic AS gold, t.lang AS language, t.source AS group_id, d.score, CASE WHEN d.score >= 0.5 THEN 1 ELSE 0 END AS predicted
FROM labels l JOIN documents t ON t.doc_id = l.doc_id JOIN (SELECT doc_id, (0.6 * toxic + 0.4 * (({d.hash_bits("doc_id::string")} % 1000) / 1e3))::double AS score FROM labels) d ON d.doc_id = l.doc_id"""


def _measures(d: Dialect) -> str:
    tp, fp, fn = (count_if(c) for c in ("gold = 1 AND predicted = 1", "gold = 0 AND predicted = 1", "gold = 1 AND predicted = 0"))
    return f"count(*) AS n, {d.number(f'{tp} * 1e0 / nullif({tp} + {fp}, 0)')} AS precision_1, {d.number(f'{tp} * 1e0 / nullif({tp} + {fn}, 0)')} AS recall_1, {d.number(f'2e0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)')} AS f1, {d.number('avg(CASE WHEN gold = predicted THEN 1e0 ELSE 0e0 END)')} AS accuracy"


@view("confusion")
def _(d: Dialect) -> str:
    return "SELECT gold, predicted, count(*) AS n FROM scored_examples GROUP BY gold, predicted"


@view("classification_metrics")
def _(d: Dialect) -> str:
    p = "greatest(least(CASE WHEN gold = 1 THEN score ELSE 1 - score END, 1 - 1e-12), 1e-12)"
    return f"SELECT {_measures(d)}, {d.number(f'avg(-ln({p}))')} AS log_loss, {d.number('avg((score - gold) * (score - gold))')} AS brier FROM scored_examples"


@view("metrics_by_language")
def _(d: Dialect) -> str:
    return f"SELECT language, {_measures(d)} FROM scored_examples GROUP BY language HAVING count(*) >= 20"


@view("calibration_error")
def _(d: Dialect) -> str:
    return f"SELECT {d.number('sum(gap * n) / sum(n)')} AS ece FROM (SELECT abs(avg(score) - avg(gold)) AS gap, count(*) AS n FROM scored_examples GROUP BY least(floor(score * 10), 9)) b"


@view("selective_accuracy")
def _(d: Dialect) -> str:
    return f"SELECT t::double AS threshold, count(*) AS covered, {d.number('avg(CASE WHEN gold = predicted THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM scored_examples CROSS JOIN (SELECT * FROM (VALUES (0.5), (0.7), (0.9)) AS g(t)) g WHERE greatest(score, 1 - score) >= t GROUP BY t"


@view("wilson_interval")
def _(d: Dialect) -> str:
    return f"SELECT language, k, n, {d.number(wilson('k', 'n', False))} AS low, {d.number(wilson('k', 'n', True))} AS high FROM (SELECT language, {count_if('gold = predicted')} AS k, count(*) AS n FROM scored_examples GROUP BY language) x"


@view("agresti_coull")
def _(d: Dialect) -> str:
    p = f"((k + {Z * Z / 2}) / (n + {Z * Z}))"
    return f"SELECT language, round({p} - {Z} * sqrt({p} * (1 - {p}) / (n + {Z * Z}))::double, 4) AS low, round({p} + {Z} * sqrt({p} * (1 - {p}) / (n + {Z * Z}))::double, 4) AS high FROM (SELECT language, {count_if('gold = predicted')} AS k, count(*) AS n FROM scored_examples GROUP BY language) x"


@view("clustered_se")
def _(d: Dialect) -> str:
    return f"""
SELECT count(*) AS clusters, {d.number("max(m)")} AS mean, {d.number("sqrt(count(*) * 1e0 / nullif(count(*) - 1, 0) * sum(r * r)) / max(total)")} AS se
FROM (SELECT group_id, max(m) AS m, max(total) AS total, sum(score - m) AS r FROM (SELECT s.*, avg(score) OVER () AS m, count(*) OVER () AS total FROM scored_examples s) x GROUP BY group_id) y"""


@view("group_disjoint")
def _(d: Dialect) -> str:
    return "SELECT group_id, count(DISTINCT split) AS splits FROM (SELECT group_id, CASE WHEN item_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM scored_examples) x GROUP BY group_id HAVING count(DISTINCT split) > 1"


@view("stratified_mean")
def _(d: Dialect) -> str:
    return f"SELECT {d.number('sum(w * m)')} AS mean, {d.number('sqrt(sum(w * w * v / n * (1 - n * 1e0 / (n + 50))))')} AS se FROM (SELECT language, avg(score) AS m, var_samp(score) AS v, count(*) AS n, count(*) * 1e0 / sum(count(*)) OVER () AS w FROM scored_examples GROUP BY language) x"


@view("paired_difference")
def _(d: Dialect) -> str:
    return f"""
SELECT {d.number("max(m)")} AS mean_difference, {d.number("sqrt(count(*) * 1e0 / nullif(count(*) - 1, 0) * sum(r * r)) / max(total)")} AS se
FROM (SELECT group_id, max(m) AS m, max(total) AS total, sum(diff - m) AS r FROM (SELECT s.*, avg(diff) OVER () AS m, count(*) OVER () AS total FROM (SELECT group_id, score - gold AS diff FROM scored_examples) s) x GROUP BY group_id) y"""


@view("cohen_kappa")
def _(d: Dialect) -> str:
    return f"SELECT {d.number('(po - pe) / nullif(1 - pe, 0)')} AS kappa FROM (SELECT avg(CASE WHEN gold = predicted THEN 1e0 ELSE 0e0 END) AS po, avg(gold) * avg(predicted) + (1 - avg(gold)) * (1 - avg(predicted)) AS pe FROM scored_examples) x"


@view("roc_auc")
def _(d: Dialect) -> str:
    return f"""
SELECT CASE WHEN p > 0 AND n > 0 THEN {d.number("(s - p * (p + 1) / 2e0) / (p * 1e0 * n)")} END AS auc
FROM (SELECT sum(CASE WHEN gold = 1 THEN r END) AS s, {count_if("gold = 1")} AS p, {count_if("gold = 0")} AS n
      FROM (SELECT gold, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM scored_examples) x) y"""


@view("average_precision")
def _(d: Dialect) -> str:
    return f"""
SELECT {d.number("sum(p * 1e0 / total * tp / seen)")} AS average_precision
FROM (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS total FROM (SELECT score, sum(gold) AS p, count(*) AS n FROM scored_examples GROUP BY score) g WINDOW w AS (ORDER BY score DESC)) x"""


@view("review_metrics")
def _(d: Dialect) -> str:
    flagged = count_if("score >= t")
    return f"SELECT t::double AS threshold, {flagged} AS flagged, {d.number(f'coalesce({count_if("score >= t AND gold = 1")} * 1e0 / nullif({flagged}, 0), 1)')} AS precision_1, {d.number(f'{count_if("score >= t AND gold = 1")} * 1e0 / nullif({count_if("gold = 1")}, 0)')} AS recall_1 FROM scored_examples CROSS JOIN (SELECT * FROM (VALUES (0.3), (0.5), (0.8), (1.1)) AS g(t)) g GROUP BY t"


@view("abstention_threshold")
def _(d: Dialect) -> str:
    """The threshold of most coverage at an accuracy of 0.99."""
    return f"""
SELECT threshold, covered FROM (SELECT x.*, row_number() OVER (ORDER BY covered DESC, threshold) AS k FROM (
  SELECT t AS threshold, {count_if("greatest(score, 1 - score) >= t")} AS covered, avg(CASE WHEN gold = predicted THEN 1e0 ELSE 0e0 END) FILTER (WHERE greatest(score, 1 - score) >= t) AS accuracy
  FROM scored_examples CROSS JOIN (SELECT DISTINCT round(greatest(score, 1 - score), 2) AS t FROM scored_examples) g GROUP BY t) x WHERE accuracy >= 0.99) y WHERE k = 1"""


@view("latency_stats")
def _(d: Dialect) -> str:
    return f"SELECT event_type, count(*) AS n, {d.number('avg(value)')} AS mean, {d.number(d.percentile('value', 0.5))} AS p50, {d.number(d.percentile('value', 0.9))} AS p90, {d.number(d.percentile('value', 0.95))} AS p95, {d.number('count(*) / nullif(sum(value), 0)')} AS throughput FROM events GROUP BY event_type"


@view("summary_scorecard")
def _(d: Dialect) -> str:
    return f"SELECT sum(gold)::bigint AS facts, count(*) AS n, {d.number(wilson('sum(gold)', 'count(*)', False))} AS low, {d.number(wilson('sum(gold)', 'count(*)', True))} AS high FROM scored_examples"


@view("divergence_rate")
def _(d: Dialect) -> str:
    return f"SELECT source, count(*) AS n, {d.number('avg(CASE WHEN lower(trim(text)) <> lower(trim(substr(text, 1, n_chars::int))) THEN 1e0 ELSE 0e0 END)')} AS diverging FROM documents GROUP BY source"


@view("largest_remainder")
def _(d: Dialect) -> str:
    """A sample of 100 by stratum in proportion: the floor, then one each to the largest remainders."""
    return """
SELECT language, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, language) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::bigint AS take
FROM (SELECT language, floor(q)::bigint AS base, round(q - floor(q), 9) AS rest FROM (SELECT language, 100e0 * count(*) / sum(count(*)) OVER () AS q FROM scored_examples GROUP BY language) x) y"""


@view("hash_sample")
def _(d: Dialect) -> str:
    return f"SELECT item_id, language FROM (SELECT item_id, language, row_number() OVER (PARTITION BY language ORDER BY {d.sha256(chr(39) + 'seed:' + chr(39) + ' || item_id::string')}, item_id) AS k FROM scored_examples) x WHERE k <= 10"


@view("interleave")
def _(d: Dialect) -> str:
    return "SELECT item_id, language, (row_number() OVER (ORDER BY k, size DESC, language, item_id))::bigint AS place FROM (SELECT item_id, language, row_number() OVER (PARTITION BY language ORDER BY item_id) AS k, count(*) OVER (PARTITION BY language) AS size FROM scored_examples) x"


@view("cost_model")
def _(d: Dialect) -> str:
    return f"SELECT lang, sum(ceil(n_chars / 2000e0))::bigint AS page_count, {d.number('sum(ceil(n_chars / 2000e0)) * 0.5 + sum(n_chars) / 4e0 * 0.00001')} AS cost FROM documents GROUP BY lang"
