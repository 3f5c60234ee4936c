"""Where a case should go, learned from where like cases went."""

from __future__ import annotations

from ..functions.scalar import count_if, spaced
from ..plans.layer import Dialect, view

#: The widths of a crosswalk's key, widest last.
WIDTHS = (("category",), ("category", "subcategory"), ("category", "district"), ("category", "subcategory", "district"))
ALPHA, SUPPORT = 100, 3


@view("crosswalk_counts")
def _(d: Dialect) -> str:
    """Cases by key, department and office, for all widths in one pass."""
    sets = ", ".join(f"({', '.join(w)}, dept, office)" for w in WIDTHS)
    return f"""
SELECT (2 * grouping(subcategory) + grouping(district))::bigint AS width, category, subcategory, district, dept, office, count(*) AS n
FROM (SELECT {spaced(d, "category")} AS category, {spaced(d, "subcategory")} AS subcategory, {spaced(d, "district")} AS district, dept, office FROM complaints WHERE category IS NOT NULL AND dept IS NOT NULL) c
GROUP BY GROUPING SETS ({sets})"""


@view("crosswalk_build")
def _(d: Dialect) -> str:
    """Per key the department of most cases (ties by name), its share, and its office if that has support and over half."""
    key = "width, category, subcategory, district"
    on = " AND ".join(f"w.{k} IS NOT DISTINCT FROM o.{k}" for k in key.split(", "))
    return f"""
SELECT w.width, w.category, w.subcategory, w.district, w.dept, w.n AS support, w.total, {d.number("w.n * 1e0 / w.total")} AS dept_share, o.office
FROM (SELECT x.*, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, dept) AS k FROM (
        SELECT {key}, dept, sum(n)::bigint AS n, sum(sum(n)) OVER (PARTITION BY {key})::bigint AS total FROM crosswalk_counts GROUP BY {key}, dept) x) w
LEFT JOIN (SELECT {key}, dept, office, n, row_number() OVER (PARTITION BY {key}, dept ORDER BY n DESC, office) AS k, sum(n) OVER (PARTITION BY {key}, dept) AS of_dept FROM crosswalk_counts WHERE office IS NOT NULL) o
  ON {on} AND o.dept = w.dept AND o.k = 1 AND o.n >= {SUPPORT} AND o.n * 2 > o.of_dept
WHERE w.k = 1 AND w.n >= {SUPPORT}"""


@view("crosswalk_lookup")
def _(d: Dialect) -> str:
    """The surest rung of the ladder for each distinct case key; refused below 0.3."""
    sure = "least(0.95e0, dept_share * least(1e0, ln(1 + support) / ln(201e0)))"
    rungs = " UNION ALL ".join(
        f"SELECT q.category, q.subcategory, q.district, x.dept, x.office, {d.number(sure)} AS confidence, x.width FROM (SELECT DISTINCT {spaced(d, 'category')} AS category, {spaced(d, 'subcategory')} AS subcategory, {spaced(d, 'district')} AS district FROM complaints) q JOIN crosswalk_build x ON x.width = {w} AND "
        + " AND ".join(f"x.{k} = q.{k}" for k in ks)
        for w, ks in ((3, WIDTHS[0]), (1, WIDTHS[1]), (2, WIDTHS[2]), (0, WIDTHS[3]))
    )
    return f"SELECT category, subcategory, district, dept, office, confidence, width FROM (SELECT r.*, row_number() OVER (PARTITION BY category, subcategory, district ORDER BY confidence DESC, width) AS k FROM ({rungs}) r) x WHERE k = 1 AND confidence >= 0.3"


@view("route_cells")
def _(d: Dialect) -> str:
    return "SELECT created_year, category, subcategory, district, dept, count(*) AS weight FROM complaints WHERE category IS NOT NULL AND dept IS NOT NULL GROUP BY 1, 2, 3, 4, 5"


@view("route_split")
def _(d: Dialect) -> str:
    """Years into test (the last), validation (the one before) and train, with a history of three years before the test."""
    return """
SELECT created_year, CASE WHEN created_year = last THEN 'test' WHEN created_year = last - 1 THEN 'validation' ELSE 'train' END AS split, created_year BETWEEN last - 3 AND last - 1 AS in_history, sum(weight)::bigint AS cases
FROM (SELECT r.*, max(created_year) OVER () AS last FROM route_cells r) x GROUP BY created_year, last"""


@view("incidence_posterior")
def _(d: Dialect) -> str:
    """Shares of departments down the widths, each smoothed by the one above: (n + alpha * prior) / (N + alpha)."""
    n = lambda keys: f"(SELECT {', '.join([*keys, 'dept'])}, sum(weight) AS n, sum(sum(weight)) OVER ({('PARTITION BY ' + ', '.join(keys)) if keys else ''}) AS total FROM route_cells GROUP BY {', '.join([*keys, 'dept'])})"
    p0 = "(coalesce(a.n, 0) * 1e0 / a.total)"
    p1 = f"((coalesce(b.n, 0) + {ALPHA} * {p0}) / (t1.total + {ALPHA}))"
    p2 = f"((coalesce(e.n, 0) + {ALPHA} * {p1}) / (t2.total + {ALPHA}))"
    return f"""
SELECT t2.category, t2.district, a.dept, {d.number(p0)} AS prior, {d.number(p1)} AS by_category, {d.number(p2)} AS by_district
FROM (SELECT category, district, sum(weight) AS total FROM route_cells GROUP BY category, district) t2
JOIN (SELECT category, sum(weight) AS total FROM route_cells GROUP BY category) t1 ON t1.category = t2.category
CROSS JOIN {n(())} a
LEFT JOIN {n(("category",))} b ON b.category = t2.category AND b.dept = a.dept
LEFT JOIN {n(("category", "district"))} e ON e.category = t2.category AND e.district = t2.district AND e.dept = a.dept"""


@view("incidence_gates")
def _(d: Dialect) -> str:
    """The best department of a cell that has support 10, where it leads by 0.10 and holds half of the cell's cases."""
    return f"""
SELECT category, district, dept, by_district, {d.number("by_district - coalesce(next, 0)")} AS margin
FROM (SELECT p.*, lead(by_district) OVER w AS next, row_number() OVER w AS k, t.total, coalesce(h.own, 0) AS own FROM incidence_posterior p
      LEFT JOIN (SELECT category AS hc, district AS hi, dept AS hd, sum(weight) AS own FROM route_cells GROUP BY 1, 2, 3) h ON h.hc = p.category AND h.hi = p.district AND h.hd = p.dept
      JOIN (SELECT category AS c, district AS i, sum(weight) AS total FROM route_cells GROUP BY 1, 2) t ON t.c = p.category AND t.i = p.district
      WINDOW w AS (PARTITION BY category, district ORDER BY by_district DESC, dept)) x
WHERE k = 1 AND total >= 10 AND by_district - coalesce(next, 0) >= 0.10 AND own * 2 >= total"""


@view("hard_backoff")
def _(d: Dialect) -> str:
    best = lambda keys: f"(SELECT * FROM (SELECT {', '.join([*keys, 'dept'])}, row_number() OVER ({('PARTITION BY ' + ', '.join(keys)) if keys else ''} ORDER BY sum(weight) DESC, dept) AS k FROM route_cells GROUP BY {', '.join([*keys, 'dept'])}) x WHERE k = 1)"
    return f"""
SELECT q.category, q.district, coalesce(a.dept, b.dept, g.dept) AS dept FROM (SELECT DISTINCT category, district FROM complaints) q
LEFT JOIN {best(("category", "district"))} a ON a.category = q.category AND a.district = q.district LEFT JOIN {best(("category",))} b ON b.category = q.category CROSS JOIN {best(())} g"""


@view("route_accuracy")
def _(d: Dialect) -> str:
    return f"""
SELECT r.created_year, {d.number("sum(CASE WHEN r.dept = h.dept THEN weight ELSE 0 END) * 1e0 / sum(weight)")} AS top1, sum(weight)::bigint AS cases
FROM route_cells r JOIN hard_backoff h ON h.category = r.category AND h.district = r.district GROUP BY r.created_year"""


@view("model_select")
def _(d: Dialect) -> str:
    """The smoothing that gives the lowest log loss on the validation year, ties to the smaller."""
    return f"""
SELECT alpha, {d.number("-sum(v.weight * ln((coalesce(b.n, 0) + alpha * g.p) / (coalesce(t.total, 0) + alpha))) / sum(v.weight)")} AS log_loss
FROM (SELECT * FROM (VALUES (1), (10), (100), (1000)) AS a(alpha)) a
CROSS JOIN (SELECT c.* FROM route_cells c CROSS JOIN (SELECT max(created_year) - 1 AS y FROM route_cells) m WHERE c.created_year = m.y) v
JOIN (SELECT dept, sum(weight) * 1e0 / sum(sum(weight)) OVER () AS p FROM route_cells GROUP BY dept) g ON g.dept = v.dept
LEFT JOIN (SELECT category, dept, sum(weight) AS n FROM route_cells c CROSS JOIN (SELECT max(created_year) - 1 AS y FROM route_cells) m WHERE c.created_year < m.y GROUP BY category, dept) b ON b.category = v.category AND b.dept = v.dept
LEFT JOIN (SELECT category, sum(weight) AS total FROM route_cells c CROSS JOIN (SELECT max(created_year) - 1 AS y FROM route_cells) m WHERE c.created_year < m.y GROUP BY category) t ON t.category = v.category
GROUP BY alpha"""


@view("rule_router")
def _(d: Dialect) -> str:
    """The first rule that fits; else the fallback."""
    return """
SELECT ticket_no, target, rule FROM (
  SELECT c.ticket_no, r.target, r.rule, row_number() OVER (PARTITION BY c.ticket_no ORDER BY r.rule) AS k
  FROM complaints c JOIN (SELECT * FROM (VALUES (1, 'BUILDING', '1-URGENT', 'Works'), (2, 'MACHINERY', NULL, 'Industries'), (3, NULL, '2-HIGH', 'Collector'), (9, NULL, NULL, 'Grievance Cell')) AS r(rule, category, priority, target)) r
    ON (r.category IS NULL OR r.category = c.category) AND (r.priority IS NULL OR r.priority = c.subcategory)) x
WHERE k = 1"""


@view("chain_decode")
def _(d: Dialect) -> str:
    """A comma-separated chain of role numbers as names in order; null if any is unknown."""
    parts = "SELECT ticket_no, chain, i, split_part(chain, ',', i) AS token FROM chains CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS p(i)) n"
    body = parts.replace("chains", "(SELECT ticket_no, (mode_id % 4)::string || ',' || (dept_id % 5)::string || ',' || (mode_id % 3 + 1)::string AS chain FROM complaints) c")
    return f"""
SELECT ticket_no, max(chain) AS chain, CASE WHEN count(r.name) = 3 THEN {d.text_agg("r.name", " > ", "p.i")} END AS roles
FROM ({body}) p LEFT JOIN (SELECT * FROM (VALUES ('1', 'Clerk'), ('2', 'Officer'), ('3', 'Collector'), ('4', 'Secretary')) AS r(id, name)) r ON r.id = p.token GROUP BY ticket_no"""


@view("mapping_router")
def _(d: Dialect) -> str:
    return f"SELECT c.ticket_no, m.dept AS mapped FROM complaints c LEFT JOIN (SELECT * FROM (VALUES ('building', 'Works'), ('household', 'Housing'), ('furniture', 'Forest')) AS m(category, dept)) m ON m.category = {spaced(d, 'c.category')}"


@view("incidence_evidence")
def _(d: Dialect) -> str:
    return f"""
SELECT c.category, c.district, {count_if("true")} AS cells, max(weight)::bigint AS heaviest, CASE WHEN sum(weight) >= 10 THEN min(dept) FILTER (WHERE weight * 2 > total) END AS concentrated
FROM (SELECT category, district, dept, sum(weight) AS weight, sum(sum(weight)) OVER (PARTITION BY category, district) AS total FROM route_cells GROUP BY category, district, dept) c GROUP BY c.category, c.district"""
