"""Views against DuckDB on the smallest tables, and against counts by hand on small ones."""

import decimal
import random

import duckdb
import pytest

import __spark_entry__
import tallybrook.operators  # noqa: F401
from tallybrook.plans.layer import TABLES, VIEWS, Dialect, oracle, query, render

COMPARED = """complaints action_history closure_rung closure_summary closure_trajectory closure_reconciliation action_type_summary dup_by_district handoff_coverage
handoff_gap_by_type handoff_ticket_summary route phases phase_means office_stats route_cover open_cases dash_queue funnel_steps desk_pass next_after office_spread discard_families
weak_label_audit spike_candidates spike_three_number crosswalk_build crosswalk_lookup incidence_posterior classification_metrics roc_auc average_precision clustered_se km_censoring
augmented_score unique_action_key upsert_complaints span_scoring spam_score relationship_label jaccard_pairs identity_buckets metric_filings_by_district largest_remainder""".split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 4) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", COMPARED)
def test_view_equals_oracle(spark, sf_dir, con, name):
    df = query(name)(spark, sf_dir)
    cols = sorted(df.columns)
    got = con.execute(f'SELECT {", ".join(cols)} FROM ({oracle(name)}) x').fetchall()
    want = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(repr([plain(v) for v in r]) for r in want) == sorted(repr([plain(v) for v in r]) for r in got)


@pytest.mark.parametrize("name", ["jaccard_pairs", "near_pairs"])
def test_pairs_equal_their_oracle(spark, sf_dir, con, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = con.execute(f'SELECT {", ".join(cols)} FROM ({oracle(name)}) x').fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(got)


def test_every_view_has_an_oracle(con):
    for name in VIEWS:
        con.execute(f"EXPLAIN {oracle(name)}")


class Local(Dialect):
    """Views over temporary views instead of files."""

    def __init__(self, own):
        self.own = own

    def table(self, name, sf_dir):
        raise AssertionError(name)


def run(spark, name, **own):
    """A view over hand-made inputs, each in place of the view of that name."""
    saved = {k: VIEWS[k] for k in own}
    try:
        for k, rows in own.items():
            rows.createOrReplaceTempView(f"t_{k}")
            VIEWS[k] = lambda d, k=k: f"SELECT * FROM t_{k}"
        return [r.asDict() for r in spark.sql(render(name, Local(own))).collect()]
    finally:
        VIEWS.update(saved)


@pytest.fixture(scope="module")
def closure_lake(spark):
    disposed, acted = "The grievance has been disposed", "The  grievance has been disposed with appropriate action."
    cases = spark.createDataFrame(
        [("T1", "2024-01-01", "2024-01-02", "yes"), ("T2", "2024-01-01", "2024-01-20", None), ("T3", "2024-01-01", "2024-01-05", "no"), ("T4", "2024-01-01", None, None), ("T5", "2024-01-10", "2024-01-01", None)],
        "ticket_no string, c string, r string, benefitted string",
    ).selectExpr("ticket_no", "to_date(c) AS created_on", "to_date(r) AS resolved_on", "benefitted", "'x' AS category", "'y' AS district", "'z' AS dept", "'m' AS mode", "2024L AS created_year")
    actions = spark.createDataFrame(
        [(1, "T1", "2024-01-01", "other"), (2, "T1", "2024-01-02", disposed + ".."), (3, "T2", "2024-01-19", acted), (4, "T2", "2024-01-25", disposed), (5, "T2", None, disposed), (6, "T404", "2024-01-01", disposed), (8, "T3", "2024-01-04", disposed), (7, "T3", "2024-01-04", acted)],
        "id long, ticket_no string, d string, action_taken_remark string",
    ).selectExpr("id", "ticket_no", "to_date(d) AS action_taken_date", "action_taken_remark", "'Disposed' AS action_status", "'Disposed - BDO,P' AS complaint_status_with_authority", "1L AS action_taken_by")
    return {"complaints": cases, "action_history": actions}


def test_closing_action_is_the_last_one_up_to_resolution(spark, closure_lake):
    rungs = {r["ticket_no"]: (r["rung"], r["action_steps"], r["elapsed_bucket"]) for r in run(spark, "closure_rung", **closure_lake)}
    assert rungs == {"T1": ("bare", 2, "0-2 days"), "T2": ("with_action", 1, "8-30 days"), "T3": ("bare", 2, "3-7 days"), "T5": ("off_ladder", 0, "invalid")}


def test_closure_summary_by_hand(spark, closure_lake):
    (row,) = run(spark, "closure_summary", **closure_lake)
    assert (row["resolved_complaints"], row["ladder_closures"], row["bare"], row["off_ladder"]) == (4, 3, 2, 1)
    assert row["bare_share_of_resolved_pct"] == 50.0


def test_handoffs_by_hand(spark, closure_lake):
    gaps = sorted((r["ticket_no"], r["gap_days"], r["is_invalid_order"]) for r in run(spark, "handoff_intervals", **closure_lake))
    assert gaps == [("T1", 1, False), ("T2", 6, False), ("T3", 0, False)]


def test_near_pairs_by_brute_force(spark):
    """Copies with edits whose rare shingles differ, and others, against all pairs; no block crossed."""
    rng = random.Random(7)
    texts = []
    for n in range(12):
        base = "".join(rng.choices("abcdefghijklmnop ", k=rng.choice([40, 150, 400])))
        for _ in range(4):
            body = list(base)
            for _ in range(rng.randrange(4)):
                body[rng.randrange(len(body))] = "#"
            texts.append((f"i{len(texts):03}", "".join(body), "x" if rng.random() < 0.8 else "y"))
    own = spark.createDataFrame(texts, "item string, body string, block string")
    listed = run(spark, "jaccard_pairs", dedup_texts=own)
    assert sorted((r["a"], r["b"], r["jaccard"]) for r in listed) == sorted((r["a"], r["b"], r["jaccard"]) for r in run(spark, "near_pairs", dedup_texts=own))
    members = {i: [i] for i, _, _ in texts}  # of a representative: itself and its copies
    for r in listed:
        if r["same_text"]:
            members[r["a"]].append(r["b"])
    got = {(a, b): 1.0 for m in members.values() for a in m for b in m if a < b}
    for r in listed:
        if not r["same_text"]:
            got |= {(min(a, b), max(a, b)): r["jaccard"] for a in members[r["a"]] for b in members[r["b"]]}
    grams = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t, _ in texts}
    want = {(a, b): round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6) for a, _, p in texts for b, _, q in texts if a < b and p == q and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])}
    assert len(want) > 10 and got == want


def test_dedup_texts_are_whole_tables(spark, sf_dir, con):
    whole = con.execute("SELECT (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM conversations)").fetchone()[0]
    assert query("dedup_texts")(spark, sf_dir).count() == whole == con.execute(f"SELECT count(*) FROM ({oracle('dedup_texts')}) x").fetchone()[0]


def test_pending_documents_by_their_state(spark):
    pages = spark.createDataFrame([(1, "a.org", None), (2, "b.org", ""), (3, "c.org", None), (4, "d.org", "<p>x</p>"), (5, "n/a", None), (6, None, None)], "page_id long, url string, html string")
    pages.createOrReplaceTempView("pages")
    try:
        assert sorted(r["page_id"] for r in spark.sql(VIEWS["document_pending"](Dialect())).collect()) == [1, 2, 3]
    finally:
        spark.catalog.dropTempView("pages")
