"""The case-record tables as views over the synthetic star schema."""

from __future__ import annotations

from .layer import Dialect, view

#: The desks that first receive a case.
OFFICES = ("Departments", "Office of Chief Minister", "Collector", "Chief Secretary", "Governor", "Superintendent of Police", "DG & IG Police")
#: Action remarks of the synthetic log, by (l_partkey + l_linenumber) % 12; None is a null.
REMARKS = (
    "The grievance has been disposed",
    "The  Grievance has been  resolved.",
    "The grievance has been disposed with appropriate action",
    "The grievance has been resolved & beneficiary benefited..",
    "Forwarded to concerned officer for necessary action",
    "ATR received from concerned officer",
    "Case already taken up for examination vide T00000017",
    "Duplicate copy.",
    "Relevant/Requisite document/s not attached",
    ".",
    None,
    "Free text of the officer about the matter at hand",
)
#: Action authorities, by l_suppkey % 10; one names no office that is known.
AUTHORITIES = ("CM Grievance Cell,Bhubaneswar", "Secretary Revenue ,Bhubaneswar", "Director, Pension", "Collector,Puri", "DSSO ,Puri", "Sub-Collector,Banki", "BDO,Pipili", "Tehsildar,Satyabadi", "SP,Khordha", "Unknown Desk")


def _case(key: str, values: tuple) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted) if v != "NULL") + " END"


@view("complaints")
def _(d: Dialect) -> str:
    return f"""
SELECT 'T' || lpad(o.o_orderkey::string, 8, '0') AS ticket_no, o.o_orderdate::date AS created_on,
       extract(year FROM o.o_orderdate)::bigint AS created_year,
       CASE WHEN o.o_orderstatus <> 'O' THEN {d.plus_days("o.o_orderdate", "o.o_orderkey % 400 - 5")} END AS resolved_on,
       CASE WHEN o.o_orderstatus = 'O' THEN 'Pending' WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 3 = 0 THEN 'Discard' ELSE 'Disposed' END AS status,
       CASE o.o_orderkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'No ' END AS benefitted,
       (o.o_orderkey % 15 + 1)::bigint AS mode_id, 'mode ' || (o.o_orderkey % 15 + 1)::string AS mode,
       CASE WHEN o.o_orderkey % 11 <> 0 THEN c.c_mktsegment END AS category, o.o_orderpriority AS subcategory, n.n_name AS district,
       CASE WHEN c.c_custkey % 20 <> 0 THEN 'block ' || (c.c_custkey % 20)::string END AS block,
       (o.o_custkey % 7)::bigint AS dept_id, CASE WHEN o.o_custkey % 7 <> 0 THEN 'dept ' || (o.o_custkey % 7)::string END AS dept,
       {_case("o.o_orderkey % 9", OFFICES)} AS office, c.c_name AS petitioner_name, 'XXXXXX' || lpad((c.c_custkey % 10000)::string, 4, '0') AS petitioner_mobile,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'Transferred' WHEN 1 THEN 'Not transferred' END AS transfer_status
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey"""


@view("action_history")
def _(d: Dialect) -> str:
    return f"""
SELECT id, ticket_no, action_taken_date, action_taken_remark, action_status,
       CASE WHEN l_suppkey % 13 = 0 THEN 'Other - ' ELSE action_status || ' - ' END || authority AS complaint_status_with_authority, action_taken_by
FROM (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id,
             CASE WHEN l_partkey % 211 <> 0 THEN 'T' || lpad(l_orderkey::string, 8, '0') END AS ticket_no,
             CASE WHEN l_partkey % 37 <> 0 THEN l_shipdate::date END AS action_taken_date,
             {_case("(l_partkey + l_linenumber) % 12", REMARKS)} AS action_taken_remark,
             CASE l_returnflag WHEN 'R' THEN 'Disposed' WHEN 'A' THEN 'Forwarded' ELSE CASE l_linestatus WHEN 'O' THEN 'Pending' ELSE 'ATR Received' END END AS action_status,
             {_case("l_suppkey % 10", AUTHORITIES)} AS authority, l_suppkey, (l_suppkey % 50)::bigint AS action_taken_by FROM lineitem) x"""


@view("grievance_redactions")
def _(d: Dialect) -> str:
    return "SELECT 'T' || lpad(doc_id::string, 8, '0') AS ticket_no, text AS grievance_redacted, 'v1' AS analyzer_version FROM documents"


@view("case_events")
def _(d: Dialect) -> str:
    return "SELECT user_id::bigint AS ticket, event_id::bigint AS id, ts::date AS date, event_type AS status FROM events"
