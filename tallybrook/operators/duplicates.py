"""Duplicates that an officer has confirmed in the closing remark."""

from __future__ import annotations

from ..functions.scalar import count_if, share
from ..plans.layer import Dialect, view


@view("dup_closing_remark")
def _(d: Dialect) -> str:
    return "SELECT ticket_no, district, category, mode, dept, created_on, created_year, resolved_on, closing_remark FROM join_left_closing"


@view("dup_confirmed")
def _(d: Dialect) -> str:
    taken = f"{d.starts('closing_remark', chr(39) + 'case already taken up' + chr(39))} OR {d.starts('closing_remark', chr(39) + 'case taken up earlier' + chr(39))}"
    return f"SELECT ticket_no, closing_remark, CASE WHEN {taken} THEN 'taken_up' WHEN {d.starts('closing_remark', chr(39) + 'duplicate copy' + chr(39))} THEN 'duplicate_copy' END AS duplicate_family FROM dup_closing_remark"


@view("dup_summary")
def _(d: Dialect) -> str:
    return f"""
SELECT count(duplicate_family) AS officer_confirmed_total, {count_if("duplicate_family = 'taken_up'")} AS taken_up,
       {count_if("duplicate_family = 'duplicate_copy'")} AS duplicate_copy, (SELECT count(*) FROM dup_closing_remark) AS resolved_with_closing
FROM dup_confirmed"""


@view("dup_workload")
def _(d: Dialect) -> str:
    return f"""
SELECT count(*) AS actions_on_duplicates, count(DISTINCT a.ticket_no) AS tickets, {d.number(share("count(*)", "(SELECT count(*) FROM action_history)"))} AS share_of_actions_pct
FROM action_history a JOIN dup_confirmed c ON c.ticket_no = a.ticket_no WHERE c.duplicate_family IS NOT NULL"""


def _by(name: str, column: str) -> None:
    @view(name)
    def _(d: Dialect) -> str:
        value = f"coalesce(r.{column}::string, 'unknown')"
        return f"""
SELECT {value} AS {column}, count(*) AS confirmed_duplicates, {d.number(share("count(*)", "sum(count(*)) OVER ()"))} AS share_pct
FROM dup_closing_remark r JOIN dup_confirmed c USING (ticket_no) WHERE c.duplicate_family IS NOT NULL GROUP BY {value}"""


for _name in ("district", "category", "mode"):
    _by(f"dup_by_{_name}", _name)
_by("dup_by_year", "created_year")
