"""Queries by key, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseworks.operators.features import EARNED_ELEMENTS, UNEARNED_ELEMENTS
from caseworks.sources.case_view import oracle_cases, oracle_policies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _names(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: What oracles start from: the case view, the policy table, and cases with recovered income.
COMMON = {
    "cases": oracle_cases(),
    "policy": oracle_policies(),
    "flagged": f"""SELECT *, coalesce(lower(element1) IN ({_names(EARNED_ELEMENTS)}), false) AS has_earned_inc_error,
  coalesce(lower(element1) IN ({_names(UNEARNED_ELEMENTS)}), false) AS has_unearned_inc_error, coalesce(status = 'amount correct', false) AS is_ok FROM cases""",
    "onet": """SELECT *, CASE WHEN is_ok THEN fsnetinc WHEN rawben <= minimum_ben THEN (benmax - minimum_ben) / 3e-1 ELSE (benmax - rawben) / 3e-1 END AS original_net_income FROM flagged""",
    "inc": """SELECT *, CASE WHEN has_earned_inc_error THEN CASE WHEN original_net_income IS NULL OR fsunearn IS NULL OR fstotded IS NULL OR fsearn IS NULL THEN NULL
      ELSE greatest(0e0, (original_net_income - fsunearn + fstotded - 2e-1 * fsearn) / 8e-1) END ELSE fsearn END AS recovered_earned,
  CASE WHEN has_unearned_inc_error THEN CASE WHEN original_net_income IS NULL OR fsearn IS NULL OR fstotded IS NULL THEN NULL ELSE greatest(0e0, original_net_income - fsearn + fstotded) END
      ELSE fsunearn END AS recovered_unearned FROM onet""",
    "ded": """SELECT *, CASE WHEN has_earned_inc_error THEN fstotded - 2e-1 * fsearn + 2e-1 * recovered_earned ELSE fstotded END AS original_deductions, recovered_earned + recovered_unearned AS verified_gross FROM inc""",
    "net": "SELECT *, verified_gross - original_deductions AS verified_net FROM ded",
    "ben": """SELECT *, CASE WHEN verified_net <= 0e0 THEN benmax WHEN verified_net IS NULL OR benmax IS NULL THEN NULL ELSE greatest(minimum_ben, benmax - 3e-1 * verified_net) END AS verified_benefit FROM net""",
    "rec": """SELECT *, CASE WHEN is_ok THEN abs(verified_benefit - fsben) ELSE abs(verified_benefit - rawben) END AS benefit_gap,
  CASE WHEN is_ok THEN abs(verified_benefit - fsben) ELSE abs(verified_benefit - rawben) END < 1e0 AS good_match,
  CASE WHEN has_earned_inc_error THEN 'earned_income' WHEN has_unearned_inc_error THEN 'unearned_income' ELSE 'other' END AS error_category, lower(trim(status)) AS status_clean FROM ben""",
    "strata": """SELECT *, CASE WHEN error_category <> 'other' AND status_clean = 'underissuance' THEN 'underissuance' WHEN error_category = 'earned_income' AND status_clean = 'overissuance' THEN 'earned_overissuance'
  WHEN error_category = 'unearned_income' AND status_clean = 'overissuance' THEN 'unearned_overissuance' END AS error_status FROM rec""",
}


def with_common(sql: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in COMMON.items()) + "\n" + sql


def query(name: str, sql: str | None = None, plain: bool = False):
    """Register a function (spark, sf_dir) -> DataFrame under name; sql follows the common tables unless plain."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            if plain:
                ORACLES[name] = sql
            elif sql.lstrip().upper().startswith("WITH "):
                ORACLES[name] = with_common("").rstrip() + ",\n" + sql.lstrip()[5:]
            else:
                ORACLES[name] = with_common(sql)
        return function

    return add


def each(name: str, sql: str | None, function) -> None:
    query(name, sql)(function)
