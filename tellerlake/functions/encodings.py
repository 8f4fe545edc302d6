"""Numeric encodings of categories and the bracket flags of the feature vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category codes, bracket bounds and profile defaults.
RISK_CODES = {"low": 1, "medium": 2, "high": 3}
STATUS_CODES = {"active": 1, "inactive": 0, "suspended": -1}
INCOME_FLAGS = [
    ("income_under_30k", None, 30000), ("income_30k_50k", 30000, 50000), ("income_50k_75k", 50000, 75000),
    ("income_75k_100k", 75000, 100000), ("income_100k_150k", 100000, 150000), ("income_over_150k", 150000, None),
]
CREDIT_FLAGS = [
    ("credit_poor", None, 580), ("credit_fair", 580, 670), ("credit_good", 670, 740),
    ("credit_very_good", 740, 800), ("credit_excellent", 800, None),
]
PROFILE_DEFAULTS = {
    "member_tenure_months": 12, "age_group": "26-35", "income_bracket": "Medium", "employment_status": "employed",
    "payment_trend": "stable", "utilization_trend": "stable", "financial_stability_score": 75.0,
    "creditworthiness_score": 75.0, "product_readiness_score": 75.0, "total_products_owned": 1,
    "recommendation_acceptance_rate": 0.0,
}
ROLE_SOURCES = {"oltp": ["OLTP", "OPS"], "dw": ["MULTI_DB_USER", "DW"]}


def _lookup(value: Column, codes: dict[str, int]) -> Column:
    expr = F
    for name, code in codes.items():
        expr = expr.when(F.lower(value) == name, code)
    return expr.otherwise(0)


def encode_risk(value: Column) -> Column:
    return _lookup(value, RISK_CODES)


def decode_risk(code: Column) -> Column:
    expr = F
    for name, number in RISK_CODES.items():
        expr = expr.when(code == number, name)
    return expr.otherwise("unknown")


def encode_status(value: Column) -> Column:
    return _lookup(value, STATUS_CODES)


def bracket_flags(value: Column, flags: list[tuple[str, float | None, float | None]]) -> dict[str, Column]:
    """One 0/1 column per half-open bracket."""
    out = {}
    for name, low, high in flags:
        test = F.lit(True)
        if low is not None:
            test = test & (value >= low)
        if high is not None:
            test = test & (value < high)
        out[name] = F.coalesce(test.cast("int"), F.lit(0))
    return out


def profile_with_defaults(names: list[str] | None = None) -> dict[str, Column]:
    """Each profile field, or its default where it is missing."""
    return {n: F.coalesce(F.col(n), F.lit(PROFILE_DEFAULTS[n])) for n in (names or PROFILE_DEFAULTS)}


def granted_sources(roles: Column) -> dict[str, Column]:
    """Which sources a list of roles may read."""
    return {
        f"may_read_{source}": F.arrays_overlap(roles, F.array(*[F.lit(r) for r in needed]))
        for source, needed in ROLE_SOURCES.items()
    }
