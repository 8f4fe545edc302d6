"""Banding rules of members, cards, products, payments and health rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import whole_years

UNKNOWN = "Unknown"

# Upper bounds and labels of every band.
AGE_BANDS = [(25, "18-25"), (35, "26-35"), (45, "36-45"), (55, "46-55"), (65, "56-65")]
INCOME_BANDS = [(25000, "Low"), (50000, "Medium"), (100000, "High")]
LIMIT_BANDS = [(1000, "Low"), (5000, "Medium"), (10000, "High")]
APR_BANDS = [(0.10, "Low"), (0.20, "Medium")]
INTEREST_BANDS = [(0.05, "Low"), (0.15, "Medium")]
SCORE_BANDS = [(580, "Poor"), (670, "Fair"), (740, "Good"), (800, "Very Good")]
UTILIZATION_BANDS = [(0.10, "Low"), (0.30, "Medium"), (0.80, "High")]
RISK_BANDS = [(60, "high"), (80, "medium")]
ELIGIBILITY_BANDS = [(1.5, "Easy"), (2.5, "Medium")]
REGION_STATES = {
    "Northeast": ["ME", "NH", "VT", "MA", "RI", "CT", "NY", "NJ", "PA"],
    "Midwest": ["OH", "MI", "IN", "IL", "WI", "MN", "IA", "MO", "ND", "SD", "NE", "KS"],
    "South": ["DE", "MD", "DC", "VA", "WV", "NC", "SC", "GA", "FL", "KY", "TN", "AL", "MS", "AR", "LA", "OK", "TX"],
    "West": ["MT", "ID", "WY", "CO", "NM", "AZ", "UT", "NV", "WA", "OR", "CA", "AK", "HI"],
}
PAYMENT_CHANNELS = {"Digital": ["auto_pay", "online", "phone"], "Physical": ["mail", "branch"]}
CONVENIENCE = {"auto_pay": 5, "online": 4, "phone": 3, "mail": 2, "branch": 1}


def _below(value: Column, bands: list[tuple[float, str]], top: str) -> Column:
    """Label of the first band whose (exclusive) upper bound exceeds the value."""
    expr = F
    for bound, label in bands:
        expr = expr.when(value < F.lit(bound), label)
    return expr.otherwise(top)


def _missing(value: Column) -> Column:
    """Null and 0 both count as missing."""
    return value.isNull() | (value == 0)


def age_group(birth: Column, asof: Column) -> Column:
    age = whole_years(birth, asof)
    expr = F.when(birth.isNull(), UNKNOWN).when(age < 18, "Under 18")
    for bound, label in AGE_BANDS:
        expr = expr.when(age <= bound, label)
    return expr.otherwise("65+")


def region(state: Column) -> Column:
    expr = F.when(F.coalesce(state, F.lit("")) == "", UNKNOWN)
    for name, states in REGION_STATES.items():
        expr = expr.when(F.find_in_set(F.upper(state), F.lit(",".join(states))) > 0, name)
    return expr.otherwise("Other")


def income_bracket(income: Column) -> Column:
    return F.when(_missing(income), UNKNOWN).otherwise(_below(income, INCOME_BANDS, "Premium"))


def credit_limit_tier(limit: Column) -> Column:
    return F.when(_missing(limit), UNKNOWN).otherwise(_below(limit, LIMIT_BANDS, "Premium"))


def apr_category(rate: Column) -> Column:
    return F.when(_missing(rate), UNKNOWN).otherwise(_below(rate.cast("double"), APR_BANDS, "High"))


def interest_rate_tier(rate: Column) -> Column:
    return F.when(rate.isNull(), UNKNOWN).otherwise(_below(rate.cast("double"), INTEREST_BANDS, "High"))


def fee_category(fee: Column) -> Column:
    return F.when(fee.isNull(), UNKNOWN).when(fee == 0, "No Fee").when(fee < 100, "Low Fee").otherwise("High Fee")


def has_rewards(program: Column) -> Column:
    return F.coalesce(F.length(F.trim(program)) > 0, F.lit(False))


def eligibility_tier(score: Column, income: Column, dti: Column) -> Column:
    """Mean strictness (1 to 3) over the stated requirements; a requirement of 0 is stated but adds nothing."""
    dti = dti.cast("double")
    strictness = (
        F.when(_missing(score), 0).when(score < 600, 1).when(score < 700, 2).otherwise(3)
        + F.when(_missing(income), 0).when(income < 30000, 1).when(income < 60000, 2).otherwise(3)
        + F.when(_missing(dti), 0).when(dti > 0.5, 1).when(dti > 0.35, 2).otherwise(3)
    )
    stated = sum((c.isNotNull().cast("int") for c in (score, income, dti)), F.lit(0))
    mean = strictness.cast("double") / F.when(stated > 0, stated)
    return F.when(stated == 0, UNKNOWN).otherwise(_below(mean, ELIGIBILITY_BANDS, "Strict"))


def payment_channel(method: Column) -> Column:
    expr = F.when(F.coalesce(method, F.lit("")) == "", UNKNOWN)
    for channel, methods in PAYMENT_CHANNELS.items():
        expr = expr.when(F.lower(method).isin(methods), channel)
    return expr.otherwise("Other")


def convenience_score(method: Column) -> Column:
    expr = F
    for name, score in CONVENIENCE.items():
        expr = expr.when(F.lower(method) == name, score)
    return expr.otherwise(0)


def credit_score_tier(score: Column) -> Column:
    return F.when(_missing(score), UNKNOWN).otherwise(_below(score, SCORE_BANDS, "Excellent"))


def utilization_tier(ratio: Column) -> Column:
    return F.when(ratio.isNull(), UNKNOWN).otherwise(_below(ratio.cast("double"), UTILIZATION_BANDS, "Maxed"))


def risk_category(health: Column) -> Column:
    return _below(health, RISK_BANDS, "low")


def recommendation_tier(score: Column) -> Column:
    return F.when(score > 80, "High").when(score >= 60, "Medium").when(score.isNotNull(), "Low").otherwise(UNKNOWN)
