"""Feature vectors of all customers in one pass per source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encodings as E
from ..functions.dates import days_since
from ..functions.numbers import cents, half_up, num, ratio_or_zero
from ..operators.keyed import latest_per_key
from ..operators.ordered import trend_sums

DW_FEATURES = [
    "credit_score", "annual_income", "risk_category_encoded", "health_score", "utilization_ratio",
    "debt_to_income_ratio", "payment_behavior_score", "credit_utilization", "savings_rate", "total_credit_cards",
    "total_credit_limit", "total_credit_balance", "avg_credit_limit", "max_credit_limit", "avg_interest_rate",
    "payment_frequency", "avg_payment_amount", "total_payment_amount", "payment_consistency", "payment_trend",
    "income_to_credit_ratio", "credit_utilization_total", "payment_to_income_ratio", "customer_tenure_days",
    "avg_days_between_payments", "member_status_encoded",
    *[name for name, _, _ in E.INCOME_FLAGS], *[name for name, _, _ in E.CREDIT_FLAGS],
]
# Features of a member without cards, payments or health rows.
DEFAULT_APR, DEFAULT_ON_TIME, DEFAULT_METHOD = 0.20, 1.0, "online"
DEFAULT_SCORE, DEFAULT_DTI, DEFAULT_HEALTH, DEFAULT_RISK = 650, 0.3, 75.0, "medium"
SAVINGS_SHARE, CHECKING_SHARE = 0.1, 0.05
REQUIRED_INPUTS = ["annual_income", "date_of_birth", "member_since"]


def last_payments(payments: DataFrame, n: int = 12) -> DataFrame:
    """The latest n payments of each member; every task keeps at most n rows per member before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("member_id").orderBy(F.desc("payment_date"), F.desc("payment_id"))
    return payments.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def latest_health(metrics: DataFrame) -> DataFrame:
    return latest_per_key(metrics, ["member_id"], [F.desc("assessment_date"), F.desc("metric_id")])


def active_card_metrics(cards: DataFrame) -> DataFrame:
    """Per member with active cards: limits, balance, mean APR, count, utilization, available credit."""
    sums = cards.filter("card_status = 'active'").groupBy("member_id").agg(
        F.sum("credit_limit").alias("limits"), F.sum("current_balance").alias("balances"),
        F.sum("apr_rate").alias("apr"), F.count("*").alias("num_active_cards"))
    limit, balance = num("limits"), num("balances")
    return sums.select(
        "member_id", limit.alias("total_credit_limit"), balance.alias("total_balance"),
        F.when(limit > 0, balance / F.when(limit > 0, limit)).otherwise(F.lit(0.0)).alias("utilization_ratio"),
        "num_active_cards", (num("apr") / num("num_active_cards")).alias("avg_apr"),
        num(F.col("limits") - F.col("balances")).alias("total_available_credit"))


def payment_behaviour(payments: DataFrame, n: int = 12) -> DataFrame:
    """Over the latest n payments: on-time rate, mean days late, late fees, most used method.

    A tie between methods goes to the smaller name; payments without a method do not vote.
    """
    recent = last_payments(payments, n)
    per_method = recent.groupBy("member_id", "payment_method").agg(
        F.count("*").alias("votes"), F.sum(F.when(F.col("payment_status") == "on_time", 1).otherwise(0)).alias("on_time"),
        F.sum("days_late").alias("days"), F.sum("late_fee").alias("fees"))
    votes = F.when(F.col("payment_method").isNotNull(), F.struct((-F.col("votes")).alias("v"), "payment_method"))
    return per_method.groupBy("member_id").agg(
        F.sum("votes").alias("n"), F.sum("on_time").alias("on_time"), F.sum("days").alias("days"),
        F.sum("fees").alias("fees"), F.min(votes).alias("favourite")
    ).select(
        "member_id", (num("on_time") / num("n")).alias("on_time_payment_rate"), (num("days") / num("n")).alias("avg_days_late"),
        num("fees").alias("total_late_fees"),
        F.coalesce(F.col("favourite.payment_method"), F.lit(DEFAULT_METHOD)).alias("payment_method_preference"))


def with_health_or_defaults(members: DataFrame, health: DataFrame) -> DataFrame:
    """Left join of the latest health row; a member without one gets the default profile.

    ``members`` carries annual_income, total_balance and on_time_payment_rate.
    """
    rows = health.select("member_id", F.lit(True).alias("_has"), "credit_score", num("debt_to_income_ratio").alias("dti"),
                         num("payment_reliability_score").alias("reliability"), num("savings_balance").alias("savings"),
                         num("checking_balance").alias("checking"), num("total_debt").alias("debt"),
                         num("health_score").alias("health"), "risk_category")
    joined = members.join(rows, "member_id", "left")
    known = F.col("_has").isNotNull()

    def pick(value: str, default: Column) -> Column:
        return F.when(known, F.col(value)).otherwise(default)

    return joined.select(
        *members.columns,
        pick("credit_score", F.lit(DEFAULT_SCORE)).alias("credit_score"), pick("dti", F.lit(DEFAULT_DTI)).alias("debt_to_income_ratio"),
        pick("reliability", F.col("on_time_payment_rate") * 100).alias("payment_reliability_score"),
        pick("savings", F.col("annual_income") * SAVINGS_SHARE).alias("savings_balance"),
        pick("checking", F.col("annual_income") * CHECKING_SHARE).alias("checking_balance"),
        pick("debt", F.col("total_balance")).alias("total_debt"), pick("health", F.lit(DEFAULT_HEALTH)).alias("health_score"),
        pick("risk_category", F.lit(DEFAULT_RISK)).alias("risk_category"))


def featured(members: DataFrame) -> Column:
    """Test for members whose required inputs are present."""
    test = F.lit(True)
    for name in REQUIRED_INPUTS:
        test = test & F.col(name).isNotNull()
    return test


def member_features(members: DataFrame, cards: DataFrame, payments: DataFrame, metrics: DataFrame, asof: Column) -> DataFrame:
    """The 24 rule features of every active member with complete inputs."""
    people = members.filter((F.col("member_status") == "active") & featured(members)).select(
        "member_id", num("annual_income").alias("annual_income"),
        F.floor(days_since(F.col("date_of_birth"), asof) / 365).cast("int").alias("age"),
        days_since(F.col("member_since"), asof).alias("member_tenure_days"), "employment_status", "member_status")
    joined = people.join(active_card_metrics(cards), "member_id", "left").join(payment_behaviour(payments), "member_id", "left")
    defaults = {"total_credit_limit": 0.0, "total_balance": 0.0, "utilization_ratio": 0.0, "num_active_cards": 0,
                "avg_apr": DEFAULT_APR, "total_available_credit": 0.0, "on_time_payment_rate": DEFAULT_ON_TIME,
                "avg_days_late": 0.0, "total_late_fees": 0.0, "payment_method_preference": DEFAULT_METHOD}
    return with_health_or_defaults(joined.fillna(defaults), latest_health(metrics))


def payment_stats(payments: DataFrame, group: str = "member_id", day: str = "payment_date",
                  id_column: str = "payment_id", amount: str = "payment_amount") -> DataFrame:
    """Per customer: count, total, mean, consistency, trend and mean interval of payments."""
    t = trend_sums(payments, group, day, id_column, cents(F.col(amount)))
    n, s, ss, sx = num("n"), num("s"), num("ss"), num("sx")
    several = F.col("n") >= 2
    # n * sum(c^2) - (sum c)^2 is exact in whole cents.
    spread = num(F.col("n").cast("decimal(12,0)") * F.col("ss").cast("decimal(24,0)")
                 - F.col("s").cast("decimal(18,0)") * F.col("s").cast("decimal(18,0)"))
    deviation = F.sqrt(spread / F.when(several, n * (n - 1)))
    cv = deviation / F.when(s > 0, s / n)
    consistency = F.when(several & (s > 0), half_up(F.lit(1.0) - F.least(cv, F.lit(2.0)) / 2, 3)).otherwise(F.lit(0.0))
    # Positions are 0..n-1: sum x = n(n-1)/2, n * sum x^2 - (sum x)^2 = n^2 (n^2-1) / 12.
    top = num(F.col("n").cast("decimal(12,0)") * F.col("sx").cast("decimal(26,0)")
              - (F.col("n") * (F.col("n") - 1) / 2).cast("decimal(18,0)") * F.col("s").cast("decimal(18,0)"))
    bottom = n * n * (n * n - 1) / 12
    trend = F.when(F.col("n") >= 3, half_up(top / F.when(F.col("n") >= 3, bottom) / 100, 2)).otherwise(F.lit(0.0))
    gap = half_up(F.datediff("last_day", "first_day") / F.when(several, n - 1), 1)
    return t.select(
        F.col(group), F.col("n").alias("payment_frequency"), half_up(s / n / 100, 6).alias("avg_payment_amount"),
        (s / 100).alias("total_payment_amount"), consistency.alias("payment_consistency"), trend.alias("payment_trend"),
        F.when(several, gap).otherwise(F.lit(0.0)).alias("avg_days_between_payments"))


def recent_payments(fact: DataFrame, asof: Column, months: int = 12) -> DataFrame:
    return fact.filter(F.col("payment_date") >= F.add_months(asof, -months))


def payment_history_view(fact: DataFrame, members: DataFrame, health: DataFrame, asof: Column, months: int = 12) -> DataFrame:
    """Payments of the last months with the member's income and latest credit score."""
    recent = recent_payments(fact, asof, months).select(
        "payment_key", "member_id", "payment_amount", "payment_date", "payment_method", "payment_status", "is_on_time",
        "is_full_payment", "payment_ratio")
    people = members.select("member_id", "annual_income").join(
        health.select("member_id", "credit_score"), "member_id", "left")
    return recent.join(people, "member_id").select(
        F.col("payment_key").alias("payment_id"), F.col("member_id").alias("customer_id"),
        num("payment_amount").alias("payment_amount"), "payment_date", "payment_method",
        F.col("payment_status").alias("transaction_type"), "credit_score", num("annual_income").alias("annual_income"),
        "is_on_time", "is_full_payment", "payment_ratio")


def latest_balance(balances: DataFrame) -> DataFrame:
    return latest_per_key(balances, ["card_id"], [F.desc("snapshot_date_key")])


def active_cards(cards: DataFrame, balances: DataFrame) -> DataFrame:
    """Current active cards with the balance of their latest snapshot, 0 if there is none."""
    latest = latest_balance(balances).select("card_id", "current_balance")
    return cards.filter("is_current AND card_status = 'active'").join(latest, "card_id", "left").select(
        "card_id", F.col("member_id").alias("customer_id"), "card_type", num("credit_limit").alias("credit_limit"),
        F.coalesce(num("current_balance"), F.lit(0.0)).alias("current_balance"),
        num("apr_rate").alias("interest_rate"), "card_status", "issue_date", "card_age_months")


def card_rollup(cards: DataFrame, balances: DataFrame) -> DataFrame:
    """Per member with active cards: count, limits, balance, mean and largest limit, mean rate.

    Only the latest snapshot counts, so the balances are a maximum per card, not a join of all months.
    """
    latest = latest_balance(balances).select("card_id", "current_balance")
    joined = cards.filter("is_current AND card_status = 'active'").select(
        "card_id", "member_id", "credit_limit", "apr_rate").join(latest, "card_id", "left")
    sums = joined.groupBy("member_id").agg(
        F.count("*").alias("total_credit_cards"), F.sum("credit_limit").alias("limits"),
        F.sum("current_balance").alias("balances"), F.max("credit_limit").alias("largest"), F.sum("apr_rate").alias("rates"))
    count = num("total_credit_cards")
    return sums.select(
        "member_id", "total_credit_cards", num("limits").alias("total_credit_limit"),
        F.coalesce(num("balances"), F.lit(0.0)).alias("total_credit_balance"),
        half_up(num("limits") / count, 6).alias("avg_credit_limit"), num("largest").alias("max_credit_limit"),
        half_up(num("rates") / count, 6).alias("avg_interest_rate"))


def dw_features(members: DataFrame, health: DataFrame, cards: DataFrame, payments: DataFrame, asof: Column) -> DataFrame:
    """The 37 similarity features of every active customer.

    ``health`` is the latest row per member, ``cards`` a ``card_rollup``, ``payments`` a ``payment_stats``.
    """
    income = num("annual_income")
    people = members.filter("is_current AND member_status = 'active'").select(
        "member_id", F.coalesce(income, F.lit(0.0)).alias("annual_income"),
        F.coalesce(days_since(F.col("member_since"), asof), F.lit(0)).alias("customer_tenure_days"),
        E.encode_status(F.col("member_status")).alias("member_status_encoded"))
    state = health.select(
        "member_id", "credit_score", E.encode_risk(F.col("risk_category")).alias("risk_category_encoded"),
        num("health_score").alias("health_score"), num("credit_utilization_ratio").alias("utilization_ratio"),
        num("debt_to_income_ratio").alias("debt_to_income_ratio"),
        num("payment_reliability_score").alias("payment_behavior_score"),
        num("credit_utilization_ratio").alias("credit_utilization"), num("savings_balance").alias("_savings"))
    joined = people.join(state, "member_id", "left").join(cards, "member_id", "left").join(payments, "member_id", "left")
    # A missing limit sum divides by 1; every other missing value is 0, except the savings rate of a known
    # member without income, which stays null.
    limit = F.coalesce(F.col("total_credit_limit"), F.lit(1.0))
    income = F.col("annual_income")
    derived = joined.withColumns({
        "savings_rate": F.when(F.col("_savings").isNull(), F.lit(0.0)).otherwise(F.col("_savings") / F.nullif(income, F.lit(0.0))),
        "income_to_credit_ratio": ratio_or_zero(income, limit),
        "credit_utilization_total": ratio_or_zero(F.coalesce(F.col("total_credit_balance"), F.lit(0.0)), limit),
        "payment_to_income_ratio": ratio_or_zero(F.coalesce(F.col("total_payment_amount"), F.lit(0.0)), income),
        **E.bracket_flags(income, E.INCOME_FLAGS),
        **E.bracket_flags(F.coalesce(F.col("credit_score"), F.lit(0)), E.CREDIT_FLAGS),
    })
    filled = derived.fillna(0, subset=[c for c in DW_FEATURES if c != "savings_rate"])
    return filled.selectExpr("member_id AS customer_id", *[f"CAST({c} AS DOUBLE) AS {c}" for c in DW_FEATURES])
