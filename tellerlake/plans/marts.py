"""Analytical views over the star schema and the example questions asked of it.

Facts are aggregated by natural key before they meet a dimension, so the join moves one row per key.
Averages are exact sums over counts, rounded once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, num


def mean(total: str, count: str, digits: int = 6) -> Column:
    return half_up(num(total) / F.when(F.col(count) > 0, num(count)), digits)


def member_payment_summary(fact: DataFrame, members: DataFrame) -> DataFrame:
    per_member = fact.groupBy("member_id").agg(
        F.count("*").alias("total_payments"), F.sum("payment_amount").alias("paid"),
        F.sum(F.col("is_on_time").cast("int")).alias("on_time"), F.sum("late_fee").alias("fees"),
        F.sum("days_late").alias("days"))
    return members.filter("is_current").join(per_member, "member_id").select(
        "member_id", "first_name", "last_name", "income_bracket", "employment_status", "total_payments",
        mean("paid", "total_payments").alias("avg_payment_amount"),
        mean("on_time", "total_payments").alias("on_time_rate"),
        num("fees").alias("total_late_fees"), mean("days", "total_payments").alias("avg_days_late"))


def product_recommendation_metrics(fact: DataFrame, products: DataFrame) -> DataFrame:
    per_product = fact.groupBy("product_key").agg(
        F.count("*").alias("total_recommendations"),
        F.sum(F.when(F.col("recommendation_status") == "accepted", 1).otherwise(0)).alias("accepted_count"),
        F.sum("recommendation_score").alias("score"))
    return products.join(per_product, "product_key").select(
        "product_id", "product_name", "product_type", "product_category", "total_recommendations", "accepted_count",
        mean("accepted_count", "total_recommendations").alias("acceptance_rate"),
        mean("score", "total_recommendations").alias("avg_recommendation_score"))


def member_health_trends(fact: DataFrame, members: DataFrame, dates: DataFrame, member_id: int | None = None,
                         year: int | None = None) -> DataFrame:
    """Monthly health averages per member, ordered by member, year and month."""
    days = dates.select(F.col("date_key").alias("assessment_date_key"), "year", "month_number", "month_name")
    if year is not None:
        days = days.filter(F.col("year") == year)
    if member_id is not None:
        fact = fact.filter(F.col("member_id") == member_id)
    monthly = fact.join(F.broadcast(days), "assessment_date_key").groupBy("member_id", "year", "month_number", "month_name").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in (
            "health_score", "credit_score", "debt_to_income_ratio", "credit_utilization_ratio")])
    return members.filter("is_current").select("member_id", "first_name", "last_name").join(monthly, "member_id").select(
        "member_id", "first_name", "last_name", "year", "month_number", "month_name",
        mean("health_score", "n").alias("avg_health_score"), mean("credit_score", "n").alias("avg_credit_score"),
        mean("debt_to_income_ratio", "n").alias("avg_debt_to_income"),
        mean("credit_utilization_ratio", "n").alias("avg_credit_utilization"),
    ).orderBy("member_id", "year", "month_number")


def payments_by_region(fact: DataFrame, members: DataFrame) -> DataFrame:
    """The payment summary rolled up over region and income bracket."""
    per_member = fact.groupBy("member_id").agg(F.count("*").alias("n"), F.sum("payment_amount").alias("paid"))
    joined = members.select("member_id", "region", "income_bracket").join(per_member, "member_id")
    return joined.rollup("region", "income_bracket").agg(
        F.sum("n").alias("total_payments"), num(F.sum("paid")).alias("total_paid"), F.count("*").alias("members"))


def top_members_by_payments(fact: DataFrame, members: DataFrame, dates: DataFrame, year: int, n: int = 5) -> DataFrame:
    days = dates.filter(F.col("year") == year).select(F.col("date_key").alias("payment_date_key"))
    totals = fact.join(F.broadcast(days), "payment_date_key").groupBy("member_id").agg(F.sum("payment_amount").alias("total"))
    return members.select("member_id", "first_name", "last_name").join(totals, "member_id").orderBy(
        F.desc("total"), "member_id").limit(n).select(
        "member_id", "first_name", "last_name", num("total").alias("total_payment_amount"))


def recent_payments_vs_average(payments: DataFrame, members: DataFrame, fact: DataFrame, asof: Column,
                               recent_months: int = 3, window_months: int = 12) -> DataFrame:
    """Recent payments next to the member's average over the longer window."""
    averages = fact.filter(F.col("payment_date") >= F.add_months(asof, -window_months)).groupBy("member_id").agg(
        F.sum("payment_amount").alias("paid"), F.count("*").alias("n"))
    recent = payments.filter(F.col("payment_date") >= F.add_months(asof, -recent_months)).select(
        "payment_id", "member_id", "payment_date", "payment_amount")
    return recent.join(averages, "member_id").join(members.select("member_id", "first_name", "last_name"), "member_id").select(
        "payment_id", "member_id", "first_name", "last_name", "payment_date", num("payment_amount").alias("payment_amount"),
        mean("paid", "n").alias("avg_payment_amount_last_year"))


def balances_vs_utilization(cards: DataFrame, fact: DataFrame, asof: Column, months: int = 6) -> DataFrame:
    used = fact.filter(F.col("snapshot_date") >= F.add_months(asof, -months)).groupBy("member_id").agg(
        F.sum(F.floor(F.col("utilization_ratio") * 10000 + 0.5)).alias("used"), F.count("*").alias("n"))
    return cards.filter("card_status = 'active'").join(used, "member_id").select(
        "member_id", "card_id", num("current_balance").alias("current_balance"), num("credit_limit").alias("credit_limit"),
        half_up(num("used") / (num("n") * 10000), 6).alias("avg_utilization_last_6_months"))


def health_vs_average(metrics: DataFrame, fact: DataFrame, asof: Column, recent_months: int = 1,
                      window_months: int = 12) -> DataFrame:
    averages = fact.filter(F.col("assessment_date") >= F.add_months(asof, -window_months)).groupBy("member_id").agg(
        F.sum("health_score").alias("total"), F.count("*").alias("n"))
    recent = metrics.filter(F.col("assessment_date") >= F.add_months(asof, -recent_months))
    return recent.select("member_id", num("health_score").alias("latest_health_score")).join(averages, "member_id").select(
        "member_id", "latest_health_score", mean("total", "n").alias("avg_health_score_last_year"))


def recommendations_vs_acceptance(recs: DataFrame, fact: DataFrame, asof: Column, recent_months: int = 1,
                                  window_months: int = 12) -> DataFrame:
    rates = fact.filter(F.col("recommendation_date") >= F.add_months(asof, -window_months)).groupBy("product_id").agg(
        F.sum(F.when(F.col("recommendation_status") == "accepted", 1).otherwise(0)).alias("accepted"),
        F.count("*").alias("n"))
    recent = recs.filter(F.col("recommendation_date") >= F.add_months(asof, -recent_months))
    return recent.join(rates, "product_id").select(
        "member_id", "product_id", "recommendation_date", num("recommendation_score").alias("recommendation_score"),
        mean("accepted", "n").alias("acceptance_rate_last_year"))


def risk_distribution(metrics: DataFrame) -> DataFrame:
    """Rows and share per risk category; the total is a second small aggregate."""
    counts = metrics.groupBy("risk_category").agg(F.count("*").alias("n"))
    total = metrics.agg(F.count("*")).scalar()
    return counts.select("risk_category", "n", half_up(num("n") / total * 100, 1).alias("share_percent"))


def portfolio_ratios(members: DataFrame, cards: DataFrame, payments: DataFrame, recs: DataFrame) -> DataFrame:
    """Cards per member, payments per card, recommendations per member."""
    counts = {name: df.agg(F.count("*").cast("double")).scalar() for name, df in (
        ("members", members), ("cards", cards), ("payments", payments), ("recs", recs))}
    return members.sparkSession.range(1).select(
        half_up(counts["cards"] / counts["members"], 1).alias("cards_per_member"),
        half_up(counts["payments"] / counts["cards"], 1).alias("payments_per_card"),
        half_up(counts["recs"] / counts["members"], 1).alias("recommendations_per_member"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    branches = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
                for n, df in tables.items()]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def product_history(members: DataFrame, recs: DataFrame, products: DataFrame, cards: DataFrame) -> DataFrame:
    """Products a customer already holds: accepted recommendations and cards."""
    accepted = recs.filter("recommendation_status = 'accepted'").join(
        products.select("product_id", "product_name", "product_type"), "product_id").select(
        F.col("member_id").alias("customer_id"), F.col("product_id").cast("string").alias("product_id"), "product_name",
        "product_type", F.lit("existing").alias("relationship_status"))
    held = cards.select(
        F.col("member_id").alias("customer_id"), F.concat(F.lit("card_"), F.col("card_id")).alias("product_id"),
        F.concat("card_type", F.lit(" Card")).alias("product_name"), F.lit("credit_card").alias("product_type"),
        F.col("card_status").alias("relationship_status"))
    known = members.select(F.col("member_id").alias("customer_id"))
    return accepted.union(held).distinct().join(known, "customer_id", "left_semi")


def similar_customers(members: DataFrame, health: DataFrame, cards: DataFrame, balances: DataFrame, *,
                      score_range: tuple[int, int], income_range: tuple[float, float], exclude: int | None = None,
                      limit: int = 100) -> DataFrame:
    """Active customers inside absolute score and income bounds, best health first."""
    people = members.filter(
        (F.col("member_status") == "active") & F.col("annual_income").between(*income_range)).select("member_id", "annual_income")
    if exclude is not None:
        people = people.filter(F.col("member_id") != exclude)
    scored = health.filter(F.col("credit_score").between(*score_range)).select(
        "member_id", "credit_score", "risk_category", "health_score", "credit_utilization_ratio",
        "debt_to_income_ratio", "payment_reliability_score")
    owned = cards.select("card_id", "member_id", "credit_limit").join(
        balances.select("card_id", "current_balance"), "card_id", "left").groupBy("member_id").agg(
        F.count("*").alias("total_cards"), F.sum("credit_limit").alias("limits"), F.sum("current_balance").alias("balance"))
    return people.join(scored, "member_id").join(owned, "member_id", "left").orderBy(
        F.desc("health_score"), "member_id").limit(limit).select(
        F.col("member_id").alias("customer_id"), "credit_score", num("annual_income").alias("annual_income"),
        "risk_category", num("health_score").alias("health_score"),
        num("credit_utilization_ratio").alias("utilization_ratio"),
        num("debt_to_income_ratio").alias("debt_to_income_ratio"),
        num("payment_reliability_score").alias("payment_behavior_score"),
        F.coalesce("total_cards", F.lit(0)).alias("total_cards"), mean("limits", "total_cards").alias("avg_credit_limit"),
        F.coalesce(num("balance"), F.lit(0.0)).alias("total_balance"))
