"""Rule scoring of every member against the product catalogue.

``score_products`` needs no cross join: the catalogue rides along as an array (see ``pairing``), scores are
plain expressions, and only the best products per member leave a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up, num, points
from ..functions.text import money, percent
from ..operators.pairing import first_with, pair_with

PRODUCT_COLUMNS = ["product_id", "product_name", "product_type", "product_category", "minimum_income_required",
                   "minimum_credit_score", "maximum_debt_to_income"]
# Score points and wording.
BASE_SCORE = 70.0
FALLBACK_CATEGORIES = ["basic", "secured"]


def catalogue(products: DataFrame, columns: list[str] | None = None) -> DataFrame:
    keep = columns or PRODUCT_COLUMNS
    return products.select(*[
        num(c).alias(c) if c in ("minimum_income_required", "maximum_debt_to_income") else F.col(c) for c in keep])


def _income() -> Column:
    return num("annual_income")


# ``product`` names a column of the product: a column of the pair, or a field of the product inside an array.

def short_of_score(product: Callable[[str], Column] = F.col) -> Column:
    return F.coalesce(F.col("credit_score") < product("minimum_credit_score"), F.lit(False))


def short_of_income(product: Callable[[str], Column] = F.col) -> Column:
    return F.coalesce(_income() < product("minimum_income_required"), F.lit(False))


def over_indebted(product: Callable[[str], Column] = F.col) -> Column:
    return F.coalesce(num("debt_to_income_ratio") > product("maximum_debt_to_income"), F.lit(False))


def eligible(product: Callable[[str], Column] = F.col) -> Column:
    """All stated requirements are met; a requirement that is not stated does not count."""
    return ~(short_of_score(product) | short_of_income(product) | over_indebted(product))


def income_ratio(product: Callable[[str], Column] = F.col) -> Column:
    floor = product("minimum_income_required")
    return F.when(floor > 0, _income() / F.when(floor > 0, floor))


def member_points() -> Column:
    """The points that are the same for all products."""
    used, on_time, health = F.col("utilization_ratio"), F.col("on_time_payment_rate"), F.col("health_score")
    return (
        points((used < 0.1, 10), (used < 0.3, 5), (used > 0.8, -15))
        + points((on_time > 0.95, 10), (on_time > 0.85, 5), (on_time < 0.7, -20))
        + points((F.col("risk_category") == "low", 10), (F.col("risk_category") == "high", -15))
        + points((health > 85, 10), (health < 60, -10))
    )


def rule_score(product: Callable[[str], Column] = F.col, own: Column | None = None) -> Column:
    """0 for products out of reach, else 70 plus and minus points, within 0..100; points are whole, so their order is free.

    ``own`` stands for ``member_points`` where these are known.
    """
    lead, ratio = F.col("credit_score") - product("minimum_credit_score"), income_ratio(product)
    score = (
        F.lit(BASE_SCORE)
        + points((ratio > 2.0, 15), (ratio > 1.5, 10), (ratio > 1.2, 5))
        + points((lead > 100, 15), (lead > 50, 10), (lead > 20, 5))
        + (member_points() if own is None else own)
        + points(((product("product_type") == "credit_card") & (F.col("num_active_cards") >= 3), -10))
    )
    return F.when(eligible(product), clamp(score, 0, 100)).otherwise(F.lit(0.0))


def _phrases(limit: int | None, joiner: str, *phrases: Column) -> Column:
    found = F.array_compact(F.array(*phrases))
    return F.array_join(F.slice(found, 1, limit) if limit else found, joiner)


def rule_reasons() -> Column:
    """Up to three reasons for a product, or why it is out of reach."""
    score, used, on_time = F.col("credit_score"), F.col("utilization_ratio"), F.col("on_time_payment_rate")
    good = _phrases(
        3, "; ",
        F.when(score >= 750, "excellent credit score").when(score >= 700, "good credit score"),
        F.when(income_ratio() > 2.0, "high income").when(income_ratio() > 1.5, "strong income"),
        F.when(used < 0.2, "low credit utilization"),
        F.when(on_time > 0.9, "excellent payment history").when(on_time > 0.8, "good payment history"),
        F.when(F.col("risk_category") == "low", "low financial risk"),
    )
    needed = F.col("minimum_credit_score").cast("string")
    bad = _phrases(
        None, "; ",
        F.when(short_of_score(), F.concat(F.lit("Credit score "), score.cast("string"), F.lit(" below required "), needed)),
        F.when(short_of_income(), F.concat(F.lit("Income "), money(_income()), F.lit(" below required "),
                                           money(F.col("minimum_income_required")))),
        F.when(over_indebted(), F.concat(F.lit("Debt-to-income "), percent(F.col("debt_to_income_ratio")),
                                         F.lit(" above maximum "), percent(F.col("maximum_debt_to_income")))),
    )
    reached = F.when(good == "", "meets all eligibility requirements").otherwise(good)
    return F.when(eligible(), reached).otherwise(F.concat(F.lit("Not eligible: "), bad))


def score_products(features: DataFrame, products: DataFrame) -> DataFrame:
    """Every member with every product: eligibility, score and reasons."""
    pairs = pair_with(features, catalogue(products), "product_id")
    return pairs.withColumns({"eligible": eligible(), "score": rule_score(), "reasons": rule_reasons()})


def best_per_customer(scored: DataFrame, customer: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(customer).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def falling(value: Column) -> list[Column]:
    """What puts a number in the order of ``desc`` (NaN first, nulls last) when it is sorted ascending."""
    return [value.isNull(), ~F.isnan(value), F.lit(0.0) - value]


def best_products(people: DataFrame, products: DataFrame, customer: str, n: int) -> DataFrame:
    """Rows of ``people`` with score, rank and columns of the n best products of each customer; equal scores keep catalogue order."""
    measured = people.withColumn("_own", member_points())
    pairs = first_with(measured, catalogue(products), "product_id",
                       lambda product: [*falling(rule_score(product, F.col("_own"))), product("product_id")], n)
    scored = pairs.withColumn("score", rule_score(own=F.col("_own"))).drop("_own")
    return best_per_customer(scored, customer, [F.desc("score"), F.col("product_id")], n)


def recommend(features: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """The n best products of each member; equal scores keep catalogue order.

    Reasons are worded after the cut, for n products per member instead of all.
    """
    top = best_products(features, products, "member_id", n)
    return top.withColumns({
        "eligible": eligible(), "reasons": rule_reasons(), "score": half_up(F.col("score"), 1),
        "probability": half_up(F.least(F.col("score") / 100, F.lit(1.0)), 3)})


def failures(asked: DataFrame, features: DataFrame, recommended: DataFrame) -> DataFrame:
    """Asked members without features, and featured ones without recommendations."""
    no_features = asked.select("member_id").join(features.select("member_id"), "member_id", "left_anti").select(
        "member_id", F.lit("insufficient_data").alias("error_type"), F.lit("Could not calculate member features").alias("message"))
    featured = features.select("member_id").join(asked.select("member_id"), "member_id", "left_semi")
    no_products = featured.join(recommended.select("member_id"), "member_id", "left_anti").select(
        "member_id", F.lit("no_recommendations").alias("error_type"), F.lit("No suitable products found").alias("message"))
    return no_features.unionByName(no_products)


def failure_summary(failed: DataFrame, processed: DataFrame) -> DataFrame:
    """Failures by type with the overall success rate."""
    total = processed.agg(F.count("*").cast("double")).scalar()
    lost = failed.agg(F.count("*").cast("double")).scalar()
    rate = F.when(total > 0, half_up((total - lost) / F.when(total > 0, total) * 100, 1)).otherwise(F.lit(0.0))
    return failed.groupBy("error_type").agg(F.count("*").alias("failures")).withColumn("success_rate_percent", rate)


# Catalogue scores: the plain rules a branch would use, from source tables only.

def catalogue_pairs(members: DataFrame, health: DataFrame, products: DataFrame) -> DataFrame:
    people = members.select("member_id", num("annual_income").alias("annual_income")).join(
        health.select("member_id", "credit_score", num("debt_to_income_ratio").alias("debt_to_income_ratio"),
                      num("health_score").alias("health_score"),
                      num("credit_utilization_ratio").alias("credit_utilization_ratio"),
                      num("payment_reliability_score").alias("payment_reliability_score")), "member_id")
    return pair_with(people, catalogue(products), "product_id")


def eligible_or_basic(pairs: DataFrame) -> DataFrame:
    """Eligible products of each member; a member without any gets the basic and secured ones.

    Both sets come from one pass: the pairs of a member sit together, so a window counts its eligible ones.
    """
    marked = pairs.withColumn("eligible", eligible())
    own = F.max(F.col("eligible")).over(Window.partitionBy("member_id"))
    keep = F.col("eligible") | (~own & F.col("product_category").isin(FALLBACK_CATEGORIES))
    return marked.withColumn("_keep", keep).filter("_keep").drop("_keep")


def catalogue_score() -> Column:
    floor, lead, health = F.col("minimum_income_required"), F.col("credit_score") - F.col("minimum_credit_score"), F.col("health_score")
    return clamp(
        F.lit(BASE_SCORE)
        + points((_income() > floor * 1.5, 15), (_income() > floor * 1.2, 10))
        + points((lead > 50, 15), (lead > 20, 10)) + points((health > 80, 10), (health < 50, -20)), 0, 100)


def catalogue_reason() -> Column:
    score = F.col("credit_score")
    found = _phrases(
        2, ", ",
        F.when(score >= 750, "excellent credit score").when(score >= 680, "good credit score"),
        F.when(_income() >= 80000, "high income").when(_income() >= 50000, "stable income"),
        F.when(F.col("credit_utilization_ratio") < 0.3, "low credit utilization"),
        F.when(F.col("payment_reliability_score") > 90, "excellent payment history"))
    return F.when(found == "", "Standard recommendation").otherwise(F.concat(F.lit("Recommended based on "), found))


def derive_health(members: DataFrame, cards: DataFrame, payments: DataFrame, jitter: Column | None = None,
                  other_debt: Column | None = None) -> DataFrame:
    """Health metrics of every member from cards and payments.

    ``jitter`` (points) and ``other_debt`` (money) stand in for the random parts of a simulation.
    """
    owned = cards.groupBy("member_id").agg(
        F.count("*").alias("n_cards"), F.sum("credit_limit").alias("limits"), F.sum("current_balance").alias("balances"))
    paid = payments.groupBy("member_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("payment_status") == "on_time", 1).otherwise(0)).alias("on_time"))
    joined = members.select("member_id", num("annual_income").alias("income")).join(owned, "member_id", "left").join(
        paid, "member_id", "left")
    limit, balance = num("limits"), F.coalesce(num("balances"), F.lit(0.0))
    base = joined.select(
        "member_id", "income", F.coalesce("n_cards", F.lit(0)).alias("n_cards"),
        F.when(limit > 0, F.least(F.lit(1.0), balance / F.when(limit > 0, limit))).otherwise(F.lit(0.0)).alias("used"),
        F.when(F.col("n") > 0, num("on_time") / F.when(F.col("n") > 0, num("n")) * 100).otherwise(F.lit(85.0)).alias("reliable"),
        (balance + (F.lit(0.0) if other_debt is None else other_debt)).alias("debt"))
    income, used, reliable = F.col("income"), F.col("used"), F.col("reliable")
    score = (
        F.lit(650.0)
        + points((income > 100000, 100), (income > 60000, 50), (income < 30000, -50))
        + points((used < 0.1, 50), (used < 0.3, 20), (used > 0.8, -100), (used > 0.5, -50))
        + points((reliable > 95, 50), (reliable > 85, 25), (reliable < 70, -75), (reliable < 80, -40))
        + (F.lit(0) if jitter is None else jitter))
    dti = F.when(income > 0, F.least(F.lit(1.0), F.col("debt") / F.when(income > 0, income))).otherwise(F.lit(0.0))
    scored = base.withColumns({"credit_score": clamp(score, 300, 850), "dti": dti})
    health = clamp(F.col("credit_score") / 850 * 40 + (F.lit(1.0) - used) * 25 + reliable / 100 * 20 + (F.lit(1.0) - F.col("dti")) * 15, 0, 100)
    from ..functions.bands import risk_category

    return scored.withColumn("health", health).select(
        "member_id", F.col("credit_score").cast("int").alias("credit_score"),
        half_up(F.col("dti"), 4).alias("debt_to_income_ratio"), half_up(used, 4).alias("credit_utilization_ratio"),
        half_up(reliable, 2).alias("payment_reliability_score"), half_up(F.col("debt"), 2).alias("total_debt"),
        half_up(F.col("health"), 2).alias("health_score"), risk_category(F.col("health")).alias("risk_category"))
