"""Rule recommendations once for each cell of members, not for each member and product.

A product's score compares a member with the product's requirements, and adds points that are the same for all
products. Members for whom all comparisons with all distinct requirements come out alike, and whose other points are
alike, form a cell: every product has one score in it, so the best products are found once a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, num
from . import rules as R

REQUIREMENTS = ["minimum_income_required", "minimum_credit_score", "maximum_debt_to_income"]
CELL = ["_income", "_score", "_debt", "_points", "_cards"]


def requirements(products: DataFrame) -> DataFrame:
    """One row with the distinct values of each requirement; the catalogue bounds them."""
    rows = R.catalogue(products, ["product_id", *REQUIREMENTS])
    return rows.agg(*[F.sort_array(F.collect_set(c)).alias(f"_{c}") for c in REQUIREMENTS])


def with_cells(features: DataFrame, products: DataFrame) -> DataFrame:
    """Members with the columns CELL: how far they are above each requirement, and the points that no product changes."""
    def level(value: Column, needed: Column, *steps: Column) -> Column:
        out = F.coalesce((value >= needed).cast("int"), F.lit(-1))
        for step in steps:
            out = out + F.coalesce(step.cast("int"), F.lit(0))
        return out

    def asked(name: str, test) -> Column:
        return F.transform(F.col(f"_{name}"), test)

    income, score, debt = num("annual_income"), F.col("credit_score"), num("debt_to_income_ratio")
    ratio = lambda need: F.when(need > 0, income / F.when(need > 0, need))
    used, on_time, health = F.col("utilization_ratio"), F.col("on_time_payment_rate"), F.col("health_score")
    alike = F.concat_ws(",", *[F.coalesce(test.cast("int"), F.lit(-1)).cast("string") for test in (
        used < 0.1, used < 0.3, used > 0.8, on_time > 0.95, on_time > 0.85, on_time < 0.7, health > 85, health < 60,
        F.col("risk_category") == "low", F.col("risk_category") == "high")])
    return features.crossJoin(F.broadcast(requirements(products))).withColumns({
        "_income": asked(REQUIREMENTS[0], lambda m: level(income, m, ratio(m) > 1.2, ratio(m) > 1.5, ratio(m) > 2.0)),
        "_score": asked(REQUIREMENTS[1], lambda s: level(score, s, score - s > 20, score - s > 50, score - s > 100)),
        "_debt": asked(REQUIREMENTS[2], lambda d: F.coalesce((debt > d).cast("int"), F.lit(-1))),
        "_points": alike, "_cards": F.coalesce(F.col("num_active_cards") >= 3, F.lit(False)),
    }).drop(*[f"_{c}" for c in REQUIREMENTS])


def recommend(features: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """What ``rules.recommend`` returns; products are scored for one member of each cell."""
    members = with_cells(features, products)
    cells = members.groupBy(*CELL).agg(F.min_by(F.struct(*features.columns), "member_id").alias("_one"))
    best = R.best_products(cells.select(*CELL, F.col("_one.member_id").alias("_cell"), *[F.col(f"_one.{c}") for c in features.columns]), products, "_cell", n)
    chosen = best.groupBy("_cell").agg(F.collect_list(F.struct("score", "rank", *R.PRODUCT_COLUMNS)).alias("_best"))  # n products
    known = cells.select(*CELL, F.col("_one.member_id").alias("_cell")).join(chosen, "_cell")
    top = members.join(known, CELL).select(*features.columns, F.explode("_best").alias("_b")).select(*features.columns, "_b.*")
    return top.withColumns({
        "eligible": R.eligible(), "reasons": R.rule_reasons(), "score": half_up(F.col("score"), 1),
        "probability": half_up(F.least(F.col("score") / 100, F.lit(1.0)), 3)})
