"""Filtered pages, searches and projections of single tables. Filters reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import page

# The equality filters and the contains filters of every table.
EQUALS = {
    "dim_member": ["member_id", "income_bracket", "employment_status", "member_status", "is_current"],
    "dim_credit_card": ["card_id", "member_key", "card_type", "credit_limit_tier", "card_status", "is_current"],
    "fact_financial_health": ["member_key", "assessment_date_key", "risk_category", "credit_score_tier", "utilization_tier"],
    "fact_payment": ["member_key", "card_key", "payment_date_key", "payment_status", "is_on_time"],
    "dim_financial_product": ["product_id", "product_type", "product_category", "is_active"],
    "fact_product_recommendation": ["member_key", "product_key", "recommendation_date_key", "recommendation_status",
                                    "is_expired", "is_high_confidence"],
    "fact_credit_card_balance": ["member_key", "card_key", "snapshot_date_key"],
}
CONTAINS = {
    "dim_member": ["first_name", "last_name", "email", "city", "state"],
    "dim_financial_product": ["product_name"],
}
PAGE_KEYS = {
    "dim_member": "member_key", "dim_credit_card": "card_key", "fact_financial_health": "health_key",
    "fact_payment": "payment_key", "dim_financial_product": "product_key",
    "fact_product_recommendation": "recommendation_key", "fact_credit_card_balance": "balance_key",
}


def contains(column: str | Column, text: str) -> Column:
    """Case-insensitive contains; the text is literal, not a pattern."""
    value = F.col(column) if isinstance(column, str) else column
    return F.lower(value).contains(text.lower())


def filtered(df: DataFrame, table: str, **params: object) -> DataFrame:
    """Rows that meet every given parameter; dimension versions default to the current ones."""
    if "is_current" in EQUALS[table]:
        params.setdefault("is_current", True)
    for name, value in params.items():
        if value is None:
            continue
        if name in EQUALS[table]:
            df = df.filter(F.col(name) == F.lit(value))
        elif name in CONTAINS.get(table, []):
            df = df.filter(contains(name, str(value)))
        else:
            raise ValueError(f"{table} has no filter {name}")
    return df


def filtered_page(df: DataFrame, table: str, skip: int = 0, limit: int = 100, **params: object) -> DataFrame:
    return page(filtered(df, table, **params), [PAGE_KEYS[table]], skip, limit)


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def search_customers(members: DataFrame, name: str | None = None, email: str | None = None,
                     phone: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of the members that match any of the given texts, smallest ids first, with the total."""
    tests = []
    if name:
        full = F.concat_ws(" ", "first_name", "last_name")
        tests += [contains("first_name", name), contains("last_name", name), contains(full, name)]
    if email:
        tests.append(contains("email", email))
    if phone:
        tests.append(contains("phone", phone))
    if not tests:
        raise ValueError("give a name, an email or a phone number")
    found = members.filter(reduce(lambda a, b: a | b, tests)).select(
        "member_id", F.col("member_id").cast("string").alias("customer_id"), "first_name", "last_name", "email", "phone", "date_of_birth")
    return page(found, ["member_id"], skip, limit).drop("member_id")


def search_products(products: DataFrame, name: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of the products whose name holds the text, with the total."""
    return page(products.filter(contains("product_name", name)), ["product_id"], skip, limit)


def contacts(members: DataFrame) -> DataFrame:
    return members.select("member_id", "first_name", "last_name", "email", "phone", "address", "city", "state", "zip_code")


def customer_profile(members: DataFrame) -> DataFrame:
    return members.filter("is_current").select(
        F.col("member_id").alias("customer_id"), "first_name", "last_name",
        F.concat_ws(" ", "first_name", "last_name").alias("name"), "annual_income",
        F.col("member_since").alias("date_joined"), "member_status", "member_tenure_years", "city", "state", "region")


def active_products(products: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Active products; with ``keep_unknown`` also those without a flag."""
    return products.filter(F.coalesce(F.col("is_active"), F.lit(keep_unknown)))


def active_members(members: DataFrame, limit: int | None = None) -> DataFrame:
    ids = members.filter("member_status = 'active'").select("member_id")
    return ids if limit is None else ids.orderBy("member_id").limit(limit)


def display(df: DataFrame) -> DataFrame:
    """Columns for a result grid: id, full name and contact data under display names."""
    names = df.columns
    id_column = next((c for c in ("customer_id", "member_id") if c in names), names[0])
    if {"first_name", "last_name"} <= set(names):
        name = F.concat("first_name", F.lit(" "), "last_name")
    else:
        name = F.col("Name" if "Name" in names else names[min(1, len(names) - 1)])
    shown = [F.col(id_column).alias("Customer ID"), name.alias("Name")]
    for column, title in (("email", "Email"), ("phone", "Phone"), ("date_of_birth", "DOB")):
        if column in names:
            shown.append(F.col(column).alias(title))
    return df.select(*shown)


def unique_columns(df: DataFrame) -> DataFrame:
    """Rename repeated columns to x, x_1, x_2, ..."""
    taken: set[str] = set()
    out = []
    for name in df.columns:
        candidate, n = name, 0
        while candidate in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        out.append(candidate)
    return df.toDF(*out)
