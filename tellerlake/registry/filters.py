"""Filtered pages, lookups, searches and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import documents as D
from ..plans import filters as P
from ..session import kept
from .base import Context, query

PAGE = ", total b, page_number b, total_pages b"


def _page_sql(table: str, key: str, where: str, skip: int, limit: int) -> str:
    return (f"SELECT t.*, (SELECT count(*) FROM {table} WHERE {where}) AS total, {skip // limit + 1} AS page_number, "
            f"CAST(ceil((SELECT count(*) FROM {table} WHERE {where})/{limit}.0) AS BIGINT) AS total_pages "
            f"FROM (SELECT * FROM {table} WHERE {where} ORDER BY {key} LIMIT {limit} OFFSET {skip}) t")


@query("filter_members", "member_key b, member_id b, city s, state s, income_bracket s, region s" + PAGE,
       _page_sql("dim_member", "member_key", "is_current AND employment_status='employed' AND lower(city) LIKE '%city 1%' AND member_status='active'", 0, 100))
def _(c: Context):
    return P.filtered_page(c.wh.dim_member, "dim_member", employment_status="employed", city="CITY 1", member_status="active")


@query("filter_cards", "card_key b, card_id b, card_type s, credit_limit_tier s, card_status s" + PAGE,
       _page_sql("dim_credit_card", "card_key", "is_current AND card_type='visa' AND card_status='active'", 100, 50))
def _(c: Context):
    return P.filtered_page(c.wh.dim_credit_card, "dim_credit_card", 100, 50, card_type="visa", card_status="active")


@query("filter_health", "health_key b, member_key b, risk_category s, credit_score_tier s, utilization_tier s" + PAGE,
       _page_sql("fact_financial_health", "health_key", "risk_category='high' AND assessment_date_key=20011215", 0, 100))
def _(c: Context):
    return P.filtered_page(c.wh.fact_financial_health, "fact_financial_health", risk_category="high", assessment_date_key=20011215)


@query("filter_payments", "payment_key b, member_key b, payment_status s, is_on_time o, payment_ratio d" + PAGE,
       _page_sql("fact_payment", "payment_key", "payment_status='late' AND NOT is_on_time", 50, 25))
def _(c: Context):
    return P.filtered_page(c.wh.fact_payment, "fact_payment", 50, 25, payment_status="late", is_on_time=False)


@query("filter_products", "product_key b, product_name s, product_type s, eligibility_tier s" + PAGE,
       _page_sql("dim_financial_product", "product_key", "lower(product_name) LIKE '%e%' AND is_active", 0, 20))
def _(c: Context):
    return P.filtered_page(c.wh.dim_financial_product, "dim_financial_product", 0, 20, product_name="E", is_active=True)


@query("filter_recommendations", "recommendation_key b, member_key b, product_key b, recommendation_tier s, days_to_expiry b" + PAGE,
       _page_sql("fact_product_recommendation", "recommendation_key", "recommendation_status='pending' AND NOT is_expired AND is_high_confidence", 0, 100))
def _(c: Context):
    return P.filtered_page(c.wh.fact_product_recommendation, "fact_product_recommendation",
                           recommendation_status="pending", is_expired=False, is_high_confidence=True)


@query("filter_balances", "balance_key b, card_key b, snapshot_date_key b, current_balance d, balance_trend s" + PAGE,
       _page_sql("fact_credit_card_balance", "balance_key", "snapshot_date_key=20011231", 200, 100))
def _(c: Context):
    return P.filtered_page(c.wh.fact_credit_card_balance, "fact_credit_card_balance", 200, 100, snapshot_date_key=20011231)


@query("page_with_total", "payment_key b, payment_amount d" + PAGE, _page_sql("fact_payment", "payment_key", "true", 300, 100))
def _(c: Context):
    return P.filtered_page(c.wh.fact_payment, "fact_payment", 300, 100)


@query("point_lookup", "card_key b, member_key b, balance_key b, current_balance d",
       "SELECT * FROM fact_credit_card_balance WHERE balance_key=6000000+200112")
def _(c: Context):
    return P.point_lookup(c.wh.fact_credit_card_balance, "balance_key", 6000000 + 200112)


@query("point_lookup_member", "member_key b, member_id b, email s, age_group s, income_bracket s", "SELECT * FROM dim_member WHERE member_id=42")
def _(c: Context):
    return P.point_lookup(c.wh.dim_member, "member_id", 42)


@query("point_lookup_card", "card_key b, card_id b, member_id b, credit_limit d, card_status s", "SELECT * FROM dim_credit_card WHERE card_id=11")
def _(c: Context):
    return P.point_lookup(c.wh.dim_credit_card, "card_id", 11)


@query("point_lookup_product", "product_key b, product_id b, product_name s, fee_category s",
       "SELECT * FROM dim_financial_product WHERE product_id=(SELECT min(product_id) FROM financial_products)")
def _(c: Context):
    products = c.wh.dim_financial_product
    least = products.agg(F.min("product_id").alias("product_id"))
    return products.join(F.broadcast(least), "product_id")


@query("search_customers", "customer_id s, first_name s, last_name s, email s, phone s, date_of_birth s" + PAGE,
       "SELECT member_id AS customer_id, *, count(*) OVER () AS total, 1 AS page_number, CAST(ceil(count(*) OVER () / 100.0) AS INT) AS total_pages FROM members WHERE lower(first_name||' '||last_name) LIKE '%r 00000001%' OR lower(email) LIKE '%member7%' "
       "OR phone LIKE '%-00%' ORDER BY member_id LIMIT 100")
def _(c: Context):
    return P.search_customers(c.src.member_ids, name="R 00000001", email="MEMBER7", phone="-00")


@query("search_products", "product_id b, product_name s, product_type s, product_category s, interest_rate d, credit_limit_min d, credit_limit_max d, "
       "minimum_income_required d, minimum_credit_score b, maximum_debt_to_income d, annual_fee d, rewards_program s, benefits s, eligibility_criteria s, is_active o" + PAGE,
       "SELECT *, count(*) OVER () AS total, 1 AS page_number, CAST(ceil(count(*) OVER () / 100.0) AS INT) AS total_pages FROM financial_products WHERE lower(product_name) LIKE '%promo%' ORDER BY product_id LIMIT 100")
def _(c: Context):
    return P.search_products(c.src.financial_products, "PROMO")


@query("contact_projection", "member_id b, first_name s, last_name s, email s, phone s, address s, city s, state s, zip_code s", "SELECT * FROM members")
def _(c: Context):
    return P.contacts(c.src.member_ids)


@query("customer_profile", "customer_id b, name s, annual_income d, date_joined s, member_status s, member_tenure_years b, city s, state s, region s",
       "SELECT member_id AS customer_id, first_name||' '||last_name AS name, member_since AS date_joined, * FROM dim_member WHERE is_current")
def _(c: Context):
    return P.customer_profile(c.wh.dim_member)


@query("active_products", "product_id b, product_name s, for_rules o",
       "SELECT product_id, product_name, false AS for_rules FROM financial_products WHERE is_active UNION ALL "
       "SELECT product_id, product_name, true FROM financial_products WHERE is_active IS NULL OR is_active")
def _(c: Context):
    products = c.src.financial_products
    return P.active_products(products).withColumn("for_rules", F.lit(False)).unionByName(
        P.active_products(products, keep_unknown=True).withColumn("for_rules", F.lit(True)))


@query("active_members", "member_id b", "SELECT member_id FROM members WHERE member_status='active'")
def _(c: Context):
    return P.active_members(c.src.member_ids)


@query("docs_for_customer", "customer_id s, rule_items b, rule_best s, ml_items b, ml_best s", """
SELECT m.member_id AS customer_id, coalesce(r.n, 0) AS rule_items, r.best AS rule_best, coalesce(t.n, 0) AS ml_items, t.best AS ml_best FROM members m
LEFT JOIN (SELECT member_id, count(*) AS n, min(CASE WHEN rank=1 THEN product_name END) AS best FROM rule_top GROUP BY 1) r USING (member_id)
LEFT JOIN (SELECT customer_id, count(*) AS n, min(CASE WHEN rank=1 THEN product_name END) AS best FROM ml_top GROUP BY 1) t ON t.customer_id=m.member_id""")
def _(c: Context):
    from .recommend import ml_docs, rule_docs

    wanted = c.src.member_ids.select(F.col("member_id").alias("customer_id"))
    sides = [D.for_customers(wanted, docs).select(
        "customer_id", F.size("recommendations").alias(f"{name}_items"), F.get("recommendations", F.lit(0))["product_name"].alias(f"{name}_best"))
        for name, docs in (("rule", rule_docs(c)), ("ml", ml_docs(c)))]
    return sides[0].join(sides[1], "customer_id")


@query("customers_for_product", "customer_id s",
       "SELECT member_id AS customer_id FROM rule_top WHERE product_name=(SELECT min(product_name) FROM rule_top)")
def _(c: Context):
    from .recommend import rule_docs

    docs = kept(rule_docs(c), "rule-documents")
    return D.with_product(docs, D.exploded(docs).agg(F.min("product_name").alias("name")).first().name)


@query("display_projection", '"Customer b, Name s, Email s, Phone s, DOB s',
       'SELECT member_id AS "Customer", first_name||\' \'||last_name AS "Name", email AS "Email", phone AS "Phone", date_of_birth AS "DOB" FROM members')
def _(c: Context):
    return P.display(c.src.member_ids).withColumnRenamed("Customer ID", "Customer")


@query("dedupe_columns", "member_id b, member_id_1 b, card_id b", "SELECT m.member_id, c.member_id AS member_id_1, card_id FROM members m JOIN credit_cards c ON m.member_id=c.member_id")
def _(c: Context):
    left, right = c.src.member_ids.select("member_id"), c.src.credit_cards.select("member_id", "card_id")
    return P.unique_columns(left.join(right, left["member_id"] == right["member_id"]))
