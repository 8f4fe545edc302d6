"""Scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import dates as DT
from ..functions import encodings as E
from ..functions import text as X
from ..functions.numbers import num, ratio_or_zero
from ..plans import features as FE
from .base import Context, query
from .oracle_tables import ASOF as A
from .oracle_tables import hu


@query("age_group", "member_id b, age_group s", "SELECT * FROM dim_member")
def _(c: Context):
    return c.src.member_ids.select("member_id", B.age_group(F.col("date_of_birth"), c.asof).alias("age_group"))


@query("region", "member_id b, region s", "SELECT * FROM dim_member")
def _(c: Context):
    return c.src.member_ids.select("member_id", B.region(F.col("state")).alias("region"))


@query("income_bracket", "member_id b, income_bracket s", "SELECT * FROM dim_member")
def _(c: Context):
    return c.src.member_ids.select("member_id", B.income_bracket(F.col("annual_income")).alias("income_bracket"))


@query("tenure_years", "member_id b, member_tenure_years b", "SELECT * FROM dim_member")
def _(c: Context):
    return c.src.members.select("member_id", DT.tenure_years(F.col("member_since"), c.asof).alias("member_tenure_years"))


@query("credit_limit_tier", "card_id b, credit_limit_tier s", "SELECT * FROM dim_credit_card")
def _(c: Context):
    return c.src.credit_cards.select("card_id", B.credit_limit_tier(F.col("credit_limit")).alias("credit_limit_tier"))


@query("apr_category", "card_id b, apr_category s", "SELECT * FROM dim_credit_card")
def _(c: Context):
    return c.src.credit_cards.select("card_id", B.apr_category(F.col("apr_rate")).alias("apr_category"))


@query("card_age_months", "card_id b, card_age_months b", "SELECT * FROM dim_credit_card")
def _(c: Context):
    return c.src.credit_cards.select("card_id", DT.months_apart(F.col("issue_date"), c.asof).alias("card_age_months"))


@query("repair_date", "card_id b, expiry_date s", "SELECT * FROM dim_credit_card")
def _(c: Context):
    return c.src.credit_cards.select("card_id", DT.repair_date(F.col("expiry_date")).alias("expiry_date"))


@query("interest_rate_tier", "product_id b, interest_rate_tier s", "SELECT * FROM dim_financial_product")
def _(c: Context):
    return c.src.financial_products.select("product_id", B.interest_rate_tier(F.col("interest_rate")).alias("interest_rate_tier"))


@query("fee_category", "product_id b, fee_category s", "SELECT * FROM dim_financial_product")
def _(c: Context):
    return c.src.financial_products.select("product_id", B.fee_category(F.col("annual_fee")).alias("fee_category"))


@query("has_rewards", "product_id b, has_rewards o", "SELECT * FROM dim_financial_product")
def _(c: Context):
    return c.src.financial_products.select("product_id", B.has_rewards(F.col("rewards_program")).alias("has_rewards"))


@query("eligibility_tier", "product_id b, eligibility_tier s", "SELECT * FROM dim_financial_product")
def _(c: Context):
    return c.wh.dim_financial_product


@query("payment_channel", "payment_id b, payment_channel s", "SELECT p.payment_id, coalesce(k.payment_channel,'Unknown') AS payment_channel FROM payment_history p LEFT JOIN dim_payment_method k USING (payment_method)")
def _(c: Context):
    return c.src.payment_history.select("payment_id", B.payment_channel(F.col("payment_method")).alias("payment_channel"))


@query("convenience_score", "payment_id b, convenience_score b", "SELECT p.payment_id, coalesce(k.convenience_score,0) AS convenience_score FROM payment_history p LEFT JOIN dim_payment_method k USING (payment_method)")
def _(c: Context):
    return c.src.payment_history.select("payment_id", B.convenience_score(F.col("payment_method")).alias("convenience_score"))


@query("payment_ratio", "payment_key b, payment_ratio d", "SELECT * FROM fact_payment")
def _(c: Context):
    return c.wh.fact_payment


@query("excess_payment", "payment_key b, excess_payment d", "SELECT * FROM fact_payment")
def _(c: Context):
    return c.wh.fact_payment


@query("payment_flags", "payment_key b, is_on_time o, is_full_payment o, is_minimum_payment o, is_over_payment o", "SELECT * FROM fact_payment")
def _(c: Context):
    return c.wh.fact_payment


@query("net_worth", "health_key b, total_liquid_assets d, net_worth d, debt_to_assets_ratio d", "SELECT * FROM fact_financial_health")
def _(c: Context):
    return c.wh.fact_financial_health


@query("liquid_assets", "health_key b, total_liquid_assets d", "SELECT * FROM fact_financial_health")
def _(c: Context):
    return c.wh.fact_financial_health


@query("debt_to_assets", "health_key b, debt_to_assets_ratio d", "SELECT * FROM fact_financial_health")
def _(c: Context):
    return c.wh.fact_financial_health


@query("credit_score_tier", "metric_id b, credit_score_tier s", "SELECT * FROM fact_financial_health")
def _(c: Context):
    return c.src.financial_health_metrics.select("metric_id", B.credit_score_tier(F.col("credit_score")).alias("credit_score_tier"))


@query("utilization_tier", "metric_id b, utilization_tier s", "SELECT * FROM fact_financial_health")
def _(c: Context):
    return c.src.financial_health_metrics.select("metric_id", B.utilization_tier(F.col("credit_utilization_ratio")).alias("utilization_tier"))


@query("fiscal_attributes", "o_orderkey b, fiscal_year b, fiscal_quarter b, fiscal_month b", """
SELECT o_orderkey, CASE WHEN month(o_orderdate)>=7 THEN year(o_orderdate) ELSE year(o_orderdate)-1 END AS fiscal_year, (fm-1)//3+1 AS fiscal_quarter, fm AS fiscal_month
FROM (SELECT *, CASE WHEN month(o_orderdate)>=7 THEN month(o_orderdate)-6 ELSE month(o_orderdate)+6 END AS fm FROM orders)""")
def _(c: Context):
    return c.raw("orders").select("o_orderkey", *[v.alias(n) for n, v in DT.fiscal(F.to_date("o_orderdate"), 7).items()])


@query("is_holiday", "o_orderkey b, is_holiday o", "SELECT o_orderkey, is_holiday FROM orders JOIN dim_date ON date_value=CAST(o_orderdate AS DATE)")
def _(c: Context):
    return c.raw("orders").select("o_orderkey", DT.is_holiday(F.to_date("o_orderdate")).alias("is_holiday"))


_DATE_SPEC = ("date_key b, date_value s, day_of_week b, day_name s, day_of_month b, day_of_year b, week_of_year b, month_number b, month_name s, "
              "quarter b, year b, is_weekend o, is_holiday o, fiscal_year b, fiscal_quarter b, fiscal_month b")


@query("date_attributes", "o_orderkey b, " + _DATE_SPEC, "SELECT o_orderkey, d.* FROM orders JOIN dim_date d ON date_value=CAST(o_orderdate AS DATE)")
def _(c: Context):
    return c.raw("orders").select("o_orderkey", *[v.alias(n) for n, v in DT.calendar_columns(F.to_date("o_orderdate")).items()])


@query("encode_risk", "metric_id b, code b",
       "SELECT metric_id, CASE risk_category WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS code FROM financial_health_metrics")
def _(c: Context):
    return c.src.financial_health_metrics.select("metric_id", E.encode_risk(F.col("risk_category")).alias("code"))


@query("decode_risk", "metric_id b, decoded s", "SELECT metric_id, risk_category AS decoded FROM financial_health_metrics")
def _(c: Context):
    return c.src.financial_health_metrics.select("metric_id", E.decode_risk(E.encode_risk(F.col("risk_category"))).alias("decoded"))


@query("encode_status", "member_id b, code b", "SELECT member_id, CASE member_status WHEN 'active' THEN 1 WHEN 'suspended' THEN -1 ELSE 0 END AS code FROM members")
def _(c: Context):
    return c.src.member_ids.select("member_id", E.encode_status(F.col("member_status")).alias("code"))


@query("safe_divide", "card_id b, ratio d", f"SELECT card_id, CASE WHEN credit_limit IS NULL OR credit_limit=0 THEN 0.0 ELSE {hu('CAST(current_balance AS DOUBLE)/CAST(credit_limit AS DOUBLE)', 4)} END AS ratio FROM credit_cards")
def _(c: Context):
    return c.src.credit_cards.select("card_id", ratio_or_zero(F.col("current_balance"), F.col("credit_limit")).alias("ratio"))


@query("tenure_days", "member_id b, tenure_days b", f"SELECT member_id, datediff('day',member_since,{A}) AS tenure_days FROM members")
def _(c: Context):
    return c.src.members.select("member_id", DT.days_since(F.col("member_since"), c.asof).alias("tenure_days"))


@query("age", "member_id b, age b", f"SELECT member_id, datediff('day',date_of_birth,{A})//365 AS age FROM members")
def _(c: Context):
    return c.src.member_ids.select("member_id", F.floor(DT.days_since(F.col("date_of_birth"), c.asof) / 365).alias("age"))


@query("coalesce_profile_defaults", "member_id b, age_group s, income_bracket s, member_tenure_months b, total_products_owned b, financial_stability_score d, payment_trend s",
       f"""SELECT m.member_id, CASE WHEN m.member_status='active' THEN m.age_group ELSE '26-35' END AS age_group, m.income_bracket,
        coalesce((SELECT max(card_age_months) FROM dim_credit_card k WHERE k.member_id=m.member_id),12) AS member_tenure_months,
        coalesce((SELECT count(*) FROM accepted_products a WHERE a.customer_id=m.member_id HAVING count(*)>0),1) AS total_products_owned,
        coalesce((SELECT CAST(max(health_score) AS DOUBLE) FROM health_last h WHERE h.member_id=m.member_id AND h.risk_category<>'high'),75.0) AS financial_stability_score,
        'stable' AS payment_trend FROM dim_member m""")
def _(c: Context):
    people = c.wh.current_members.select("member_id", F.when(F.col("member_status") == "active", F.col("age_group")).alias("age_group"), "income_bracket")
    oldest = c.src.credit_cards.groupBy("member_id").agg(F.max(DT.months_apart(F.col("issue_date"), c.asof)).alias("member_tenure_months"))
    owned = c.src.product_recommendations.filter("recommendation_status = 'accepted'").groupBy("member_id").agg(F.count_distinct("product_id").alias("total_products_owned"))
    health = FE.latest_health(c.src.financial_health_metrics).filter("risk_category <> 'high'").select("member_id", num("health_score").alias("financial_stability_score"))
    joined = people.join(oldest, "member_id", "left").join(owned, "member_id", "left").join(health, "member_id", "left").withColumn(
        "payment_trend", F.lit(None).cast("string"))
    names = ["age_group", "income_bracket", "member_tenure_months", "total_products_owned", "financial_stability_score", "payment_trend"]
    return joined.withColumns(E.profile_with_defaults(names))


@query("available_credit", "card_id b, available_credit d", "SELECT card_id, credit_limit-current_balance AS available_credit FROM credit_cards")
def _(c: Context):
    return c.src.credit_cards.select("card_id", (F.col("credit_limit") - F.col("current_balance")).alias("available_credit"))


@query("money_percent_text", "metric_id b, debt_text s, dti_text s",
       "SELECT metric_id, '$'||format('{:,}',CAST(floor(CAST(total_debt AS DOUBLE)+0.5) AS BIGINT)) AS debt_text, "
       "printf('%.1f%%',floor(CAST(debt_to_income_ratio AS DOUBLE)*100*10+0.5)/10) AS dti_text FROM financial_health_metrics")
def _(c: Context):
    return c.src.financial_health_metrics.select("metric_id", X.money(F.col("total_debt")).alias("debt_text"),
                                                 X.percent(F.col("debt_to_income_ratio")).alias("dti_text"))


@query("role_source_grant", "user_id b, may_read_oltp o, may_read_dw o", """
SELECT user_id, bool_or(role IN ('OLTP','OPS')) AS may_read_oltp, bool_or(role IN ('MULTI_DB_USER','DW')) AS may_read_dw FROM (
 SELECT DISTINCT user_id, CASE event_type WHEN 'view' THEN 'DW' WHEN 'purchase' THEN 'OPS' WHEN 'click' THEN 'READONLY' WHEN 'signup' THEN 'OLTP' ELSE 'MULTI_DB_USER' END AS role
 FROM events) GROUP BY 1""")
def _(c: Context):
    event = F.col("event_type")
    role = F.when(event == "view", "DW").when(event == "purchase", "OPS").when(event == "click", "READONLY").when(
        event == "signup", "OLTP").otherwise("MULTI_DB_USER")
    roles = c.raw("events").groupBy("user_id").agg(F.collect_set(role).alias("roles"))
    return roles.select("user_id", *[v.alias(n) for n, v in E.granted_sources(F.col("roles")).items()])
