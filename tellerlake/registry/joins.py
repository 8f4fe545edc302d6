"""Joins, aggregates, windows and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, num
from ..operators import ordered as O
from ..plans import documents as D
from ..plans import features as FE
from ..plans import marts as M
from ..plans import rules as R
from ..plans import similarity as S
from ..plans import warehouse as W
from .base import ASOF, Context, query
from .oracle_tables import hu

A = f"DATE '{ASOF}'"


@query("lookup_dimension_keys", "payment_id b, member_key b, card_key b, payment_date_key b, payment_method_key b",
       "SELECT payment_key AS payment_id, * FROM fact_payment")
def _(c: Context):
    w = c.wh
    return W.payment_keys(c.src.payment_history, w.current_members, w.current_cards, w.dim_date, w.dim_payment_method)


@query("skipped_payments", "payment_id b, missing s", """
SELECT payment_id, missing FROM (SELECT payment_id, array_to_string(list_filter([CASE WHEN m.member_key IS NULL THEN 'member_key' END,
 CASE WHEN c.card_key IS NULL THEN 'card_key' END, CASE WHEN d.date_key IS NULL THEN 'payment_date_key' END,
 CASE WHEN k.payment_method_key IS NULL THEN 'payment_method_key' END], lambda x: x IS NOT NULL),',') AS missing
FROM payment_history p LEFT JOIN dim_member m ON p.member_id=m.member_id AND m.is_current LEFT JOIN dim_credit_card c ON p.card_id=c.card_id AND c.is_current
 LEFT JOIN dim_date d ON d.date_value=p.payment_date LEFT JOIN dim_payment_method k ON k.payment_method=p.payment_method) WHERE missing<>''""")
def _(c: Context):
    w = c.wh
    lost = W.skipped_payments(c.src.payment_history, w.current_members, w.current_cards, w.dim_date, w.dim_payment_method)
    return lost.withColumn("missing", F.array_join("missing", ","))


@query("card_member_lookup", "card_id b, member_id b, member_key b", "SELECT * FROM dim_credit_card")
def _(c: Context):
    return W.card_rows(c.src.credit_cards, c.wh.current_members, c.asof)


@query("health_key_join", "health_key b, member_key b, assessment_date_key b", "SELECT * FROM fact_financial_health")
def _(c: Context):
    return c.wh.fact_financial_health


@query("payment_history_12m", "payment_id b, customer_id b, payment_amount d, payment_date s, payment_method s, transaction_type s, credit_score b, "
       "annual_income d, is_on_time o, is_full_payment o, payment_ratio d",
       "SELECT p.payment_key AS payment_id, p.member_id AS customer_id, p.payment_status AS transaction_type, p.*, h.credit_score, m.annual_income "
       "FROM pay_year p JOIN dim_member m ON p.member_id=m.member_id LEFT JOIN health_last h ON h.member_id=p.member_id")
def _(c: Context):
    return FE.payment_history_view(c.wh.fact_payment, c.wh.current_members, FE.latest_health(c.src.financial_health_metrics), c.asof)


@query("active_cards_with_balance", "card_id b, customer_id b, card_type s, credit_limit d, current_balance d, interest_rate d, issue_date s, card_age_months b",
       "SELECT c.card_id, c.member_id AS customer_id, c.card_type, c.credit_limit, coalesce(b.current_balance,0) AS current_balance, c.apr_rate AS interest_rate, "
       "c.issue_date, c.card_age_months FROM dim_credit_card c LEFT JOIN balance_last b USING (card_id) WHERE c.is_current AND c.card_status='active'")
def _(c: Context):
    return FE.active_cards(c.wh.dim_credit_card, c.wh.fact_credit_card_balance)


@query("range_similar_customers", "customer_id b, credit_score b, annual_income d, risk_category s, health_score d, utilization_ratio d, "
       "debt_to_income_ratio d, payment_behavior_score d, total_cards b, avg_credit_limit d, total_balance d", f"""
SELECT m.member_id AS customer_id, h.credit_score, m.annual_income, h.risk_category, h.health_score, h.credit_utilization_ratio AS utilization_ratio,
 h.debt_to_income_ratio, h.payment_reliability_score AS payment_behavior_score, count(c.card_id) AS total_cards,
 {hu('CAST(sum(c.credit_limit) AS DOUBLE)/nullif(count(c.card_id),0)', 6)} AS avg_credit_limit, coalesce(sum(b.current_balance),0) AS total_balance
FROM dim_member m JOIN health_last h ON h.member_id=m.member_id LEFT JOIN dim_credit_card c ON c.member_id=m.member_id AND c.is_current
 LEFT JOIN balance_last b ON b.card_id=c.card_id
WHERE h.credit_score BETWEEN 600 AND 720 AND m.annual_income BETWEEN 50000 AND 120000 AND m.member_status='active' AND m.is_current AND m.member_id<>10
GROUP BY ALL ORDER BY h.health_score DESC, m.member_id LIMIT 100""")
def _(c: Context):
    return M.similar_customers(
        c.wh.current_members, FE.latest_health(c.src.financial_health_metrics), c.wh.current_cards,
        FE.latest_balance(c.wh.fact_credit_card_balance), score_range=(600, 720), income_range=(50000, 120000), exclude=10)


_PAIRS_SQL = """FROM members m JOIN health_last h USING (member_id) CROSS JOIN financial_products p"""
_ELIGIBLE_SQL = ("coalesce(m.annual_income>=p.minimum_income_required,true) AND coalesce(h.credit_score>=p.minimum_credit_score,true) "
                 "AND coalesce(h.debt_to_income_ratio<=p.maximum_debt_to_income,true)")


def _catalogue_pairs(c: Context):
    return R.catalogue_pairs(c.src.member_ids, FE.latest_health(c.src.financial_health_metrics), c.src.financial_products)


@query("eligibility_theta_join", "member_id b, product_id b", f"SELECT m.member_id, p.product_id {_PAIRS_SQL} WHERE {_ELIGIBLE_SQL}")
def _(c: Context):
    return _catalogue_pairs(c).filter(R.eligible())


@query("eligible_or_basic", "member_id b, product_id b, eligible o", f"""
SELECT member_id, product_id, eligible FROM (SELECT m.member_id, p.product_id, p.product_category, {_ELIGIBLE_SQL} AS eligible,
 bool_or({_ELIGIBLE_SQL}) OVER (PARTITION BY m.member_id) AS has_any {_PAIRS_SQL})
WHERE eligible OR (NOT has_any AND product_category IN ('basic','secured'))""")
def _(c: Context):
    return R.eligible_or_basic(_catalogue_pairs(c))


@query("skip_existing", "customer_id s", "SELECT member_id AS customer_id FROM members WHERE member_status='active' AND member_id NOT IN (SELECT customer_id FROM accepted_products JOIN financial_products USING (product_id) WHERE product_type='credit_card')")
def _(c: Context):
    cards = c.src.financial_products.filter("product_type = 'credit_card'").select("product_id")
    docs = _accepted(c).join(cards, "product_id").select(F.col("customer_id").cast("string").alias("customer_id"))
    return D.missing_customers(c.src.member_ids, docs)


def _accepted(c: Context):
    return c.src.product_recommendations.filter("recommendation_status = 'accepted'").select(
        F.col("member_id").alias("customer_id"), "product_id").distinct()


@query("exclude_owned_products", "customer_id b, product_id b",
       "SELECT DISTINCT member_id AS customer_id, product_id FROM product_recommendations EXCEPT SELECT customer_id, product_id FROM accepted_products")
def _(c: Context):
    seen = c.src.product_recommendations.select(F.col("member_id").alias("customer_id"), "product_id")
    return S.exclude_owned(seen, _accepted(c)).distinct()


@query("compare_recommendations", "customer_id s, rule_items b, ml_items b, rule_products s, ml_products s", """
SELECT coalesce(a.member_id, b.customer_id) AS customer_id, a.n AS rule_items, b.n AS ml_items, a.products AS rule_products, b.products AS ml_products
FROM (SELECT member_id, count(*) AS n, string_agg(product_name, '|' ORDER BY rank) AS products FROM rule_top GROUP BY 1) a
FULL JOIN (SELECT customer_id, count(*) AS n, string_agg(product_name, '|' ORDER BY rank) AS products FROM ml_top GROUP BY 1) b ON a.member_id=b.customer_id""")
def _(c: Context):
    from .recommend import ml_docs, rule_docs

    def names(side: str):
        return F.array_join(F.transform(f"{side}.recommendations", lambda r: r["product_name"]), "|")

    return D.compared(rule_docs(c), ml_docs(c)).select(
        "customer_id", F.size("rule_based.recommendations").alias("rule_items"), F.size("ml_based.recommendations").alias("ml_items"),
        names("rule_based").alias("rule_products"), names("ml_based").alias("ml_products"))


@query("nl_payments_vs_average", "payment_id b, member_id b, first_name s, last_name s, payment_date s, payment_amount d, avg_payment_amount_last_year d", f"""
SELECT p.payment_id, m.member_id, m.first_name, m.last_name, p.payment_date, p.payment_amount, {hu('a.v', 6)} AS avg_payment_amount_last_year
FROM payment_history p JOIN members m ON m.member_id=p.member_id
JOIN (SELECT member_id, CAST(sum(payment_amount) AS DOUBLE)/count(*) AS v FROM pay_year GROUP BY 1) a ON a.member_id=p.member_id
WHERE p.payment_date >= {A} - INTERVAL 3 MONTH""")
def _(c: Context):
    return M.recent_payments_vs_average(c.src.payment_history, c.src.member_ids, c.wh.fact_payment, c.asof)


@query("nl_balance_vs_utilization", "member_id b, card_id b, current_balance d, credit_limit d, avg_utilization_last_6_months d", f"""
SELECT c.member_id, c.card_id, c.current_balance, c.credit_limit, {hu('CAST(a.u AS DOUBLE)/(a.n*10000.0)', 6)} AS avg_utilization_last_6_months
FROM credit_cards c JOIN (SELECT member_id, sum(CAST(floor(utilization_ratio*10000+0.5) AS BIGINT)) AS u, CAST(count(*) AS DOUBLE) AS n FROM fact_credit_card_balance
 WHERE snapshot_date >= {A} - INTERVAL 6 MONTH GROUP BY 1) a USING (member_id) WHERE c.card_status='active'""")
def _(c: Context):
    return M.balances_vs_utilization(c.src.credit_cards, c.wh.fact_credit_card_balance, c.asof)


@query("nl_health_vs_average", "member_id b, latest_health_score d, avg_health_score_last_year d", f"""
SELECT h.member_id, h.health_score AS latest_health_score, {hu('a.v', 6)} AS avg_health_score_last_year FROM financial_health_metrics h
JOIN (SELECT member_id, CAST(sum(health_score) AS DOUBLE)/count(*) AS v FROM fact_financial_health WHERE assessment_date >= {A} - INTERVAL 12 MONTH GROUP BY 1) a USING (member_id)
WHERE h.assessment_date >= {A} - INTERVAL 1 MONTH""")
def _(c: Context):
    return M.health_vs_average(c.src.financial_health_metrics, c.wh.fact_financial_health, c.asof)


@query("nl_recs_vs_acceptance", "member_id b, product_id b, recommendation_date s, recommendation_score d, acceptance_rate_last_year d", f"""
SELECT r.member_id, r.product_id, r.recommendation_date, r.recommendation_score, {hu('a.v', 6)} AS acceptance_rate_last_year FROM product_recommendations r
JOIN (SELECT product_id, CAST(sum(CASE WHEN recommendation_status='accepted' THEN 1 ELSE 0 END) AS DOUBLE)/count(*) AS v FROM fact_product_recommendation
 WHERE recommendation_date >= {A} - INTERVAL 12 MONTH GROUP BY 1) a USING (product_id) WHERE r.recommendation_date >= {A} - INTERVAL 1 MONTH""")
def _(c: Context):
    return M.recommendations_vs_acceptance(c.src.product_recommendations, c.wh.fact_product_recommendation, c.asof)


@query("batch_customers", "customer_id b, credit_score b, annual_income d, risk_category s, member_status s, health_score d, total b, page_number b, total_pages b", """
SELECT m.member_id AS customer_id, h.credit_score, m.annual_income, h.risk_category, m.member_status, h.health_score,
 (SELECT count(*) FROM dim_member WHERE is_current AND member_status='active') AS total, 2 AS page_number,
 CAST(ceil((SELECT count(*) FROM dim_member WHERE is_current AND member_status='active')/500.0) AS BIGINT) AS total_pages
FROM dim_member m LEFT JOIN health_last h USING (member_id) WHERE m.is_current AND m.member_status='active' ORDER BY m.member_id LIMIT 500 OFFSET 500""")
def _(c: Context):
    people = c.wh.current_members.filter("member_status = 'active'").select("member_id", "annual_income", "member_status")
    health = FE.latest_health(c.src.financial_health_metrics).select("member_id", "credit_score", "risk_category", "health_score")
    paged = O.page(people.join(health, "member_id", "left"), ["member_id"], 500, 500)
    return paged.withColumnRenamed("member_id", "customer_id")


# Aggregates

@query("member_payment_summary", "member_id b, first_name s, last_name s, income_bracket s, employment_status s, total_payments b, avg_payment_amount d, "
       "on_time_rate d, total_late_fees d, avg_days_late d", f"""
SELECT m.member_id, m.first_name, m.last_name, m.income_bracket, m.employment_status, count(*) AS total_payments,
 {hu('CAST(sum(f.payment_amount) AS DOUBLE)/count(*)', 6)} AS avg_payment_amount, {hu('CAST(sum(f.is_on_time::INT) AS DOUBLE)/count(*)', 6)} AS on_time_rate,
 sum(f.late_fee) AS total_late_fees, {hu('CAST(sum(f.days_late) AS DOUBLE)/count(*)', 6)} AS avg_days_late
FROM dim_member m JOIN fact_payment f ON f.member_key=m.member_key WHERE m.is_current GROUP BY ALL""")
def _(c: Context):
    return M.member_payment_summary(c.wh.fact_payment, c.wh.current_members)


@query("product_recommendation_metrics", "product_id b, product_name s, product_type s, product_category s, total_recommendations b, accepted_count b, "
       "acceptance_rate d, avg_recommendation_score d", f"""
SELECT p.product_id, p.product_name, p.product_type, p.product_category, count(*) AS total_recommendations,
 sum(CASE WHEN f.recommendation_status='accepted' THEN 1 ELSE 0 END) AS accepted_count,
 {hu("CAST(sum(CASE WHEN f.recommendation_status='accepted' THEN 1 ELSE 0 END) AS DOUBLE)/count(*)", 6)} AS acceptance_rate,
 {hu('CAST(sum(f.recommendation_score) AS DOUBLE)/count(*)', 6)} AS avg_recommendation_score
FROM dim_financial_product p JOIN fact_product_recommendation f ON f.product_key=p.product_key GROUP BY ALL""")
def _(c: Context):
    return M.product_recommendation_metrics(c.wh.fact_product_recommendation, c.wh.dim_financial_product)


@query("member_health_trends", "member_id b, first_name s, last_name s, year b, month_number b, month_name s, avg_health_score d, avg_credit_score d, "
       "avg_debt_to_income d, avg_credit_utilization d", f"""
SELECT m.member_id, m.first_name, m.last_name, d.year, d.month_number, d.month_name, {hu('CAST(sum(f.health_score) AS DOUBLE)/count(*)', 6)} AS avg_health_score,
 {hu('CAST(sum(f.credit_score) AS DOUBLE)/count(*)', 6)} AS avg_credit_score, {hu('CAST(sum(f.debt_to_income_ratio) AS DOUBLE)/count(*)', 6)} AS avg_debt_to_income,
 {hu('CAST(sum(f.credit_utilization_ratio) AS DOUBLE)/count(*)', 6)} AS avg_credit_utilization
FROM dim_member m JOIN fact_financial_health f ON f.member_key=m.member_key JOIN dim_date d ON d.date_key=f.assessment_date_key WHERE m.is_current
GROUP BY ALL ORDER BY m.member_id, d.year, d.month_number""")
def _(c: Context):
    return M.member_health_trends(c.wh.fact_financial_health, c.wh.current_members, c.wh.dim_date)


@query("payment_method_usage", "payment_method s, usage_count b, avg_payment_amount d, on_time_count b, late_count b, on_time_rate d", f"""
SELECT payment_method, count(*) AS usage_count, {hu('CAST(sum(payment_amount) AS DOUBLE)/count(*)', 6)} AS avg_payment_amount,
 sum((payment_status='on_time')::INT) AS on_time_count, sum((payment_status='late')::INT) AS late_count,
 {hu("CAST(sum((payment_status='on_time')::INT) AS DOUBLE)/count(*)", 6)} AS on_time_rate
FROM payment_history WHERE payment_method IS NOT NULL AND payment_method<>'' GROUP BY 1 ORDER BY 2 DESC, 1""")
def _(c: Context):
    return W.payment_method_usage(c.src.payment_history).orderBy(F.desc("usage_count"), "payment_method")


@query("card_rollup", "member_id b, total_credit_cards b, total_credit_limit d, total_credit_balance d, avg_credit_limit d, max_credit_limit d, avg_interest_rate d",
       "SELECT m.member_id, coalesce(total_credit_cards,0) AS total_credit_cards, coalesce(total_credit_limit,0) AS total_credit_limit, "
       "coalesce(total_credit_balance,0) AS total_credit_balance, coalesce(avg_credit_limit,0) AS avg_credit_limit, coalesce(max_credit_limit,0) AS max_credit_limit, "
       "coalesce(avg_interest_rate,0) AS avg_interest_rate FROM members m LEFT JOIN card_roll USING (member_id)")
def _(c: Context):
    rolled = FE.card_rollup(c.wh.dim_credit_card, c.wh.fact_credit_card_balance)
    return c.src.member_ids.select("member_id").join(rolled, "member_id", "left").fillna(0)


@query("active_card_metrics", "member_id b, total_credit_limit d, total_balance d, utilization_ratio d, num_active_cards b, avg_apr d, total_available_credit d",
       f"""SELECT member_id, coalesce(total_credit_limit,0) AS total_credit_limit, coalesce(total_balance,0) AS total_balance, {hu('coalesce(utilization_ratio,0)', 6)} AS utilization_ratio,
        coalesce(num_active_cards,0) AS num_active_cards, {hu('coalesce(avg_apr,0.2)', 6)} AS avg_apr, coalesce(total_available_credit,0) AS total_available_credit
        FROM members LEFT JOIN card_active USING (member_id)""")
def _(c: Context):
    metrics = FE.active_card_metrics(c.src.credit_cards)
    joined = c.src.member_ids.select("member_id").join(metrics, "member_id", "left").fillna({"avg_apr": FE.DEFAULT_APR}).fillna(0)
    return joined.withColumns({"utilization_ratio": half_up(F.col("utilization_ratio"), 6), "avg_apr": half_up(F.col("avg_apr"), 6)})


@query("payment_behaviour", "member_id b, on_time_payment_rate d, avg_days_late d, total_late_fees d, payment_method_preference s",
       f"""SELECT member_id, {hu('coalesce(on_time_payment_rate,1.0)', 6)} AS on_time_payment_rate, {hu('coalesce(avg_days_late,0.0)', 6)} AS avg_days_late,
        coalesce(total_late_fees,0.0) AS total_late_fees, coalesce(payment_method_preference,'online') AS payment_method_preference
        FROM members LEFT JOIN pay_behaviour USING (member_id)""")
def _(c: Context):
    joined = c.src.member_ids.select("member_id").join(FE.payment_behaviour(c.src.payment_history), "member_id", "left").fillna(
        {"on_time_payment_rate": FE.DEFAULT_ON_TIME, "avg_days_late": 0.0, "total_late_fees": 0.0, "payment_method_preference": FE.DEFAULT_METHOD})
    return joined.withColumns({n: half_up(F.col(n), 6) for n in ("on_time_payment_rate", "avg_days_late")})


def _stats(c: Context):
    return FE.payment_stats(FE.recent_payments(c.wh.fact_payment, c.asof), id_column="payment_key")


@query("payment_consistency", "member_id b, payment_consistency d", "SELECT * FROM pay_stats")
def _(c: Context):
    return _stats(c)


@query("payment_trend", "member_id b, payment_frequency b, payment_trend d, total_payment_amount d, avg_payment_amount d", "SELECT * FROM pay_stats")
def _(c: Context):
    return _stats(c)


@query("avg_payment_interval", "member_id b, avg_days_between_payments d", "SELECT * FROM pay_stats")
def _(c: Context):
    return _stats(c)


@query("customer_count", "customer_count b", "SELECT count(*) AS customer_count FROM dim_member WHERE member_status='active' AND is_current")
def _(c: Context):
    return c.wh.current_members.filter("member_status = 'active'").agg(F.count("*").alias("customer_count"))


@query("daily_query_volume", "date s, total_queries b", "SELECT CAST(ts AS DATE) AS date, count(*) AS total_queries FROM events GROUP BY 1")
def _(c: Context):
    from ..plans.statements import daily_counter, daily_volume

    return daily_volume(daily_counter(c.raw("events"), ["event_type", "user_id"]))


@query("top_members_by_payments", "member_id b, first_name s, last_name s, total_payment_amount d",
       "SELECT m.member_id, first_name, last_name, sum(payment_amount) AS total_payment_amount FROM dim_member m JOIN fact_payment f ON f.member_key=m.member_key "
       "JOIN dim_date d ON d.date_key=f.payment_date_key WHERE d.year=2001 GROUP BY ALL ORDER BY total_payment_amount DESC, m.member_id LIMIT 5")
def _(c: Context):
    return M.top_members_by_payments(c.wh.fact_payment, c.wh.current_members, c.wh.dim_date, 2001)


@query("risk_distribution", "risk_category s, n b, share_percent d",
       f"SELECT risk_category, count(*) AS n, {hu('CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM financial_health_metrics)*100', 1)} AS share_percent FROM financial_health_metrics GROUP BY 1")
def _(c: Context):
    return M.risk_distribution(c.src.financial_health_metrics)


@query("portfolio_ratios", "cards_per_member d, payments_per_card d, recommendations_per_member d", f"""
SELECT {hu('CAST(c AS DOUBLE)/m', 1)} AS cards_per_member, {hu('CAST(p AS DOUBLE)/c', 1)} AS payments_per_card, {hu('CAST(r AS DOUBLE)/m', 1)} AS recommendations_per_member
FROM (SELECT (SELECT count(*) FROM members) AS m, (SELECT count(*) FROM credit_cards) AS c, (SELECT count(*) FROM payment_history) AS p, (SELECT count(*) FROM product_recommendations) AS r)""")
def _(c: Context):
    return M.portfolio_ratios(c.src.member_ids, c.src.credit_cards, c.src.payment_history, c.src.product_recommendations)


def _derived(c: Context):
    jitter = (F.col("member_id") * 13) % 41 - 20
    return R.derive_health(c.src.member_ids, c.src.credit_cards, c.src.payment_history, jitter, F.col("income") * (F.col("member_id") % 10) / 50)


@query("derive_health_metrics", "member_id b, credit_score b, debt_to_income_ratio d, credit_utilization_ratio d, payment_reliability_score d, total_debt d, health_score d, risk_category s",
       "SELECT * FROM financial_health_metrics WHERE assessment_date=DATE '2001-06-15'")
def _(c: Context):
    return _derived(c)


@query("payments_by_region", "region s, income_bracket s, total_payments b, total_paid d, members b",
       "SELECT m.region, m.income_bracket, count(*) AS total_payments, sum(f.payment_amount) AS total_paid, count(DISTINCT m.member_id) AS members "
       "FROM dim_member m JOIN fact_payment f ON f.member_key=m.member_key GROUP BY ROLLUP (m.region, m.income_bracket)")
def _(c: Context):
    return M.payments_by_region(c.wh.fact_payment, c.wh.current_members)


# Windows

@query("last_12_payments", "payment_id b, member_id b, payment_date s, recency b", "SELECT * FROM pay12")
def _(c: Context):
    return FE.last_payments(c.src.payment_history)


@query("latest_health", "metric_id b, member_id b, credit_score b, health_score d, savings_rate d",
       f"SELECT h.*, {hu('CAST(savings_balance AS DOUBLE)/nullif(CAST(annual_income AS DOUBLE),0)', 6)} AS savings_rate FROM health_last h JOIN members USING (member_id)")
def _(c: Context):
    latest = FE.latest_health(c.src.financial_health_metrics).join(c.src.member_ids.select("member_id", "annual_income"), "member_id")
    return latest.withColumn("savings_rate", half_up(num("savings_balance") / F.nullif(num("annual_income"), F.lit(0.0)), 6))


@query("latest_balance", "card_id b, snapshot_date_key b, current_balance d, utilization_ratio d", "SELECT * FROM balance_last")
def _(c: Context):
    return FE.latest_balance(c.wh.fact_credit_card_balance)


@query("balance_trend", "card_id b, snapshot_date_key b, current_balance d, balance_trend s", "SELECT * FROM fact_credit_card_balance")
def _(c: Context):
    return c.wh.fact_credit_card_balance


@query("payment_gaps", "payment_id b, member_id b, payment_date s, previous_day s, gap_days b",
       "SELECT *, datediff('day',previous_day,payment_date) AS gap_days FROM (SELECT *, lag(payment_date) OVER (PARTITION BY member_id ORDER BY payment_date, payment_id) AS previous_day FROM payment_history)")
def _(c: Context):
    rows = c.src.payment_history.select("payment_id", "member_id", "payment_date")
    return O.previous_day(rows, "member_id", "payment_date", "payment_id").withColumn("gap_days", F.datediff("payment_date", "previous_day"))


@query("scd2_validity", "member_id b, effective_date s, expiry_date s, is_current o",
       "SELECT *, expiry_date IS NULL AS is_current FROM (SELECT member_id, d AS effective_date, lead(d) OVER (PARTITION BY member_id ORDER BY d) AS expiry_date "
       "FROM (SELECT DISTINCT o_custkey+1 AS member_id, CAST(o_orderdate AS DATE) AS d FROM orders))")
def _(c: Context):
    from ..operators.keyed import validity

    versions = c.raw("orders").select((F.col("o_custkey") + 1).alias("member_id"), F.to_date("o_orderdate").alias("effective_date"))
    return validity(versions, "member_id")


# Sorts and limits

@query("top_n_global", "payment_id b, payment_amount d", "SELECT * FROM payment_history ORDER BY payment_amount DESC, payment_id LIMIT 100")
def _(c: Context):
    return c.src.payment_history.orderBy(F.desc("payment_amount"), "payment_id").limit(100)


@query("top_n_per_customer", "member_id b, payment_id b, payment_amount d, place b",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY payment_amount DESC, payment_id) AS place FROM payment_history) WHERE place<=5")
def _(c: Context):
    w = Window.partitionBy("member_id").orderBy(F.desc("payment_amount"), "payment_id")
    return c.src.payment_history.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 5)


@query("batch_numbers", "member_id b, batch_number b",
       "SELECT member_id, (row_number() OVER (ORDER BY member_id)-1)//100+1 AS batch_number FROM members WHERE member_status='active'")
def _(c: Context):
    active = c.src.member_ids.filter("member_status = 'active'").select("member_id")
    return O.number_rows(active, "member_id").withColumn("batch_number", F.floor((F.col("position") - 1) / 100) + 1)


# Set operations

@query("product_history_union", "customer_id b, product_id s, product_name s, product_type s, relationship_status s", """
SELECT r.member_id AS customer_id, CAST(r.product_id AS VARCHAR) AS product_id, p.product_name, p.product_type, 'existing' AS relationship_status
FROM product_recommendations r JOIN financial_products p USING (product_id) WHERE r.recommendation_status='accepted'
UNION SELECT member_id, 'card_'||card_id, card_type||' Card', 'credit_card', card_status FROM dim_credit_card WHERE is_current""")
def _(c: Context):
    return M.product_history(c.wh.current_members, c.src.product_recommendations, c.src.financial_products, c.wh.current_cards)


_STAR = ["dim_date", "dim_payment_method", "dim_financial_product", "dim_member", "dim_credit_card", "fact_payment", "fact_financial_health",
         "fact_product_recommendation", "fact_credit_card_balance"]


@query("warehouse_row_counts", "table_name s, row_count b", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _STAR))
def _(c: Context):
    return M.row_counts({t: c.wh.table(t) for t in _STAR})


@query("unique_customers_union", "customers b",
       "SELECT count(*) AS customers FROM (SELECT member_id FROM product_recommendations UNION SELECT member_id FROM credit_cards)")
def _(c: Context):
    both = c.src.product_recommendations.select("member_id").union(c.src.credit_cards.select("member_id"))
    return both.distinct().agg(F.count("*").alias("customers"))
