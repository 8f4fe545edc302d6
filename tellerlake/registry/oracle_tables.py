"""Derived tables as plain SQL, written apart from the Spark plans; oracles name them freely."""

from __future__ import annotations

from ..functions import bands as B
from ..functions import encodings as E
from ..sources import derivation_sql as D

ASOF = "DATE '2002-01-01'"


def hu(value: str, digits: int) -> str:
    """Half-up rounding as both engines compute it."""
    return f"(floor(CAST({value} AS DOUBLE)*1e{digits}+0.5)/1e{digits})"


def words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def years(since: str) -> str:
    return (f"(year({ASOF})-year({since})-CASE WHEN strftime({ASOF},'%m%d')<strftime({since},'%m%d') THEN 1 ELSE 0 END)")


_AGE = years("date_of_birth")
_REGION = " ".join(f"WHEN upper(state) IN ({words(v)}) THEN '{k}'" for k, v in B.REGION_STATES.items())
_SOURCE = {"customer": "customer", "orders": "orders", "lineitem": "lineitem", "part": "part"}

TABLES: dict[str, str] = {
    "members": D.MEMBERS.format(member_since=D.SINCE_COLUMN, since_join=D.SINCE_JOIN.format(orders="orders"), customer="customer"),
    "credit_cards": D.CREDIT_CARDS.format(**_SOURCE),
    "payment_history": D.PAYMENT_HISTORY.format(**_SOURCE),
    "financial_products": D.FINANCIAL_PRODUCTS.format(**_SOURCE),
    "financial_health_metrics": D.HEALTH.format(members=D.HEALTH_MEMBERS, credit_cards="credit_cards", payment_history="payment_history"),
    "product_recommendations": D.RECOMMENDATIONS.format(members="members", financial_products="financial_products",
                                                        match=D.RECOMMENDATION_MATCH),
    "dim_date": """
SELECT CAST(strftime(d,'%Y%m%d') AS INT) AS date_key, d AS date_value, isodow(d) AS day_of_week, dayname(d) AS day_name,
 day(d) AS day_of_month, dayofyear(d) AS day_of_year, weekofyear(d) AS week_of_year, month(d) AS month_number,
 monthname(d) AS month_name, quarter(d) AS quarter, year(d) AS year, isodow(d) >= 6 AS is_weekend,
 (strftime(d,'%m-%d') IN ('01-01','07-04','12-25') OR (month(d)=5 AND isodow(d)=1 AND month(d+7)<>5)
  OR (month(d)=9 AND isodow(d)=1 AND month(d-7)<>9) OR (month(d)=11 AND isodow(d)=4 AND (day(d)-1)//7=3)) AS is_holiday,
 year(d) AS fiscal_year, quarter(d) AS fiscal_quarter, month(d) AS fiscal_month
FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d)""",
    "dim_member": f"""
SELECT member_id*100000+datediff('day',DATE '1970-01-01',{ASOF}) AS member_key, m.*,
 CASE WHEN date_of_birth IS NULL THEN 'Unknown' WHEN {_AGE}<18 THEN 'Under 18' WHEN {_AGE}<=25 THEN '18-25' WHEN {_AGE}<=35 THEN '26-35'
  WHEN {_AGE}<=45 THEN '36-45' WHEN {_AGE}<=55 THEN '46-55' WHEN {_AGE}<=65 THEN '56-65' ELSE '65+' END AS age_group,
 CASE WHEN state IS NULL OR state='' THEN 'Unknown' {_REGION} ELSE 'Other' END AS region,
 CASE WHEN annual_income IS NULL OR annual_income=0 THEN 'Unknown' WHEN annual_income<25000 THEN 'Low' WHEN annual_income<50000 THEN 'Medium'
  WHEN annual_income<100000 THEN 'High' ELSE 'Premium' END AS income_bracket,
 coalesce(greatest(0,{years('member_since')}),0) AS member_tenure_years, {ASOF} AS effective_date, CAST(NULL AS DATE) AS expiry_date, true AS is_current
FROM members m""",
    "dim_credit_card": f"""
SELECT c.card_id*100000+datediff('day',DATE '1970-01-01',{ASOF}) AS card_key, c.card_id, m.member_id, m.member_key, card_type, credit_limit,
 CASE WHEN credit_limit IS NULL OR credit_limit=0 THEN 'Unknown' WHEN credit_limit<1000 THEN 'Low' WHEN credit_limit<5000 THEN 'Medium'
  WHEN credit_limit<10000 THEN 'High' ELSE 'Premium' END AS credit_limit_tier, apr_rate,
 CASE WHEN apr_rate IS NULL OR apr_rate=0 THEN 'Unknown' WHEN apr_rate<0.10 THEN 'Low' WHEN apr_rate<0.20 THEN 'Medium' ELSE 'High' END AS apr_category,
 card_status, issue_date, coalesce(try_cast(c.expiry_date AS DATE), CASE WHEN c.expiry_date LIKE '%-02-29' THEN CAST(left(c.expiry_date,4)||'-02-28' AS DATE) END) AS expiry_date,
 coalesce(greatest(0,(year({ASOF})-year(issue_date))*12+month({ASOF})-month(issue_date)),0) AS card_age_months,
 {ASOF} AS effective_date, CAST(NULL AS DATE) AS expiry_date_scd, true AS is_current
FROM credit_cards c JOIN dim_member m ON c.member_id=m.member_id AND m.is_current""",
    "dim_financial_product": """
SELECT product_id AS product_key, p.*,
 CASE WHEN interest_rate IS NULL THEN 'Unknown' WHEN interest_rate<0.05 THEN 'Low' WHEN interest_rate<0.15 THEN 'Medium' ELSE 'High' END AS interest_rate_tier,
 CASE WHEN annual_fee IS NULL THEN 'Unknown' WHEN annual_fee=0 THEN 'No Fee' WHEN annual_fee<100 THEN 'Low Fee' ELSE 'High Fee' END AS fee_category,
 coalesce(length(trim(rewards_program))>0,false) AS has_rewards,
 CASE WHEN parts=0 THEN 'Unknown' WHEN strict*1.0/parts<1.5 THEN 'Easy' WHEN strict*1.0/parts<2.5 THEN 'Medium' ELSE 'Strict' END AS eligibility_tier
FROM (SELECT *, (minimum_credit_score IS NOT NULL)::INT+(minimum_income_required IS NOT NULL)::INT+(maximum_debt_to_income IS NOT NULL)::INT AS parts,
  CASE WHEN coalesce(minimum_credit_score,0)=0 THEN 0 WHEN minimum_credit_score<600 THEN 1 WHEN minimum_credit_score<700 THEN 2 ELSE 3 END
  +CASE WHEN coalesce(minimum_income_required,0)=0 THEN 0 WHEN minimum_income_required<30000 THEN 1 WHEN minimum_income_required<60000 THEN 2 ELSE 3 END
  +CASE WHEN coalesce(maximum_debt_to_income,0)=0 THEN 0 WHEN maximum_debt_to_income>0.5 THEN 1 WHEN maximum_debt_to_income>0.35 THEN 2 ELSE 3 END AS strict
  FROM financial_products) p""",
    "dim_payment_method": """
SELECT * FROM (VALUES (1,'auto_pay','Digital',5),(2,'online','Digital',4),(3,'phone','Digital',3),(4,'mail','Physical',2),(5,'branch','Physical',1))
 t(payment_method_key, payment_method, payment_channel, convenience_score)""",
    "fact_payment": f"""
SELECT p.payment_id AS payment_key, m.member_key, c.card_key, d.date_key AS payment_date_key, k.payment_method_key, p.member_id, p.card_id,
 p.payment_date, p.payment_method, p.payment_amount, p.minimum_due, p.statement_balance, p.late_fee, p.days_late,
 CASE WHEN p.minimum_due>0 AND p.payment_amount<>0 THEN {hu('least(CAST(p.payment_amount AS DOUBLE)/CAST(p.minimum_due AS DOUBLE),9.9999)',4)} END AS payment_ratio,
 p.payment_amount-p.minimum_due AS excess_payment, coalesce(p.payment_status='on_time',false) AS is_on_time,
 coalesce(p.payment_amount>=p.statement_balance,false) AS is_full_payment, coalesce(p.payment_amount>=p.minimum_due,false) AS is_minimum_payment,
 coalesce(p.payment_amount>p.statement_balance,false) AS is_over_payment, p.payment_status
FROM payment_history p JOIN dim_member m ON p.member_id=m.member_id AND m.is_current JOIN dim_credit_card c ON p.card_id=c.card_id AND c.is_current
 JOIN dim_date d ON d.date_value=p.payment_date JOIN dim_payment_method k ON k.payment_method=p.payment_method""",
    "fact_financial_health": f"""
SELECT metric_id AS health_key, m.member_key, d.date_key AS assessment_date_key, h.*, savings_balance+checking_balance AS total_liquid_assets,
 CASE WHEN savings_balance+checking_balance<>0 THEN {hu('least(CAST(total_debt AS DOUBLE)/CAST(savings_balance+checking_balance AS DOUBLE),9.9999)',4)} END AS debt_to_assets_ratio,
 savings_balance+checking_balance-total_debt AS net_worth,
 CASE WHEN coalesce(credit_score,0)=0 THEN 'Unknown' WHEN credit_score>=800 THEN 'Excellent' WHEN credit_score>=740 THEN 'Very Good'
  WHEN credit_score>=670 THEN 'Good' WHEN credit_score>=580 THEN 'Fair' ELSE 'Poor' END AS credit_score_tier,
 CASE WHEN credit_utilization_ratio IS NULL THEN 'Unknown' WHEN credit_utilization_ratio<0.10 THEN 'Low' WHEN credit_utilization_ratio<0.30 THEN 'Medium'
  WHEN credit_utilization_ratio<0.80 THEN 'High' ELSE 'Maxed' END AS utilization_tier
FROM financial_health_metrics h JOIN dim_member m ON h.member_id=m.member_id AND m.is_current JOIN dim_date d ON d.date_value=h.assessment_date""",
    "fact_product_recommendation": f"""
SELECT recommendation_id AS recommendation_key, m.member_key, p.product_key, d.date_key AS recommendation_date_key,
 CAST(strftime(expires_at,'%Y%m%d') AS INT) AS expires_date_key, r.*,
 CASE WHEN recommendation_score>80 THEN 'High' WHEN recommendation_score>=60 THEN 'Medium' WHEN recommendation_score IS NOT NULL THEN 'Low' ELSE 'Unknown' END AS recommendation_tier,
 datediff('day',{ASOF},expires_at) AS days_to_expiry, expires_at<{ASOF} AS is_expired, recommendation_score>80 AS is_high_confidence
FROM product_recommendations r JOIN dim_member m ON r.member_id=m.member_id AND m.is_current JOIN dim_financial_product p ON p.product_id=r.product_id
 JOIN dim_date d ON d.date_value=r.recommendation_date""",
    "balance_rows": f"""
SELECT card_id, last_day(payment_date) AS snapshot_date, statement_balance AS current_balance, minimum_due AS minimum_payment FROM (
 SELECT *, row_number() OVER (PARTITION BY card_id, last_day(payment_date) ORDER BY payment_date DESC, payment_id DESC) AS rn
 FROM payment_history WHERE last_day(payment_date) < DATE '2001-12-31') WHERE rn=1
UNION ALL SELECT card_id, DATE '2001-12-31', current_balance, NULL FROM credit_cards""",
    "fact_credit_card_balance": f"""
SELECT *, CASE WHEN utilization_ratio<0.10 THEN 'Low' WHEN utilization_ratio<0.30 THEN 'Medium' WHEN utilization_ratio<0.80 THEN 'High' ELSE 'Maxed' END AS utilization_tier,
 utilization_ratio>0.80 AS is_high_utilization, utilization_ratio>0.95 AS is_maxed_out FROM (
 SELECT b.card_id*1000000+d.date_key//100 AS balance_key, c.member_key, c.card_key, d.date_key AS snapshot_date_key, c.member_id, b.card_id, b.snapshot_date,
 c.credit_limit, b.current_balance, c.credit_limit-b.current_balance AS available_credit, b.minimum_payment,
 CASE WHEN c.credit_limit>0 THEN {hu('least(CAST(b.current_balance AS DOUBLE)/CAST(c.credit_limit AS DOUBLE),9.9999)',4)} ELSE 0.0 END AS utilization_ratio,
 CASE WHEN b.current_balance>lag(b.current_balance) OVER w THEN 'Increasing' WHEN b.current_balance<lag(b.current_balance) OVER w THEN 'Decreasing' ELSE 'Stable' END AS balance_trend,
 b.current_balance>c.credit_limit AS is_over_limit
 FROM balance_rows b JOIN dim_credit_card c ON c.card_id=b.card_id AND c.is_current JOIN dim_date d ON d.date_value=b.snapshot_date
 WINDOW w AS (PARTITION BY b.card_id ORDER BY b.snapshot_date))""",
    "health_last": """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY assessment_date DESC, metric_id DESC) AS rn
 FROM financial_health_metrics) WHERE rn=1""",
    "balance_last": """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY snapshot_date_key DESC) AS rn
 FROM fact_credit_card_balance) WHERE rn=1""",
    "pay12": """
SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY payment_date DESC, payment_id DESC) AS recency
FROM payment_history QUALIFY recency<=12""",
    "card_active": """
SELECT member_id, CAST(sum(credit_limit) AS DOUBLE) AS total_credit_limit, CAST(sum(current_balance) AS DOUBLE) AS total_balance,
 CASE WHEN sum(credit_limit)>0 THEN CAST(sum(current_balance) AS DOUBLE)/CAST(sum(credit_limit) AS DOUBLE) ELSE 0.0 END AS utilization_ratio,
 count(*) AS num_active_cards, CAST(sum(apr_rate) AS DOUBLE)/count(*) AS avg_apr, CAST(sum(credit_limit)-sum(current_balance) AS DOUBLE) AS total_available_credit
FROM credit_cards WHERE card_status='active' GROUP BY member_id""",
    "pay_behaviour": """
SELECT b.*, coalesce(f.payment_method,'online') AS payment_method_preference FROM (
 SELECT member_id, CAST(sum(CASE WHEN payment_status='on_time' THEN 1 ELSE 0 END) AS DOUBLE)/count(*) AS on_time_payment_rate,
  CAST(sum(days_late) AS DOUBLE)/count(*) AS avg_days_late, CAST(sum(late_fee) AS DOUBLE) AS total_late_fees FROM pay12 GROUP BY member_id) b
LEFT JOIN (SELECT member_id, payment_method FROM (SELECT member_id, payment_method, count(*) AS c FROM pay12 WHERE payment_method IS NOT NULL GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY c DESC, payment_method)=1) f USING (member_id)""",
    "rule_features": f"""
SELECT m.member_id, CAST(m.annual_income AS DOUBLE) AS annual_income, datediff('day',m.date_of_birth,{ASOF})//365 AS age,
 datediff('day',m.member_since,{ASOF}) AS member_tenure_days, m.employment_status, m.member_status,
 coalesce(c.total_credit_limit,0.0) AS total_credit_limit, coalesce(c.total_balance,0.0) AS total_balance, coalesce(c.utilization_ratio,0.0) AS utilization_ratio,
 coalesce(c.num_active_cards,0) AS num_active_cards, coalesce(c.avg_apr,0.2) AS avg_apr, coalesce(c.total_available_credit,0.0) AS total_available_credit,
 coalesce(p.on_time_payment_rate,1.0) AS on_time_payment_rate, coalesce(p.avg_days_late,0.0) AS avg_days_late, coalesce(p.total_late_fees,0.0) AS total_late_fees,
 coalesce(p.payment_method_preference,'online') AS payment_method_preference, h.credit_score, CAST(h.debt_to_income_ratio AS DOUBLE) AS debt_to_income_ratio,
 CAST(h.payment_reliability_score AS DOUBLE) AS payment_reliability_score, CAST(h.savings_balance AS DOUBLE) AS savings_balance,
 CAST(h.checking_balance AS DOUBLE) AS checking_balance, CAST(h.total_debt AS DOUBLE) AS total_debt, CAST(h.health_score AS DOUBLE) AS health_score, h.risk_category
FROM members m JOIN health_last h USING (member_id) LEFT JOIN card_active c USING (member_id) LEFT JOIN pay_behaviour p USING (member_id)
WHERE m.member_status='active' AND m.annual_income IS NOT NULL AND m.date_of_birth IS NOT NULL AND m.member_since IS NOT NULL""",
    "rule_pairs": """
SELECT *, CAST(minimum_income_required AS DOUBLE) AS mi, CAST(maximum_debt_to_income AS DOUBLE) AS md,
 NOT (coalesce(credit_score<minimum_credit_score,false) OR coalesce(annual_income<minimum_income_required,false)
  OR coalesce(debt_to_income_ratio>CAST(maximum_debt_to_income AS DOUBLE),false)) AS eligible
FROM rule_features CROSS JOIN (SELECT * FROM financial_products WHERE is_active IS NULL OR is_active)""",
    "rule_scored": """
SELECT *, CASE WHEN NOT eligible THEN 0.0 ELSE greatest(0.0,least(100.0, 70.0
 +CASE WHEN mi>0 AND annual_income/mi>2.0 THEN 15 WHEN mi>0 AND annual_income/mi>1.5 THEN 10 WHEN mi>0 AND annual_income/mi>1.2 THEN 5 ELSE 0 END
 +CASE WHEN credit_score-minimum_credit_score>100 THEN 15 WHEN credit_score-minimum_credit_score>50 THEN 10 WHEN credit_score-minimum_credit_score>20 THEN 5 ELSE 0 END
 +CASE WHEN utilization_ratio<0.1 THEN 10 WHEN utilization_ratio<0.3 THEN 5 WHEN utilization_ratio>0.8 THEN -15 ELSE 0 END
 +CASE WHEN on_time_payment_rate>0.95 THEN 10 WHEN on_time_payment_rate>0.85 THEN 5 WHEN on_time_payment_rate<0.7 THEN -20 ELSE 0 END
 +CASE risk_category WHEN 'low' THEN 10 WHEN 'high' THEN -15 ELSE 0 END
 +CASE WHEN health_score>85 THEN 10 WHEN health_score<60 THEN -10 ELSE 0 END
 +CASE WHEN product_type='credit_card' AND num_active_cards>=3 THEN -10 ELSE 0 END)) END AS score,
 CASE WHEN eligible THEN coalesce(nullif(array_to_string(list_slice(list_filter([
  CASE WHEN credit_score>=750 THEN 'excellent credit score' WHEN credit_score>=700 THEN 'good credit score' END,
  CASE WHEN mi>0 AND annual_income/mi>2.0 THEN 'high income' WHEN mi>0 AND annual_income/mi>1.5 THEN 'strong income' END,
  CASE WHEN utilization_ratio<0.2 THEN 'low credit utilization' END,
  CASE WHEN on_time_payment_rate>0.9 THEN 'excellent payment history' WHEN on_time_payment_rate>0.8 THEN 'good payment history' END,
  CASE WHEN risk_category='low' THEN 'low financial risk' END], lambda x: x IS NOT NULL),1,3),'; '),''),'meets all eligibility requirements')
 ELSE 'Not eligible: '||array_to_string(list_filter([
  CASE WHEN credit_score<minimum_credit_score THEN 'Credit score '||credit_score||' below required '||minimum_credit_score END,
  CASE WHEN annual_income<mi THEN 'Income $'||format('{:,}',CAST(floor(annual_income+0.5) AS BIGINT))||' below required $'||format('{:,}',CAST(floor(mi+0.5) AS BIGINT)) END,
  CASE WHEN debt_to_income_ratio>md THEN 'Debt-to-income '||printf('%.1f%%',floor(debt_to_income_ratio*100*10+0.5)/10)||' above maximum '||printf('%.1f%%',floor(md*100*10+0.5)/10) END],
  lambda x: x IS NOT NULL),'; ') END AS reasons
FROM rule_pairs""",
    "rule_top": """
SELECT *, least(score/100,1.0) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY score DESC, product_id) AS rank FROM rule_scored) WHERE rank<=5""",
    "pay_year": f"SELECT * FROM fact_payment WHERE payment_date >= {ASOF} - INTERVAL 12 MONTH",
    "pay_stats": f"""
SELECT member_id, n AS payment_frequency, {hu('CAST(s AS DOUBLE)/n/100',6)} AS avg_payment_amount, CAST(s AS DOUBLE)/100 AS total_payment_amount,
 CASE WHEN n>=2 AND s>0 THEN {hu('1.0-least(sqrt(CAST(n*ss-s*s AS DOUBLE)/(CAST(n AS DOUBLE)*(CAST(n AS DOUBLE)-1)))/(CAST(s AS DOUBLE)/n),2.0)/2',3)} ELSE 0.0 END AS payment_consistency,
 CASE WHEN n>=3 THEN {hu('CAST(n*sxc-sx*s AS DOUBLE)/CAST(n*sxx-sx*sx AS DOUBLE)/100',2)} ELSE 0.0 END AS payment_trend,
 CASE WHEN n>=2 THEN {hu('CAST(datediff(\'day\',d0,d1) AS DOUBLE)/(n-1)',1)} ELSE 0.0 END AS avg_days_between_payments
FROM (SELECT member_id, CAST(count(*) AS HUGEINT) AS n, sum(c) AS s, sum(c*c) AS ss, sum(x) AS sx, sum(x*c) AS sxc, sum(x*x) AS sxx, min(payment_date) AS d0, max(payment_date) AS d1
 FROM (SELECT member_id, payment_date, CAST(payment_amount*100 AS HUGEINT) AS c,
  CAST(row_number() OVER (PARTITION BY member_id ORDER BY payment_date, payment_key)-1 AS HUGEINT) AS x FROM pay_year) GROUP BY member_id)""",
    "card_roll": f"""
SELECT c.member_id, count(*) AS total_credit_cards, CAST(sum(c.credit_limit) AS DOUBLE) AS total_credit_limit,
 coalesce(CAST(sum(b.current_balance) AS DOUBLE),0.0) AS total_credit_balance, {hu('CAST(sum(c.credit_limit) AS DOUBLE)/count(*)',6)} AS avg_credit_limit,
 CAST(max(c.credit_limit) AS DOUBLE) AS max_credit_limit, {hu('CAST(sum(c.apr_rate) AS DOUBLE)/count(*)',6)} AS avg_interest_rate
FROM dim_credit_card c LEFT JOIN balance_last b USING (card_id) WHERE c.is_current AND c.card_status='active' GROUP BY c.member_id""",
    "dw_features": f"""
SELECT member_id AS customer_id, coalesce(credit_score,0) AS credit_score, inc AS annual_income,
 CASE risk_category WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS risk_category_encoded,
 coalesce(CAST(health_score AS DOUBLE),0) AS health_score, coalesce(CAST(credit_utilization_ratio AS DOUBLE),0) AS utilization_ratio,
 coalesce(CAST(debt_to_income_ratio AS DOUBLE),0) AS debt_to_income_ratio, coalesce(CAST(payment_reliability_score AS DOUBLE),0) AS payment_behavior_score,
 coalesce(CAST(credit_utilization_ratio AS DOUBLE),0) AS credit_utilization,
 CASE WHEN savings_balance IS NULL THEN 0.0 ELSE CAST(savings_balance AS DOUBLE)/nullif(inc,0.0) END AS savings_rate,
 coalesce(total_credit_cards,0) AS total_credit_cards, coalesce(total_credit_limit,0) AS total_credit_limit, coalesce(total_credit_balance,0) AS total_credit_balance,
 coalesce(avg_credit_limit,0) AS avg_credit_limit, coalesce(max_credit_limit,0) AS max_credit_limit, coalesce(avg_interest_rate,0) AS avg_interest_rate,
 coalesce(payment_frequency,0) AS payment_frequency, coalesce(avg_payment_amount,0) AS avg_payment_amount, coalesce(total_payment_amount,0) AS total_payment_amount,
 coalesce(payment_consistency,0) AS payment_consistency, coalesce(payment_trend,0) AS payment_trend,
 CASE WHEN lim<>0 THEN {hu('inc/lim',4)} ELSE 0.0 END AS income_to_credit_ratio,
 CASE WHEN lim<>0 THEN {hu('coalesce(total_credit_balance,0.0)/lim',4)} ELSE 0.0 END AS credit_utilization_total,
 CASE WHEN inc<>0 THEN {hu('coalesce(total_payment_amount,0.0)/inc',4)} ELSE 0.0 END AS payment_to_income_ratio,
 coalesce(datediff('day',member_since,{ASOF}),0) AS customer_tenure_days, coalesce(avg_days_between_payments,0) AS avg_days_between_payments,
 CASE member_status WHEN 'active' THEN 1 WHEN 'suspended' THEN -1 ELSE 0 END AS member_status_encoded,
 (inc<30000)::INT AS income_under_30k, (inc>=30000 AND inc<50000)::INT AS income_30k_50k, (inc>=50000 AND inc<75000)::INT AS income_50k_75k,
 (inc>=75000 AND inc<100000)::INT AS income_75k_100k, (inc>=100000 AND inc<150000)::INT AS income_100k_150k, (inc>=150000)::INT AS income_over_150k,
 (coalesce(credit_score,0)<580)::INT AS credit_poor, (credit_score>=580 AND credit_score<670)::INT AS credit_fair, (credit_score>=670 AND credit_score<740)::INT AS credit_good,
 (credit_score>=740 AND credit_score<800)::INT AS credit_very_good, (credit_score>=800)::INT AS credit_excellent
FROM (SELECT m.member_id, m.member_since, m.member_status, coalesce(CAST(m.annual_income AS DOUBLE),0.0) AS inc, h.* EXCLUDE (member_id), c.* EXCLUDE (member_id), p.* EXCLUDE (member_id),
 coalesce(c.total_credit_limit,1.0) AS lim
 FROM dim_member m LEFT JOIN (SELECT member_id, credit_score, risk_category, health_score, credit_utilization_ratio, debt_to_income_ratio, payment_reliability_score, savings_balance FROM health_last) h ON h.member_id=m.member_id
 LEFT JOIN card_roll c ON c.member_id=m.member_id LEFT JOIN pay_stats p ON p.member_id=m.member_id WHERE m.is_current AND m.member_status='active')""",
}

FEATURES = [
    "credit_score", "annual_income", "risk_category_encoded", "health_score", "utilization_ratio", "debt_to_income_ratio",
    "payment_behavior_score", "credit_utilization", "savings_rate", "total_credit_cards", "total_credit_limit",
    "total_credit_balance", "avg_credit_limit", "max_credit_limit", "avg_interest_rate", "payment_frequency",
    "avg_payment_amount", "total_payment_amount", "payment_consistency", "payment_trend", "income_to_credit_ratio",
    "credit_utilization_total", "payment_to_income_ratio", "customer_tenure_days", "avg_days_between_payments",
    "member_status_encoded", *[f[0] for f in E.INCOME_FLAGS], *[f[0] for f in E.CREDIT_FLAGS],
]

TABLES["clean_features"] = "SELECT customer_id, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE),0.0) AS {c}" for c in FEATURES) + " FROM dw_features"
TABLES["feature_quantiles"] = "SELECT " + ", ".join(
    f"quantile_cont({c},0.25) AS {c}_25, quantile_cont({c},0.5) AS {c}_50, quantile_cont({c},0.75) AS {c}_75" for c in FEATURES) + " FROM clean_features"
TABLES["scaled_features"] = "SELECT customer_id, " + ", ".join(
    f"({c}-{c}_50)/CASE WHEN {c}_75-{c}_25=0 THEN 1.0 ELSE {c}_75-{c}_25 END AS {c}" for c in FEATURES) + " FROM clean_features, feature_quantiles"
TABLES["feature_lists"] = f"SELECT customer_id, [{', '.join(FEATURES)}] AS f FROM scaled_features"
TABLES["unit_lists"] = """
SELECT customer_id, list_transform(f, lambda x: x/sqrt(list_dot_product(f,f))) AS u FROM feature_lists"""
TABLES["similar_ranked"] = f"""
SELECT customer_id, similar_customer_id, rank, {hu('greatest(0.0,1.0-distance)',3)} AS similarity_score FROM (
 SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY distance, similar_customer_id) AS rank FROM (
  SELECT a.customer_id, b.customer_id AS similar_customer_id, {hu('1.0-list_dot_product(a.u,b.u)',9)} AS distance FROM unit_lists a CROSS JOIN unit_lists b))
WHERE rank<=50"""
TABLES["similar_rows"] = "SELECT * FROM similar_ranked WHERE rank<=15"
TABLES["similarity_scores"] = f"""
SELECT customer_id, {hu('CASE WHEN w>0 THEN CAST(q AS DOUBLE)*80/(CAST(w AS DOUBLE)*1000) ELSE 50.0 END',6)} AS similarity_score FROM (
 SELECT customer_id, sum(t*t) AS q, sum(t) AS w FROM (SELECT customer_id, CAST(floor(similarity_score*1000+0.5) AS BIGINT) AS t FROM similar_rows WHERE rank<=10) GROUP BY 1)"""
TABLES["accepted_products"] = """
SELECT DISTINCT member_id AS customer_id, product_id FROM product_recommendations WHERE recommendation_status='accepted'"""
TABLES["ml_scored"] = f"""
SELECT *, {hu('eligibility_score*0.4+similarity_score*0.4+confidence*0.2',6)} AS score FROM (
 SELECT f.customer_id, f.credit_score, f.annual_income, f.health_score, f.utilization_ratio, f.debt_to_income_ratio, f.risk_category_encoded,
 coalesce(s.similarity_score,50.0) AS similarity_score, p.product_id, p.product_name, p.product_type,
 least(100.0*CASE WHEN coalesce(p.minimum_credit_score,0)<=0 THEN 1.0::DOUBLE WHEN f.credit_score<p.minimum_credit_score THEN 0.3::DOUBLE WHEN f.credit_score>=p.minimum_credit_score+50 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
  *CASE WHEN coalesce(p.minimum_income_required,0)<=0 THEN 1.0::DOUBLE WHEN f.annual_income<p.minimum_income_required THEN 0.4::DOUBLE WHEN f.annual_income>=CAST(p.minimum_income_required AS DOUBLE)*1.5 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
  *CASE WHEN coalesce(p.maximum_debt_to_income,0)>0 AND f.debt_to_income_ratio>CAST(p.maximum_debt_to_income AS DOUBLE) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 100.0::DOUBLE) AS eligibility_score,
 CAST(least(50+CASE WHEN f.health_score>70 THEN 20 WHEN f.health_score>50 THEN 10 ELSE 0 END+CASE WHEN f.utilization_ratio<0.3 THEN 15 WHEN f.utilization_ratio<0.7 THEN 5 ELSE 0 END
  +CASE f.risk_category_encoded WHEN 1 THEN 15 WHEN 2 THEN 5 ELSE 0 END,100) AS DOUBLE) AS confidence
 FROM dw_features f LEFT JOIN similarity_scores s USING (customer_id) CROSS JOIN (SELECT * FROM financial_products WHERE is_active) p
 WHERE NOT EXISTS (SELECT 1 FROM accepted_products o WHERE o.customer_id=f.customer_id AND o.product_id=p.product_id))"""
TABLES["ml_top"] = """
SELECT *, coalesce(nullif(array_to_string(list_slice(list_filter([
  CASE WHEN credit_score>=750 THEN 'Excellent credit score' WHEN credit_score>=700 THEN 'Good credit score' END,
  CASE WHEN health_score>75 THEN 'Strong financial health' END,
  CASE WHEN similarity_score>70 THEN 'Similar customers frequently choose this product' END,
  CASE WHEN annual_income>75000 THEN 'Income level aligns well' END], lambda x: x IS NOT NULL),1,2),'; '),''),'Profile matches product criteria') AS reason
 FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_type, product_name, product_id) AS rank FROM ml_scored) WHERE rank<=5"""
