"""SQL that derives the six bank tables from the order tables.

The same text is valid in Spark and in DuckDB, so the oracle starts from it. Two joins are spelled
differently for Spark (``SPARK_*``): doubling rows is an ``explode`` and the modular product match is
an equi-join, so that neither becomes a nested loop.
"""

MEMBERS = """
SELECT c_custkey+1 AS member_id, split_part(c_name,'#',1) AS first_name, split_part(c_name,'#',2) AS last_name,
 concat('member',CAST(c_custkey+1 AS STRING),'@example.com') AS email,
 concat('555-',lpad(CAST(c_custkey % 10000 AS STRING),4,'0')) AS phone,
 DATE '1935-01-01' + CAST((c_custkey*37) % 18000 AS INT) AS date_of_birth,
 concat(CAST(c_custkey+1 AS STRING),' Main Street') AS address,
 concat('City ',CAST(c_nationkey AS STRING)) AS city,
 nullif(split_part('NY,CA,IL,TX,AZ,PA,FL,OH,NC,IN,WA,CO,DC,MA,TN,OK,NV,PR,ny,',',',CAST(c_nationkey % 20 + 1 AS INT)),'') AS state,
 lpad(CAST((c_custkey*37) % 100000 AS STRING),5,'0') AS zip_code,
 CAST(round(20000+(c_acctbal+1000)*18,2) AS DECIMAL(12,2)) AS annual_income,
 CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'retired' WHEN 'MACHINERY' THEN 'self_employed' WHEN 'FURNITURE' THEN 'unemployed' ELSE 'employed' END AS employment_status,
 {member_since} AS member_since,
 CASE WHEN c_custkey % 20 = 0 THEN 'inactive' WHEN c_custkey % 97 = 0 THEN 'suspended' ELSE 'active' END AS member_status
 FROM {customer} {since_join}
"""

SINCE_COLUMN = "o.member_since"
SINCE_JOIN = ("LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS member_since"
              " FROM {orders} GROUP BY o_custkey) o ON c_custkey=o.o_custkey")

CREDIT_CARDS = """
SELECT o_orderkey+1 AS card_id, o_custkey+1 AS member_id, concat('4',lpad(CAST(o_orderkey AS STRING),15,'0')) AS card_number,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'amex' WHEN '2-HIGH' THEN 'discover' WHEN '3-MEDIUM' THEN 'mastercard' ELSE 'visa' END AS card_type,
 CAST(round(o_totalprice/2500)*500 AS DECIMAL(10,2)) AS credit_limit,
 CAST(round(round(o_totalprice/2500)*500*(CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 30 WHEN 3 THEN 50 WHEN 4 THEN 80 ELSE 95 END)/100,2) AS DECIMAL(10,2)) AS current_balance,
 CAST((5+o_orderkey % 21)/100 AS DECIMAL(5,4)) AS apr_rate,
 CASE o_orderstatus WHEN 'P' THEN 'expired' ELSE 'active' END AS card_status,
 CAST(o_orderdate AS DATE) AS issue_date,
 concat(CAST(year(o_orderdate)+3 AS STRING), substr(CAST(CAST(o_orderdate AS DATE) AS STRING),5)) AS expiry_date
 FROM {orders}
"""

PAYMENT_HISTORY = """
SELECT payment_id, member_id, card_id, payment_date,
 CAST(CASE WHEN d=10 THEN 0 WHEN ln % 4 = 0 THEN mdc WHEN ln % 4 = 1 THEN (sbc-sbc%2)/2 WHEN ln % 4 = 2 THEN sbc ELSE sbc+(sbc-sbc%10)/10 END / 100 AS DECIMAL(10,2)) AS payment_amount,
 CAST(mdc/100 AS DECIMAL(10,2)) AS minimum_due,
 CASE WHEN d<=7 THEN 'on_time' WHEN d=8 THEN 'late' WHEN d=9 THEN 'partial' ELSE 'missed' END AS payment_status,
 CASE WHEN d<=7 THEN 0 WHEN d=9 THEN qty % 11 ELSE qty % 30 + 1 END AS days_late,
 CAST(CASE WHEN d<=7 THEN 0 WHEN d=10 THEN 35 WHEN qty > 25 THEN 25 ELSE 0 END AS DECIMAL(6,2)) AS late_fee,
 CAST(sbc/100 AS DECIMAL(10,2)) AS statement_balance,
 CASE sk % 7 WHEN 0 THEN 'auto_pay' WHEN 1 THEN 'online' WHEN 2 THEN 'phone' WHEN 3 THEN 'mail' WHEN 4 THEN 'branch' WHEN 5 THEN NULL ELSE 'online' END AS payment_method
 FROM (SELECT *, greatest(2500,(sbc-sbc%50)/50 - ((sbc-sbc%50)/50) % 1) AS mdc FROM (
   SELECT l_orderkey*1000000+row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS payment_id, o_custkey+1 AS member_id, l_orderkey+1 AS card_id,
   CAST(l_shipdate AS DATE) AS payment_date, CAST(round(l_discount*100) AS INT) AS d, l_linenumber AS ln, CAST(l_quantity AS INT) AS qty, l_suppkey AS sk,
   (CAST(round(l_extendedprice*100) AS BIGINT) - CAST(round(l_extendedprice*100) AS BIGINT) % 10)/10 AS sbc
   FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey) x) y
"""

# One product for each kind and brand of part, so the catalogue is bounded by these two domains and not by the
# number of parts; every part counts in the sums that the attributes are taken from.
FINANCIAL_PRODUCTS = """
SELECT k+1 AS product_id, concat(lower(kind),' ',brand,' ',CAST(k+1 AS STRING)) AS product_name,
 CASE kind WHEN 'ECONOMY' THEN 'credit_card' WHEN 'SMALL' THEN 'personal_loan' WHEN 'MEDIUM' THEN 'mortgage' WHEN 'PROMO' THEN 'savings_account' WHEN 'STANDARD' THEN 'cd' ELSE 'investment' END AS product_type,
 CASE k % 4 WHEN 0 THEN 'premium' WHEN 1 THEN 'standard' WHEN 2 THEN 'basic' ELSE 'secured' END AS product_category,
 CAST((sizes % 26)/100 AS DECIMAL(5,4)) AS interest_rate,
 CAST(500+(parts % 5)*500 AS DECIMAL(10,2)) AS credit_limit_min,
 CAST(5000+(sizes % 10)*2500 AS DECIMAL(10,2)) AS credit_limit_max,
 CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(15000+(sizes % 51)*1700 AS DECIMAL(10,2)) END AS minimum_income_required,
 CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(500+(sizes*7) % 281 AS INT) END AS minimum_credit_score,
 CAST((25+(parts % 8)*5)/100 AS DECIMAL(5,4)) AS maximum_debt_to_income,
 CAST(CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 50 WHEN 3 THEN 95 ELSE 150 END AS DECIMAL(6,2)) AS annual_fee,
 CASE k % 4 WHEN 0 THEN 'Points' WHEN 1 THEN 'Cashback' WHEN 2 THEN ' ' ELSE NULL END AS rewards_program,
 concat('Benefits of ',CAST(parts AS STRING),' parts') AS benefits, concat('Brand ',brand) AS eligibility_criteria,
 CASE k % 25 WHEN 7 THEN false WHEN 11 THEN NULL ELSE true END AS is_active
 FROM (SELECT CAST(replace(p_brand,'Brand#','') AS BIGINT)*6 + CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'STANDARD' THEN 4 ELSE 5 END AS k,
  max(p_type) AS kind, max(p_brand) AS brand, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS sizes FROM {part}
  GROUP BY CAST(replace(p_brand,'Brand#','') AS BIGINT)*6 + CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'STANDARD' THEN 4 ELSE 5 END) g
"""

HEALTH = """
SELECT member_id*10+k AS metric_id, member_id, CASE k WHEN 0 THEN DATE '2001-06-15' ELSE DATE '2001-12-15' END AS assessment_date,
 CAST(cs AS INT) AS credit_score, CAST(floor(dti*10000+0.5)/10000 AS DECIMAL(5,4)) AS debt_to_income_ratio, CAST(floor(util*10000+0.5)/10000 AS DECIMAL(5,4)) AS credit_utilization_ratio,
 CAST(floor(rel*100+0.5)/100 AS DECIMAL(5,2)) AS payment_reliability_score,
 CAST(floor(income*(member_id % 50)+0.5)/100 AS DECIMAL(12,2)) AS savings_balance, CAST(500+floor(income*(member_id % 10)+0.5)/100 AS DECIMAL(12,2)) AS checking_balance,
 CAST(floor(debt*100+0.5)/100 AS DECIMAL(12,2)) AS total_debt, CAST(n_cards + 1 + member_id % 3 AS INT) AS number_of_accounts, CAST(member_id % 6 AS INT) AS recent_inquiries,
 CAST(CASE WHEN member_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS delinquent_accounts, CAST(floor(hs*100+0.5)/100 AS DECIMAL(5,2)) AS health_score,
 CASE WHEN hs>=80 THEN 'low' WHEN hs>=60 THEN 'medium' ELSE 'high' END AS risk_category
FROM (SELECT *, greatest(0,least(100, cs/850*40+(1-util)*25+rel/100*20+(1-dti)*15)) AS hs FROM (
 SELECT *, greatest(300,least(850, 650 + CASE WHEN income>100000 THEN 100 WHEN income>60000 THEN 50 WHEN income<30000 THEN -50 ELSE 0 END
  + CASE WHEN util<0.1 THEN 50 WHEN util<0.3 THEN 20 WHEN util>0.8 THEN -100 WHEN util>0.5 THEN -50 ELSE 0 END
  + CASE WHEN rel>95 THEN 50 WHEN rel>85 THEN 25 WHEN rel<70 THEN -75 WHEN rel<80 THEN -40 ELSE 0 END + (member_id*13+k*7) % 41 - 20)) AS cs,
  least(1.0, debt/income) AS dti FROM (
 SELECT m.member_id, k, CAST(m.annual_income AS DOUBLE) AS income, coalesce(n_cards,0) AS n_cards,
  CASE WHEN lim>0 THEN least(1.0, CAST(bal AS DOUBLE)/CAST(lim AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS util,
  CASE WHEN n_pay>0 THEN CAST(n_on AS DOUBLE)/n_pay*100 ELSE CAST(85 AS DOUBLE) END AS rel,
  CAST(coalesce(bal,0) AS DOUBLE) + CAST(m.annual_income AS DOUBLE)*(m.member_id % 10)/50 AS debt
 FROM {members}
 LEFT JOIN (SELECT member_id, count(*) AS n_cards, sum(credit_limit) AS lim, sum(current_balance) AS bal FROM {credit_cards} GROUP BY member_id) c ON m.member_id=c.member_id
 LEFT JOIN (SELECT member_id, count(*) AS n_pay, sum(CASE WHEN payment_status='on_time' THEN 1 ELSE 0 END) AS n_on FROM {payment_history} GROUP BY member_id) p ON m.member_id=p.member_id) a) b) c2
"""
HEALTH_MEMBERS = "members m CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) kk"
SPARK_HEALTH_MEMBERS = "(SELECT member_id, annual_income, explode(array(0,1)) AS k FROM {members}) m"

RECOMMENDATIONS = """
SELECT m.member_id*1000+p.product_id AS recommendation_id, m.member_id, p.product_id,
 DATE '2002-01-01' - CAST((m.member_id+p.product_id) % 400 AS INT) AS recommendation_date, CAST(60+(m.member_id*7+p.product_id*3) % 41 AS DECIMAL(5,2)) AS recommendation_score,
 CAST(40+(m.member_id*11) % 60 AS DECIMAL(5,2)) AS member_health_score,
 CAST(((m.member_id*17) % 100)/100 AS DECIMAL(5,4)) AS credit_utilization_at_time,
 CAST(50+(m.member_id*7) % 50 AS DECIMAL(5,2)) AS payment_reliability_at_time,
 CASE WHEN (m.member_id+p.product_id) % 20 < 8 THEN 'pending' WHEN (m.member_id+p.product_id) % 20 < 13 THEN 'accepted' WHEN (m.member_id+p.product_id) % 20 < 18 THEN 'declined' ELSE 'expired' END AS recommendation_status,
 DATE '2002-01-01' + CAST((m.member_id*3+p.product_id) % 120 - 30 AS INT) AS expires_at
 FROM {members} m JOIN {financial_products} p ON {match}
"""
RECOMMENDATION_MATCH = "(m.member_id*31+p.product_id*17) % 25 = 0"
SPARK_RECOMMENDATION_MATCH = "(m.member_id*31) % 25 = (25 - (p.product_id*17) % 25) % 25"
