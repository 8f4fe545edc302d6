"""Rule and similarity recommendations, their documents, and the model behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encodings as E
from ..functions.numbers import half_up, num
from ..operators import keyed as K
from ..plans import documents as D
from ..plans import features as FE
from ..plans import rules as R
from ..plans import similarity as S
from ..session import kept
from ..streaming import incremental as I
from .base import ASOF, Context, query
from .oracle_tables import FEATURES, hu

RULE_FEATURES = ("member_id b, annual_income d, age b, member_tenure_days b, employment_status s, member_status s, total_credit_limit d, total_balance d, "
                 "utilization_ratio d, num_active_cards b, avg_apr d, total_available_credit d, on_time_payment_rate d, avg_days_late d, total_late_fees d, "
                 "payment_method_preference s, credit_score b, debt_to_income_ratio d, payment_reliability_score d, savings_balance d, checking_balance d, "
                 "total_debt d, health_score d, risk_category s")
ROUNDED = ["utilization_ratio", "avg_apr", "on_time_payment_rate", "avg_days_late"]


def rule_features(c: Context) -> DataFrame:
    return FE.member_features(c.src.members, c.src.credit_cards, c.src.payment_history, c.src.financial_health_metrics, c.asof)


def rule_products(c: Context) -> DataFrame:
    from ..plans.filters import active_products

    return active_products(c.src.financial_products, keep_unknown=True)


def rule_top(c: Context) -> DataFrame:
    return R.recommend(rule_features(c), rule_products(c))


def rule_docs(c: Context) -> DataFrame:
    return D.rule_documents(rule_top(c), c.asof.cast("timestamp"))


def dw_features(c: Context) -> DataFrame:
    payments = FE.payment_stats(FE.recent_payments(c.wh.fact_payment, c.asof), id_column="payment_key")
    cards = FE.card_rollup(c.wh.dim_credit_card, c.wh.fact_credit_card_balance)
    return FE.dw_features(c.wh.dim_member, FE.latest_health(c.src.financial_health_metrics), cards, payments, c.asof)


def accepted(c: Context) -> DataFrame:
    return c.src.product_recommendations.filter("recommendation_status = 'accepted'").select(
        F.col("member_id").alias("customer_id"), "product_id").distinct()


def fitted(c: Context) -> tuple[DataFrame, DataFrame]:
    """Features, kept for training and scoring, and their scaled form."""
    features = kept(dw_features(c), "features")
    return features, S.scaled_features(features)


def ml_top(c: Context) -> DataFrame:
    features, scaled = fitted(c)
    similarity = S.similarity_score(S.customer_neighbours(scaled))
    return S.recommend(features, similarity, c.src.financial_products, accepted(c))


def ml_docs(c: Context) -> DataFrame:
    return D.similarity_documents(ml_top(c), c.src.member_ids, c.asof.cast("timestamp"))


@query("member_features", RULE_FEATURES, "SELECT * REPLACE (" + ", ".join(f"{hu(n, 6)} AS {n}" for n in ROUNDED) + ") FROM rule_features")
def _(c: Context):
    return rule_features(c).withColumns({n: half_up(F.col(n), 6) for n in ROUNDED})


@query("rule_score", "member_id b, product_id b, eligible o, score d", "SELECT * FROM rule_scored")
def _(c: Context):
    return R.score_products(rule_features(c), rule_products(c))


@query("rule_reasons", "member_id b, product_id b, reasons s", "SELECT * FROM rule_scored")
def _(c: Context):
    return R.score_products(rule_features(c), rule_products(c))


@query("rule_recommend", "member_id b, rank b, product_id b, product_name s, product_type s, score d, probability d, eligible o, reasons s",
       f"SELECT * REPLACE ({hu('probability', 3)} AS probability) FROM rule_top")
def _(c: Context):
    return rule_top(c)


@query("rank_recommendations", "member_id b, product_id b, rank b",
       "SELECT member_id, product_id, row_number() OVER (PARTITION BY member_id ORDER BY score DESC, product_id) AS rank FROM rule_scored")
def _(c: Context):
    products = rule_products(c)
    scored = R.score_products(rule_features(c), products)
    return R.best_per_customer(scored, "member_id", [F.desc("score"), F.col("product_id")], products.count())


_RULE_ITEMS = "customer_id s, algorithm_type s, name s, rank b, product_name s, product_type s, score d, max_score d, confidence d, reason s"
_RULE_ITEMS_SQL = (f"SELECT member_id AS customer_id, 'rule_based' AS algorithm_type, 'Member '||member_id AS name, rank, product_name, product_type, score, "
                   f"100.0 AS max_score, {hu(hu('probability', 3) + '*100', 1)} AS confidence, reasons AS reason FROM rule_top")


@query("rule_documents", "customer_id s, name s, annual_income d, credit_score b, health_score d, risk_category s, items b, best s, data_source s",
       "SELECT member_id AS customer_id, 'Member '||member_id AS name, any_value(annual_income) AS annual_income, any_value(credit_score) AS credit_score, "
       "any_value(health_score) AS health_score, any_value(risk_category) AS risk_category, count(*) AS items, "
       "string_agg(product_name, '|' ORDER BY rank) AS best, 'oltp' AS data_source FROM rule_top GROUP BY member_id")
def _(c: Context):
    docs = rule_docs(c)
    return docs.select("customer_id", "customer_profile.*", F.size("recommendations").alias("items"),
                       F.array_join(F.transform("recommendations", lambda r: r["product_name"]), "|").alias("best"), "data_source")


@query("explode_documents", _RULE_ITEMS, _RULE_ITEMS_SQL)
def _(c: Context):
    return D.exploded(rule_docs(c))


# A caller asks for one id per part, so some of the ids are no members.
_ASKED_SQL = "(SELECT p_partkey+1 AS member_id FROM part)"
_FAILED_SQL = f"""SELECT member_id, 'insufficient_data' AS error_type, 'Could not calculate member features' AS message FROM {_ASKED_SQL} a
WHERE member_id NOT IN (SELECT member_id FROM rule_features)
UNION ALL SELECT member_id, 'no_recommendations', 'No suitable products found' FROM rule_features
WHERE member_id IN (SELECT member_id FROM {_ASKED_SQL} a) AND member_id NOT IN (SELECT member_id FROM rule_top)"""


def _asked(c: Context) -> DataFrame:
    return c.raw("part").select((F.col("p_partkey") + 1).alias("member_id"))


@query("member_failures", "member_id b, error_type s, message s", _FAILED_SQL)
def _(c: Context):
    features = rule_features(c)
    return R.failures(_asked(c), features, R.recommend(features, rule_products(c)))


@query("failure_analysis", "error_type s, failures b, success_rate_percent d", f"""
SELECT error_type, count(*) AS failures, {hu("(CAST((SELECT count(*) FROM part) AS DOUBLE)-(SELECT count(*) FROM (" + _FAILED_SQL + ") x))/(SELECT count(*) FROM part)*100", 1)} AS success_rate_percent
FROM ({_FAILED_SQL}) f GROUP BY 1""")
def _(c: Context):
    features = rule_features(c)
    failed = R.failures(_asked(c), features, R.recommend(features, rule_products(c)))
    return R.failure_summary(failed, _asked(c))


_LEAD = "h.credit_score-p.minimum_credit_score"


@query("catalogue_score", "member_id b, product_id b, score d", f"""
SELECT m.member_id, p.product_id, greatest(0,least(100,70
 +CASE WHEN CAST(m.annual_income AS DOUBLE)>CAST(p.minimum_income_required AS DOUBLE)*1.5::DOUBLE THEN 15 WHEN CAST(m.annual_income AS DOUBLE)>CAST(p.minimum_income_required AS DOUBLE)*1.2::DOUBLE THEN 10 ELSE 0 END
 +CASE WHEN {_LEAD}>50 THEN 15 WHEN {_LEAD}>20 THEN 10 ELSE 0 END+CASE WHEN h.health_score>80 THEN 10 WHEN h.health_score<50 THEN -20 ELSE 0 END)) AS score
FROM members m JOIN health_last h USING (member_id) CROSS JOIN financial_products p""")
def _(c: Context):
    pairs = R.catalogue_pairs(c.src.member_ids, FE.latest_health(c.src.financial_health_metrics), c.src.financial_products)
    return pairs.withColumn("score", R.catalogue_score())


@query("catalogue_reason", "member_id b, reason s", """
SELECT member_id, coalesce('Recommended based on '||nullif(array_to_string(list_slice(list_filter([
 CASE WHEN credit_score>=750 THEN 'excellent credit score' WHEN credit_score>=680 THEN 'good credit score' END,
 CASE WHEN annual_income>=80000 THEN 'high income' WHEN annual_income>=50000 THEN 'stable income' END,
 CASE WHEN credit_utilization_ratio<0.3 THEN 'low credit utilization' END,
 CASE WHEN payment_reliability_score>90 THEN 'excellent payment history' END], lambda x: x IS NOT NULL),1,2),', '),''),'Standard recommendation') AS reason
FROM members JOIN health_last USING (member_id)""")
def _(c: Context):
    health = FE.latest_health(c.src.financial_health_metrics)
    return c.src.member_ids.join(health, "member_id").select("member_id", R.catalogue_reason().alias("reason"))


@query("health_defaults", "member_id b, credit_score b, debt_to_income_ratio d, payment_reliability_score d, savings_balance d, checking_balance d, total_debt d, health_score d, risk_category s",
       f"""SELECT m.member_id, coalesce(h.credit_score,650) AS credit_score, coalesce(CAST(h.debt_to_income_ratio AS DOUBLE),0.3) AS debt_to_income_ratio,
 {hu('coalesce(CAST(h.payment_reliability_score AS DOUBLE),coalesce(p.on_time_payment_rate,1.0)*100)', 6)} AS payment_reliability_score,
 {hu('coalesce(CAST(h.savings_balance AS DOUBLE),CAST(m.annual_income AS DOUBLE)*0.1)', 6)} AS savings_balance, {hu('coalesce(CAST(h.checking_balance AS DOUBLE),CAST(m.annual_income AS DOUBLE)*0.05)', 6)} AS checking_balance,
 coalesce(CAST(h.total_debt AS DOUBLE),coalesce(c.total_balance,0.0)) AS total_debt, coalesce(CAST(h.health_score AS DOUBLE),75.0) AS health_score, coalesce(h.risk_category,'medium') AS risk_category
FROM members m LEFT JOIN (SELECT * FROM health_last WHERE delinquent_accounts=0) h USING (member_id) LEFT JOIN card_active c USING (member_id) LEFT JOIN pay_behaviour p USING (member_id)""")
def _(c: Context):
    base = c.src.member_ids.select("member_id", num("annual_income").alias("annual_income")).join(
        FE.active_card_metrics(c.src.credit_cards).select("member_id", "total_balance"), "member_id", "left").join(
        FE.payment_behaviour(c.src.payment_history).select("member_id", "on_time_payment_rate"), "member_id", "left").fillna(
        {"total_balance": 0.0, "on_time_payment_rate": FE.DEFAULT_ON_TIME})
    clean = FE.latest_health(c.src.financial_health_metrics).filter("delinquent_accounts = 0")
    out = FE.with_health_or_defaults(base, clean)
    return out.withColumns({n: half_up(F.col(n), 6) for n in ("payment_reliability_score", "savings_balance", "checking_balance")})


# Similarity model

_FEATURE_SPEC = "customer_id b, " + ", ".join(f"{n} d" for n in FEATURES)


@query("dw_features", _FEATURE_SPEC, f"SELECT * REPLACE ({hu('savings_rate', 6)} AS savings_rate) FROM dw_features")
def _(c: Context):
    return dw_features(c).withColumn("savings_rate", half_up(F.col("savings_rate"), 6))


@query("null_inf_clean", _FEATURE_SPEC, f"SELECT * REPLACE ({hu('savings_rate', 6)} AS savings_rate) FROM clean_features")
def _(c: Context):
    return S.clean_features(dw_features(c)).withColumn("savings_rate", half_up(F.col("savings_rate"), 6))


@query("robust_scale", _FEATURE_SPEC, "SELECT customer_id, " + ", ".join(f"{hu(n, 6)} AS {n}" for n in FEATURES) + " FROM scaled_features")
def _(c: Context):
    _, scaled = fitted(c)
    return scaled.withColumns({n: half_up(F.col(n), 6) for n in FEATURES})


@query("cosine_knn", "customer_id b, similar_customer_id b, similarity_score d, rank b", "SELECT * FROM similar_ranked")
def _(c: Context):
    return S.customer_neighbours(fitted(c)[1], S.NEIGHBOURS_KEPT)


@query("top_k_neighbours", "customer_id b, similar_customer_id b, similarity_score d, rank b", "SELECT * FROM similar_rows")
def _(c: Context):
    return S.customer_neighbours(fitted(c)[1])


@query("neighbour_rank", "customer_id b, similar_customer_id b, rank b", "SELECT * FROM similar_rows WHERE rank<=10")
def _(c: Context):
    return S.customer_neighbours(fitted(c)[1], S.NEIGHBOURS_WEIGHTED)


@query("approx_knn", "customer_id b, similar_customer_id b, similarity_score d, rank b")
def _(c: Context):
    return S.customer_neighbours(fitted(c)[1], probes=8)


@query("kmeans_segments", "customer_id b, segment b")
def _(c: Context):
    return S.customer_segments(fitted(c)[1])


@query("pca_components", "component b, explained_variance d")
def _(c: Context):
    return S.component_variance(fitted(c)[1])


@query("approx_knn_recall", "customers b, recall_reached o, differing b", "SELECT count(*) AS customers, true AS recall_reached, 0 AS differing FROM scaled_features")
def _(c: Context):
    return S.approximate_recall(fitted(c)[1], 8).withColumn("recall_reached", F.col("recall") >= 0.9)


@query("kmeans_nearest_centre", "customers b, segments b, misplaced b", "SELECT count(*) AS customers, 10 AS segments, 0 AS misplaced FROM scaled_features")
def _(c: Context):
    return S.segment_check(fitted(c)[1])


@query("pca_total_variance", "components b, total_variance d", f"SELECT {len(FEATURES)} AS components, {hu(' + '.join(f'var_pop({n})' for n in FEATURES), 4)} AS total_variance FROM scaled_features")
def _(c: Context):
    return S.total_variance(fitted(c)[1]).withColumn("total_variance", half_up(F.col("total_variance"), 4))


@query("model_stats", "total_customers b, feature_dimensions b, n_neighbors b, n_clusters b, available_products b", """
SELECT count(*) AS total_customers, 37 AS feature_dimensions, least(50, count(*)) AS n_neighbors, least(10, count(*)) AS n_clusters,
 (SELECT count(*) FROM financial_products WHERE is_active) AS available_products FROM scaled_features""")
def _(c: Context):
    return S.model_stats(fitted(c)[1], c.src.financial_products)


@query("ml_eligibility_score", "customer_id b, product_id b, eligibility_score d", f"SELECT customer_id, product_id, {hu('eligibility_score', 6)} AS eligibility_score FROM ml_scored")
def _(c: Context):
    neutral = c.src.member_ids.select(F.col("member_id").alias("customer_id"), F.lit(50.0).alias("similarity_score"))
    scored = S.scored_products(dw_features(c), neutral, c.src.financial_products, accepted(c))
    return scored.withColumn("eligibility_score", half_up(F.col("eligibility_score"), 6))


@query("ml_similarity_score", "customer_id b, similarity_score d", "SELECT * FROM similarity_scores")
def _(c: Context):
    return S.similarity_score(S.customer_neighbours(fitted(c)[1]))


@query("ml_owned_similarity", "customer_id b, product_id b, owned_similarity_score d", f"""
WITH close AS (SELECT customer_id, similar_customer_id, CAST(floor(similarity_score*1000+0.5) AS BIGINT) AS w FROM similar_rows WHERE rank<=10),
 weights AS (SELECT customer_id, sum(w) AS weight FROM close GROUP BY 1)
SELECT customer_id, product_id, {hu('coalesce(CAST(held AS DOUBLE)*100/nullif(CAST(weight AS DOUBLE),0.0),50.0)', 6)} AS owned_similarity_score
FROM (SELECT k.customer_id, o.product_id, sum(w) AS held FROM close k JOIN accepted_products o ON o.customer_id=k.similar_customer_id GROUP BY ALL) JOIN weights USING (customer_id)""")
def _(c: Context):
    return S.owned_similarity(S.customer_neighbours(fitted(c)[1]), accepted(c))


@query("ml_confidence", "customer_id b, confidence d", "SELECT DISTINCT customer_id, confidence FROM ml_scored")
def _(c: Context):
    return dw_features(c).select("customer_id", S.confidence_score().alias("confidence"))


_ML_TOP = "customer_id b, rank b, product_id b, product_name s, product_type s, score d, max_score d, confidence d, reason s"
_ML_TOP_SQL = f"SELECT * REPLACE ({hu('score', 1)} AS score, {hu('confidence', 1)} AS confidence), 100.0 AS max_score FROM ml_top"


@query("ml_recommend", _ML_TOP, _ML_TOP_SQL)
def _(c: Context):
    return ml_top(c)


@query("ml_reasons", "customer_id b, product_id b, reason s", "SELECT * FROM ml_top")
def _(c: Context):
    return ml_top(c)


@query("ml_documents", "customer_id s, name s, annual_income d, credit_score b, risk_category s, items b, best s, algorithm_type s, data_source s", """
SELECT t.customer_id, any_value(m.first_name||' '||m.last_name) AS name, any_value(t.annual_income) AS annual_income, any_value(t.credit_score) AS credit_score,
 any_value(CASE t.risk_category_encoded WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'unknown' END) AS risk_category, count(*) AS items,
 string_agg(t.product_name, '|' ORDER BY t.rank) AS best, 'ml_similarity' AS algorithm_type, 'dw' AS data_source
FROM ml_top t JOIN members m ON m.member_id=t.customer_id GROUP BY t.customer_id""")
def _(c: Context):
    return ml_docs(c).select("customer_id", "customer_profile.*", F.size("recommendations").alias("items"),
                             F.array_join(F.transform("recommendations", lambda r: r["product_name"]), "|").alias("best"),
                             "algorithm_type", "data_source")


@query("offer_documents", "customer_id s, offer_id s, status s, message s, attached s", """
SELECT member_id AS customer_id, upper(left(sha256(CAST(member_id AS VARCHAR)),8)) AS offer_id, 'created' AS status,
 'Offer created successfully for customer id : '||member_id AS message, string_agg(product_name, '|' ORDER BY rank) AS attached FROM rule_top WHERE rank<=2 GROUP BY member_id""")
def _(c: Context):
    made = D.offers(rule_docs(c), c.src.member_ids, c.asof.cast("timestamp"))
    return made.withColumn("attached", F.array_join(F.transform("attached", lambda r: r["product_name"]), "|"))


# Document collections: one stored document per member and status side.

def _collection(c: Context, status: str, algorithm: str) -> DataFrame:
    rows = c.src.product_recommendations.filter(F.col("recommendation_status") == status).groupBy(
        F.col("member_id").cast("string").alias("customer_id")).agg(F.max("recommendation_date").cast("timestamp").alias("created_at"))
    return D.tagged(rows, algorithm)


def _collection_sql(status: str, algorithm: str) -> str:
    return (f"SELECT CAST(member_id AS VARCHAR) AS customer_id, CAST(max(recommendation_date) AS TIMESTAMP) AS created_at, '{algorithm}' AS algorithm_type "
            f"FROM product_recommendations WHERE recommendation_status='{status}' GROUP BY 1")


_BOTH_SQL = f"({_collection_sql('accepted', 'rule_based')} UNION ALL {_collection_sql('pending', 'ml_similarity')})"


def _both(c: Context) -> DataFrame:
    return _collection(c, "accepted", "rule_based").unionByName(_collection(c, "pending", "ml_similarity"))


@query("collection_stats", "rule_based_count b, ml_based_count b, rule_latest_created s, ml_latest_created s, total_unique_customers b", f"""
SELECT count(*) FILTER (algorithm_type='rule_based') AS rule_based_count, count(*) FILTER (algorithm_type='ml_similarity') AS ml_based_count,
 max(created_at) FILTER (algorithm_type='rule_based') AS rule_latest_created, max(created_at) FILTER (algorithm_type='ml_similarity') AS ml_latest_created,
 count(DISTINCT customer_id) AS total_unique_customers FROM {_BOTH_SQL}""")
def _(c: Context):
    return D.collection_stats(_collection(c, "accepted", "rule_based"), _collection(c, "pending", "ml_similarity"))


@query("processing_stats", "total_ml_recommendations b, total_recommendations b, latest_update s",
       f"SELECT count(*) FILTER (algorithm_type='ml_similarity') AS total_ml_recommendations, count(*) AS total_recommendations, max(created_at) AS latest_update FROM {_BOTH_SQL}")
def _(c: Context):
    return D.processing_stats(_both(c))


@query("ttl_cleanup", "customer_id s, created_at s, algorithm_type s", f"SELECT * FROM {_BOTH_SQL} WHERE created_at >= TIMESTAMP '{ASOF}' - INTERVAL 30 DAY")
def _(c: Context):
    return D.cleanup(_both(c), c.asof)[0]


@query("ttl_cleanup_ml_counts", "algorithm_type s, deleted_count b",
       f"SELECT algorithm_type, count(*) FILTER (algorithm_type='ml_similarity' AND created_at < TIMESTAMP '{ASOF}' - INTERVAL 30 DAY) AS deleted_count FROM {_BOTH_SQL} GROUP BY 1")
def _(c: Context):
    return D.cleanup(_both(c), c.asof, algorithm="ml_similarity")[1]


@query("incremental_recommend", "customer_id s, algorithm_type s, items b", f"""
WITH stored AS ({_collection_sql('accepted', 'rule_based')}),
 fresh AS (SELECT CAST(member_id AS VARCHAR) AS customer_id, count(*) AS items FROM rule_top WHERE CAST(member_id AS VARCHAR) NOT IN (SELECT customer_id FROM stored) GROUP BY 1)
SELECT customer_id, 'rule_based' AS algorithm_type, items FROM fresh UNION ALL SELECT customer_id, algorithm_type, 0 FROM stored""")
def _(c: Context):
    stored = _collection(c, "accepted", "rule_based")
    wanted = D.missing_customers(c.src.member_ids, stored).select(F.col("customer_id").cast("bigint").alias("member_id"))
    features = rule_features(c).join(wanted, "member_id", "left_semi")
    fresh = D.rule_documents(R.recommend(features, rule_products(c)), c.asof.cast("timestamp"))
    return I.merge_documents(stored, fresh).select(
        "customer_id", "algorithm_type", F.coalesce(F.size("recommendations"), F.lit(0)).alias("items"))


# Encodings on the feature inputs

@query("income_one_hot", "member_id b, " + ", ".join(f"{n} b" for n, _, _ in E.INCOME_FLAGS), """
SELECT member_id, (x<30000)::INT AS income_under_30k, (x>=30000 AND x<50000)::INT AS income_30k_50k, (x>=50000 AND x<75000)::INT AS income_50k_75k,
 (x>=75000 AND x<100000)::INT AS income_75k_100k, (x>=100000 AND x<150000)::INT AS income_100k_150k, (x>=150000)::INT AS income_over_150k
FROM (SELECT member_id, annual_income AS x FROM members)""")
def _(c: Context):
    return c.src.member_ids.withColumns(E.bracket_flags(F.col("annual_income"), E.INCOME_FLAGS))


@query("credit_one_hot", "metric_id b, " + ", ".join(f"{n} b" for n, _, _ in E.CREDIT_FLAGS), """
SELECT metric_id, (x<580)::INT AS credit_poor, (x>=580 AND x<670)::INT AS credit_fair, (x>=670 AND x<740)::INT AS credit_good,
 (x>=740 AND x<800)::INT AS credit_very_good, (x>=800)::INT AS credit_excellent FROM (SELECT metric_id, credit_score AS x FROM financial_health_metrics)""")
def _(c: Context):
    return c.src.financial_health_metrics.withColumns(E.bracket_flags(F.col("credit_score"), E.CREDIT_FLAGS))


@query("upsert_latest_documents", "customer_id s, created_at s, algorithm_type s",
       f"SELECT * FROM {_BOTH_SQL} QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, algorithm_type DESC)=1")
def _(c: Context):
    return K.latest_per_key(_both(c), ["customer_id"], [F.desc("created_at"), F.desc("algorithm_type")])
