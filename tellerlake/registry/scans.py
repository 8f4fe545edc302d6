"""Scans, sinks and keyed document changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed as K
from ..plans import documents as D
from ..session import work_path
from ..sources import files
from ..sources.schemas import SOURCE_SCHEMAS
from .base import Context, query
from .oracle_tables import hu

MEMBER_COLUMNS = ("member_id b, first_name s, last_name s, email s, phone s, date_of_birth s, address s, city s, state s, "
                  "zip_code s, annual_income d, employment_status s, member_since s, member_status s")
CARD_COLUMNS = ("card_id b, member_id b, card_number s, card_type s, credit_limit d, current_balance d, apr_rate d, "
                "card_status s, issue_date s, expiry_date s")


@query("scan_csv_typed", MEMBER_COLUMNS, "SELECT * FROM members")
def _(c: Context):
    path = work_path(c.spark, "csv")
    files.sink_csv(c.src.members, path)
    return files.scan_csv(c.spark, path, SOURCE_SCHEMAS["members"])


@query("scan_full", MEMBER_COLUMNS, "SELECT * FROM members")
def _(c: Context):
    return c.src.members


@query("scan_full_cards", CARD_COLUMNS + ", available_credit d", "SELECT *, credit_limit-current_balance AS available_credit FROM credit_cards")
def _(c: Context):
    return c.src.credit_cards.withColumn("available_credit", F.col("credit_limit") - F.col("current_balance"))


@query("scan_full_payments", "payment_id b, member_id b, card_id b, payment_date s, payment_amount d, minimum_due d, payment_status s, "
       "days_late b, late_fee d, statement_balance d, payment_method s", "SELECT * FROM payment_history")
def _(c: Context):
    return c.src.payment_history


@query("scan_full_health", "metric_id b, member_id b, assessment_date s, credit_score b, debt_to_income_ratio d, credit_utilization_ratio d, "
       "payment_reliability_score d, savings_balance d, checking_balance d, total_debt d, number_of_accounts b, recent_inquiries b, "
       "delinquent_accounts b, health_score d, risk_category s", "SELECT * FROM financial_health_metrics")
def _(c: Context):
    return c.src.financial_health_metrics


@query("scan_full_products", "product_id b, product_name s, product_type s, product_category s, interest_rate d, credit_limit_min d, "
       "credit_limit_max d, minimum_income_required d, minimum_credit_score b, maximum_debt_to_income d, annual_fee d, rewards_program s, "
       "is_active o", "SELECT * FROM financial_products")
def _(c: Context):
    return c.src.financial_products


@query("scan_full_recommendations", "recommendation_id b, member_id b, product_id b, recommendation_date s, recommendation_score d, "
       "recommendation_status s, expires_at s", "SELECT * FROM product_recommendations")
def _(c: Context):
    return c.src.product_recommendations


@query("sink_csv", CARD_COLUMNS, "SELECT * FROM credit_cards")
def _(c: Context):
    path = work_path(c.spark, "credit_cards") + "/credit_cards.csv"
    files.sink_csv(c.src.credit_cards, path)
    return files.scan_known_csvs(c.spark, [path])["credit_cards"]


DOC_ITEM = "customer_id s, name s, rank b, product_name s, score d, confidence d, reason s"


@query("sink_json", DOC_ITEM,
       "SELECT member_id AS customer_id, 'Member '||member_id AS name, rank, product_name, score, "
       f"{hu(hu('probability', 3) + '*100', 1)} AS confidence, reasons AS reason FROM rule_top")
def _(c: Context):
    from .recommend import rule_docs

    docs = rule_docs(c)
    path = work_path(c.spark, "documents")
    files.sink_json(docs, path)
    return D.exploded(c.spark.read.schema(docs.schema).json(path))


@query("sink_append_fact", "payment_key b, payment_date_key b, payment_amount d, key_year b, key_month b",
       "SELECT payment_key, payment_date_key, payment_amount, payment_date_key//10000 AS key_year, payment_date_key//100%100 AS key_month FROM fact_payment")
def _(c: Context):
    path = work_path(c.spark, "fact_payment")
    files.append_fact(c.wh.fact_payment, path, "payment_date_key")
    return c.spark.read.parquet(path)


# Document tables for the keyed changes: accepted recommendations are the stored state, open ones the batch.

def _store(c: Context):
    rec = c.src.product_recommendations.filter("recommendation_status = 'accepted'")
    return rec.groupBy(F.col("member_id").alias("customer_id")).agg(
        F.max("recommendation_date").alias("created_at"), F.max_by("product_id", F.struct("recommendation_date", "product_id")).alias("product_id"))


def _batch(c: Context):
    rec = c.src.product_recommendations.filter("recommendation_status = 'pending'")
    return rec.select(F.col("member_id").alias("customer_id"), F.col("recommendation_date").alias("created_at"), "product_id")


_STORE_SQL = """SELECT customer_id, created_at, product_id FROM (SELECT member_id AS customer_id, recommendation_date AS created_at, product_id,
 row_number() OVER (PARTITION BY member_id ORDER BY recommendation_date DESC, product_id DESC) AS rn FROM product_recommendations
 WHERE recommendation_status='accepted') WHERE rn=1"""
_BATCH_SQL = _STORE_SQL.replace("'accepted'", "'pending'")


@query("upsert_documents", "customer_id b, created_at s, product_id b",
       f"SELECT * FROM ({_BATCH_SQL}) UNION ALL SELECT * FROM ({_STORE_SQL}) o WHERE NOT EXISTS "
       "(SELECT 1 FROM product_recommendations r WHERE r.recommendation_status='pending' AND r.member_id=o.customer_id)")
def _(c: Context):
    return K.upsert(_store(c), _batch(c), ["customer_id"], [F.desc("created_at"), F.desc("product_id")])


def _models(c: Context, year: int):
    """Model runs: one per card type and issue year."""
    cards = c.src.credit_cards.filter(F.year("issue_date") <= year)
    return cards.groupBy(F.col("card_type").alias("model_name"), F.year("issue_date").cast("string").alias("version")).agg(
        F.max("issue_date").alias("created_at"), F.count("*").alias("trained_on"))


def _models_sql(test: str) -> str:
    return ("SELECT card_type AS model_name, CAST(year(issue_date) AS VARCHAR) AS version, max(issue_date) AS created_at, count(*) AS trained_on "
            f"FROM credit_cards WHERE {test} GROUP BY ALL")


@query("upsert_model_metadata", "model_name s, version s, created_at s, trained_on b",
       f"SELECT * FROM ({_models_sql('year(issue_date)<=1998')}) UNION ALL SELECT model_name, version, created_at, -trained_on FROM "
       f"({_models_sql('year(issue_date)>1998')})")
def _(c: Context):
    old = _models(c, 9999).withColumn("trained_on", -F.col("trained_on"))
    return D.model_metadata(old, _models(c, 1998))


@query("latest_model_metadata", "model_name s, version s, created_at s, trained_on b",
       f"SELECT * FROM ({_models_sql('true')}) QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, version DESC)=1")
def _(c: Context):
    return D.latest_model(_models(c, 9999))


@query("patch_documents", "customer_id b, product_id b, created_at s, updated_at s",
       f"""SELECT o.customer_id, coalesce(n.product_id, o.product_id) AS product_id, o.created_at,
        CASE WHEN n.customer_id IS NOT NULL THEN DATE '2002-01-01' ELSE o.created_at END AS updated_at
        FROM ({_STORE_SQL}) o LEFT JOIN ({_BATCH_SQL}) n USING (customer_id)""")
def _(c: Context):
    changes = K.latest_per_key(_batch(c), ["customer_id"], [F.desc("created_at"), F.desc("product_id")]).drop("created_at")
    old = _store(c).withColumn("updated_at", F.col("created_at"))
    return K.patch(old, changes, ["customer_id"], stamp=c.asof)


@query("delete_documents", "customer_id b, created_at s, product_id b",
       f"SELECT * FROM ({_STORE_SQL}) WHERE customer_id NOT IN (SELECT member_id FROM members WHERE member_status<>'active')")
def _(c: Context):
    gone = c.src.member_ids.filter("member_status <> 'active'").select(F.col("member_id").alias("customer_id"))
    return K.delete_keys(_store(c), gone, ["customer_id"])


@query("insert_tagged_documents", "customer_id b, product_id b, algorithm_type s, data_source s",
       f"SELECT customer_id, product_id, 'rule_based' AS algorithm_type, 'oltp' AS data_source FROM ({_STORE_SQL}) UNION ALL "
       f"SELECT customer_id, product_id, 'ml_similarity', 'dw' FROM ({_BATCH_SQL})")
def _(c: Context):
    batch = K.latest_per_key(_batch(c), ["customer_id"], [F.desc("created_at"), F.desc("product_id")])
    return D.tagged(_store(c), "rule_based").unionByName(D.tagged(batch, "ml_similarity"))


@query("source_non_empty", "table_name s, has_rows o",
       " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)>0 AS has_rows FROM {t}" for t in SOURCE_SCHEMAS))
def _(c: Context):
    return files.any_source_filled({t: c.src.table(t) for t in SOURCE_SCHEMAS})
