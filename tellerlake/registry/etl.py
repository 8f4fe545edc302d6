"""Loads: dimensions, facts, incremental and streaming forms, audit and data checks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as DT
from ..operators import checks as CH
from ..operators import keyed as K
from ..plans import pipeline as PL
from ..plans import statements as ST
from ..plans import warehouse as W
from ..session import work_path
from ..sources import schemas as SC
from ..streaming import incremental as I
from ..streaming import expiry as X
from ..streaming import query_log as Q
from ..streaming.incremental import read_stream
from .base import FIRST_YEAR, LAST_YEAR, Context, query
from .oracle_tables import ASOF as A

MIDDLE = "(SELECT (min(payment_id)+max(payment_id))//2 FROM payment_history)"


def _middle(c: Context) -> int:
    """A mark in the middle of the payment ids."""
    low, high = c.src.payment_history.agg(F.min("payment_id"), F.max("payment_id")).first()
    return (low + high) // 2


@query("extract_since", "payment_id b, member_id b, payment_amount d", f"SELECT * FROM payment_history WHERE payment_id > {MIDDLE}")
def _(c: Context):
    return K.rows_since(c.src.payment_history, "payment_id", _middle(c))


@query("extract_events_since", "event_id b, user_id b, event_type s", "SELECT * FROM events WHERE event_id > (SELECT max(event_id)//4 FROM events)")
def _(c: Context):
    events = c.raw("events")
    return K.rows_since(events, "event_id", events.agg(F.max("event_id")).first()[0] // 4)


@query("high_water_mark", "job_name s, source_table s, last_processed_id b, records_processed b", """
SELECT 'payments' AS job_name, 'payment_history' AS source_table, max(payment_id) AS last_processed_id, count(*) AS records_processed FROM payment_history
UNION ALL SELECT 'query_log', 'events', max(event_id), count(*) FROM events UNION ALL SELECT 'members', 'members', max(member_id), count(*) FROM members""")
def _(c: Context):
    marks = [K.high_water_marks(df, key, job, source) for df, key, job, source in (
        (c.src.payment_history, "payment_id", "payments", "payment_history"), (c.raw("events"), "event_id", "query_log", "events"),
        (c.src.member_ids, "member_id", "members", "members"))]
    return marks[0].unionByName(marks[1]).unionByName(marks[2])


@query("build_dim_date", "date_key b, date_value s, day_of_week b, day_name s, week_of_year b, month_name s, is_weekend o, is_holiday o, fiscal_quarter b, orders b",
       "SELECT d.*, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE)=d.date_value) AS orders FROM dim_date d")
def _(c: Context):
    """The calendar over the years of the orders, with the orders of each day."""
    per_day = c.raw("orders").groupBy(F.to_date("o_orderdate").alias("date_value")).agg(F.count("*").alias("orders"))
    return W.dim_date(c.spark, FIRST_YEAR, LAST_YEAR).join(per_day, "date_value", "left").fillna({"orders": 0})


@query("build_dim_payment_method", "payment_method_key b, payment_method s, payment_channel s, convenience_score b, usage_count b",
       "SELECT k.*, u.usage_count FROM dim_payment_method k JOIN (SELECT payment_method, count(*) AS usage_count FROM payment_history GROUP BY 1) u USING (payment_method)")
def _(c: Context):
    usage = W.payment_method_usage(c.src.payment_history)
    return W.payment_method_rows(usage.select("payment_method")).join(usage, "payment_method")


_MEMBER_DIM = ("member_key b, member_id b, first_name s, last_name s, age_group s, region s, income_bracket s, member_tenure_years b, annual_income d, "
               "member_status s, effective_date s, expiry_date s, is_current o")


@query("build_dim_member", _MEMBER_DIM, "SELECT * FROM dim_member")
def _(c: Context):
    return c.wh.dim_member


def _reload(c: Context, compare: list[str] | None):
    """A first load on 2001-06-30, then a load as of today in which every seventh income has risen."""
    first = DT.day("2001-06-30")
    rows = c.src.member_ids.select("member_id", "annual_income", "member_status")
    history = K.first_versions(rows, "member_id", "member_key", first, "expiry_date")
    raised = rows.withColumn("annual_income", F.when(F.col("member_id") % 7 == 0, (F.col("annual_income") + 1000).cast("decimal(12,2)"))
                             .otherwise(F.col("annual_income")))
    return K.scd2_load(history, raised, "member_id", "member_key", c.asof, "expiry_date", compare)


def _reload_sql(test: str) -> str:
    key = "member_id*100000+datediff('day',DATE '1970-01-01',{0}) AS member_key"
    return f"""SELECT {key.format("DATE '2001-06-30'")}, member_id, annual_income, DATE '2001-06-30' AS effective_date,
 CASE WHEN {test} THEN {A} END AS expiry_date, NOT ({test}) AS is_current FROM members
UNION ALL SELECT {key.format(A)}, member_id, CASE WHEN member_id%7=0 THEN annual_income+1000 ELSE annual_income END, {A}, NULL, true FROM members WHERE {test}"""


_VERSIONS = "member_key b, member_id b, annual_income d, effective_date s, expiry_date s, is_current o"


@query("scd2_reload_always", _VERSIONS, _reload_sql("true"))
def _(c: Context):
    return _reload(c, None)


@query("scd2_reload_changed", _VERSIONS, _reload_sql("member_id%7=0"))
def _(c: Context):
    return _reload(c, ["annual_income", "member_status"])


@query("build_dim_credit_card", "card_key b, card_id b, member_key b, card_type s, credit_limit d, credit_limit_tier s, apr_rate d, apr_category s, card_status s, "
       "issue_date s, expiry_date s, card_age_months b, effective_date s, expiry_date_scd s, is_current o", "SELECT * FROM dim_credit_card")
def _(c: Context):
    return c.wh.dim_credit_card


@query("build_dim_product", "product_key b, product_id b, product_name s, interest_rate_tier s, fee_category s, has_rewards o, eligibility_tier s, created_at s, updated_at s",
       f"SELECT *, CASE WHEN product_category IN ('basic','premium') THEN DATE '2001-01-01' ELSE {A} END AS created_at, {A} AS updated_at FROM dim_financial_product")
def _(c: Context):
    before = DT.day("2001-01-01")
    old = W.product_rows(c.src.financial_products.filter("product_category IN ('basic', 'premium')")).withColumns(
        {"created_at": before, "updated_at": before})
    return W.load_products(old, c.src.financial_products, c.asof)


_PAYMENT_FACT = ("payment_key b, member_key b, card_key b, payment_date_key b, payment_method_key b, payment_amount d, minimum_due d, statement_balance d, late_fee d, "
                 "days_late b, payment_ratio d, excess_payment d, is_on_time o, is_full_payment o, is_minimum_payment o, is_over_payment o, payment_status s")


@query("build_fact_payment", _PAYMENT_FACT, "SELECT * FROM fact_payment")
def _(c: Context):
    return c.wh.fact_payment


def _dims(c: Context):
    return c.wh.current_members, c.wh.current_cards, c.wh.dim_date, c.wh.dim_payment_method


@query("incremental_fact_load", _PAYMENT_FACT, "SELECT * FROM fact_payment")
def _(c: Context):
    """Two loads: all payments up to a mark, then the rest, appended."""
    mark, path = _middle(c), work_path(c.spark, "fact_payment")
    first = I.new_payment_facts(c.src.payment_history.filter(F.col("payment_id") <= mark), 0, *_dims(c))
    first.write.mode("append").parquet(path)
    I.new_payment_facts(c.src.payment_history, mark, *_dims(c)).write.mode("append").parquet(path)
    return c.spark.read.parquet(path)


@query("incremental_fact_stream", _PAYMENT_FACT, "SELECT * FROM fact_payment")
def _(c: Context):
    """The payments as a stream of files, several files per micro-batch."""
    source, target = work_path(c.spark, "payments"), work_path(c.spark, "fact_payment")
    c.src.payment_history.write.parquet(source)
    stream = I.read_stream(c.spark, source, c.src.payment_history.schema, files_per_batch=4)
    I.stream_payment_facts(stream, *_dims(c), target, work_path(c.spark, "checkpoint")).awaitTermination()
    return c.spark.read.parquet(target)


@query("build_fact_health", "health_key b, member_key b, assessment_date_key b, credit_score b, health_score d, total_liquid_assets d, debt_to_assets_ratio d, net_worth d, "
       "risk_category s, credit_score_tier s, utilization_tier s", "SELECT * FROM fact_financial_health")
def _(c: Context):
    return c.wh.fact_financial_health


@query("build_fact_recommendation", "recommendation_key b, member_key b, product_key b, recommendation_date_key b, expires_date_key b, recommendation_score d, "
       "member_health_score d, credit_utilization_at_time d, payment_reliability_at_time d, recommendation_tier s, days_to_expiry b, is_expired o, is_high_confidence o, "
       "recommendation_status s", "SELECT * FROM fact_product_recommendation")
def _(c: Context):
    return c.wh.fact_product_recommendation


@query("build_fact_balance", "balance_key b, member_key b, card_key b, snapshot_date_key b, credit_limit d, current_balance d, available_credit d, minimum_payment d, "
       "utilization_ratio d, utilization_tier s, balance_trend s, is_over_limit o, is_high_utilization o, is_maxed_out o", "SELECT * FROM fact_credit_card_balance")
def _(c: Context):
    return c.wh.fact_credit_card_balance


def _run(c: Context):
    folder = work_path(c.spark, "warehouse")
    return PL.run(c.spark, PL.warehouse_jobs(c.wh, folder), folder), folder


_RUN_SQL = """SELECT 'date_dimension' AS job_name, 'dim_date' AS target_table, 'success' AS status, (SELECT count(*) FROM dim_date) AS records_read, (SELECT count(*) FROM dim_date) AS records_written
UNION ALL SELECT 'payment_method','dim_payment_method','success',(SELECT count(*) FROM payment_history),(SELECT count(DISTINCT payment_method) FROM payment_history)
UNION ALL SELECT 'member','dim_member','success',(SELECT count(*) FROM members),(SELECT count(*) FROM dim_member)
UNION ALL SELECT 'credit_card','dim_credit_card','success',(SELECT count(*) FROM credit_cards),(SELECT count(*) FROM dim_credit_card)
UNION ALL SELECT 'financial_product','dim_financial_product','success',(SELECT count(*) FROM financial_products),(SELECT count(*) FROM dim_financial_product)
UNION ALL SELECT 'payment_history','fact_payment','success',(SELECT count(*) FROM payment_history),(SELECT count(*) FROM fact_payment)
UNION ALL SELECT 'financial_health','fact_financial_health','success',(SELECT count(*) FROM financial_health_metrics),(SELECT count(*) FROM fact_financial_health)
UNION ALL SELECT 'recommendation','fact_product_recommendation','success',(SELECT count(*) FROM product_recommendations),(SELECT count(*) FROM fact_product_recommendation)
UNION ALL SELECT 'card_balance','fact_credit_card_balance','success',(SELECT count(DISTINCT (card_id, last_day(payment_date))) FROM payment_history WHERE last_day(payment_date)<DATE '2001-12-31')+(SELECT count(*) FROM credit_cards),
 (SELECT count(*) FROM fact_credit_card_balance)"""


@query("run_pipeline", "job_name s, target_table s, status s, records_read b, records_written b", _RUN_SQL)
def _(c: Context):
    return _run(c)[0]


@query("audit_log", "job_name s, status s, seq b",
       f"SELECT job_name, unnest(['started','success']) AS status, unnest([0,1]) AS seq FROM ({_RUN_SQL})")
def _(c: Context):
    folder = _run(c)[1]
    return c.spark.read.schema(PL.AUDIT_SCHEMA).parquet(os.path.join(folder, "etl_job_audit_log"))


@query("pipeline_summary", "successful_jobs b, failed_jobs b, records_read b, records_written b",
       f"SELECT count(*) FILTER (status='success') AS successful_jobs, 0 AS failed_jobs, sum(records_read) AS records_read, sum(records_written) AS records_written FROM ({_RUN_SQL})")
def _(c: Context):
    return PL.summary(_run(c)[0])


# Query log

@query("query_log_counter", "date s, event_type s, user_id b, query_count b", "SELECT CAST(ts AS DATE) AS date, event_type, user_id, count(*) AS query_count FROM events GROUP BY ALL")
def _(c: Context):
    return ST.daily_counter(c.raw("events"), ["event_type", "user_id"])


@query("query_log_counter_stream", "date s, event_type s, user_id b, query_count b", "SELECT CAST(ts AS DATE) AS date, event_type, user_id, count(*) AS query_count FROM events GROUP BY ALL")
def _(c: Context):
    keys, target = ["event_type", "user_id"], work_path(c.spark, "query_log")
    Q.count_deltas(Q.read_events(c.spark, c.folder), keys, target, work_path(c.spark, "checkpoint")).awaitTermination()
    return Q.read_counters(c.spark, target, keys)


@query("query_log_daily_windows", "date s, query_count b", "SELECT CAST(ts AS DATE) AS date, count(*) AS query_count FROM events GROUP BY 1")
def _(c: Context):
    """The watermarked daily windows, in update mode."""
    target = work_path(c.spark, "windows")
    counted = Q.count_windows(Q.read_events(c.spark, c.folder), [], "3650 days")
    Q.latest_windows(counted, [], target, work_path(c.spark, "checkpoint")).awaitTermination()
    return Q.read_windows(c.spark, target, [])


# Keyed state with expiry

_LOADS_SQL = ("SELECT CAST(member_id AS VARCHAR) AS customer_id, CASE recommendation_status WHEN 'accepted' THEN 'rule_based' ELSE 'ml_similarity' END AS algorithm_type, "
              "CAST(recommendation_date AS TIMESTAMP) AS created_at FROM product_recommendations WHERE recommendation_status IN ('accepted', 'pending')")


@query("documents_expiring_stream", "customer_id s, algorithm_type s, created_at s", f"""
SELECT customer_id, algorithm_type, max(created_at) AS created_at FROM ({_LOADS_SQL}) GROUP BY ALL
HAVING max(created_at) >= (SELECT max(created_at) FROM ({_LOADS_SQL})) - INTERVAL 30 DAY""")
def _(c: Context):
    """Every version of the customers' documents as a stream of files in no order; documents go 30 days after their last version."""
    folder, keys = work_path(c.spark, "loads"), ["customer_id", "algorithm_type"]
    c.src.product_recommendations.filter("recommendation_status in ('accepted', 'pending')").select(
        F.col("member_id").cast("string").alias("customer_id"),
        F.when(F.col("recommendation_status") == "accepted", "rule_based").otherwise("ml_similarity").alias("algorithm_type"),
        F.col("recommendation_date").cast("timestamp").alias("created_at")).repartition(4).write.parquet(folder)
    loads = read_stream(c.spark, folder, c.spark.read.parquet(folder).schema, files_per_batch=2)
    return _kept(c, X.expiring(loads, keys, F.col("created_at"), 30), keys).withColumnRenamed("at", "created_at")


@query("query_log_recent_counters", "date s, event_type s, user_id b, query_count b", """
SELECT CAST(ts AS DATE) AS date, event_type, user_id, count(*) AS query_count FROM events
WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 7 GROUP BY ALL""")
def _(c: Context):
    """Daily counters as keyed state; a day's counters go when the log is more than seven days past it."""
    keys = ["date", "event_type", "user_id"]
    events = Q.read_events(c.spark, c.folder).withColumn("date", F.to_date("ts"))
    return _kept(c, X.expiring(events, keys, F.col("date"), 7), keys).withColumnRenamed("n", "query_count")


def _kept(c: Context, changes: DataFrame, keys: list[str]) -> DataFrame:
    target = work_path(c.spark, "changes")
    X.write_changes(changes, target, work_path(c.spark, "checkpoint")).awaitTermination()
    return X.kept_rows(c.spark, target, keys)


# Data checks

@query("orphan_keys", "constraint_name s, orphans b", " UNION ALL ".join(
    f"SELECT '{t}.{k}' AS constraint_name, count(*) AS orphans FROM {t} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})"
    for t, k, p, pk in SC.SOURCE_FOREIGN_KEYS + SC.STAR_FOREIGN_KEYS))
def _(c: Context):
    links = SC.SOURCE_FOREIGN_KEYS + SC.STAR_FOREIGN_KEYS
    names = {n for t, _, p, _ in links for n in (t, p)}
    tables = {n: c.wh.table(n) if n.startswith(("dim_", "fact_")) else c.src.table(n) for n in names}
    return CH.orphan_counts(tables, links)


@query("enum_check", "column_name s, outside b", " UNION ALL ".join(
    "SELECT '{0}.{1}' AS column_name, count(*) FILTER ({1} NOT IN ({2})) AS outside FROM {0}".format(t, k, ", ".join(f"'{v}'" for v in values))
    for (t, k), values in SC.ENUM_DOMAINS.items()))
def _(c: Context):
    return CH.enum_counts({t: c.src.table(t) for t, _ in SC.ENUM_DOMAINS}, SC.ENUM_DOMAINS)


@query("unique_check", "key_name s, repeated_keys b, rows_affected b", """
SELECT 'members.email' AS key_name, count(*) AS repeated_keys, coalesce(sum(n),0) AS rows_affected FROM (SELECT email, count(*) AS n FROM members GROUP BY 1 HAVING count(*)>1)
UNION ALL SELECT 'dim_credit_card.card_id', count(*), coalesce(sum(n),0) FROM (SELECT card_id, count(*) AS n FROM dim_credit_card WHERE is_current GROUP BY 1 HAVING count(*)>1)
UNION ALL SELECT 'payment_history.card_id', count(*), coalesce(sum(n),0) FROM (SELECT card_id, count(*) AS n FROM payment_history GROUP BY 1 HAVING count(*)>1)""")
def _(c: Context):
    found = [CH.repeated_keys(df, name, keys) for df, name, keys in (
        (c.src.member_ids, "members.email", ["email"]), (c.wh.current_cards, "dim_credit_card.card_id", ["card_id"]),
        (c.src.payment_history, "payment_history.card_id", ["card_id"]))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("decimal_fit", "value_name s, overflows b", f"""
SELECT 'payment_ratio' AS value_name, count(*) FILTER (minimum_due>0 AND CAST(payment_amount AS DOUBLE)/CAST(minimum_due AS DOUBLE)>=10) AS overflows FROM payment_history
UNION ALL SELECT 'statement_balance', count(*) FILTER (statement_balance>=10000) FROM payment_history""")
def _(c: Context):
    due = F.when(F.col("minimum_due") > 0, F.col("minimum_due").cast("double"))
    return CH.decimal_overflow(c.src.payment_history, {
        "payment_ratio": (F.col("payment_amount").cast("double") / due, 5, 4), "statement_balance": (F.col("statement_balance"), 6, 2)})
