"""Warehouse, pipeline, documents, features, streams and connectors."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tellerlake.functions.dates import day
from tellerlake.plans import documents as D
from tellerlake.plans import features as FE
from tellerlake.plans import filters as P
from tellerlake.plans import pipeline as PL
from tellerlake.plans import rules as R
from tellerlake.plans import similarity as S
from tellerlake.plans import warehouse as W
from tellerlake.registry import recommend as RR
from tellerlake.session import cut, work_path
from tellerlake.sources import files
from tellerlake.sources.schemas import MEMBERS, RECOMMENDATION_DOCUMENT
from tellerlake.streaming import query_log as Q


def test_every_payment_is_loaded_or_reported(small):
    w = small.wh
    args = (small.src.payment_history, w.current_members, w.current_cards, w.dim_date, w.dim_payment_method)
    assert W.payment_keys(*args).count() + W.skipped_payments(*args).count() == small.src.payment_history.count()


def test_pipeline_twice_appends_nothing_new(spark, small):
    folder = work_path(spark, "warehouse")
    first = PL.run(spark, PL.warehouse_jobs(small.wh, folder), folder)
    assert first.filter("status <> 'success'").count() == 0
    facts = spark.read.parquet(f"{folder}/fact_payment").count()
    second = PL.run(spark, PL.warehouse_jobs(small.wh, folder), folder, ["payment_history", "financial_health"])
    assert [r.records_read for r in second.collect()] == [0, 0]
    assert spark.read.parquet(f"{folder}/fact_payment").count() == facts


def test_pipeline_goes_on_after_a_failure(spark, small):
    def broken():
        raise RuntimeError("source is away")

    jobs = [PL.Job("bad", "x", "t_bad", broken, lambda df: df), PL.Job("good", "x", "t_good", lambda: small.src.financial_products, lambda df: df)]
    folder = work_path(spark, "broken")
    got = {r.job_name: r for r in PL.run(spark, jobs, folder).collect()}
    assert got["bad"].status == "failed" and "away" in got["bad"].error_message
    assert (got["good"].status, got["good"].records_written) == ("success", small.src.financial_products.count())
    totals = PL.summary(PL.latest_audit(spark.read.schema(PL.AUDIT_SCHEMA).parquet(f"{folder}/etl_job_audit_log"))).first()
    assert (totals.successful_jobs, totals.failed_jobs) == (1, 1)


def test_csv_reports_broken_lines(spark, tmp_path):
    path = tmp_path / "members.csv"
    names = [f.name for f in MEMBERS.fields]
    good = "1,A,B,a@x,5,1980-01-02,s,c,NY,1,100.50,employed,2000-01-01,active"
    path.write_text("\n".join([",".join(names), good, good.replace("1980-01-02", "never").replace("1,A", "2,A")]))
    with pytest.warns(UserWarning):
        tables = files.scan_known_csvs(spark, [str(path), str(tmp_path / "other.csv")])
    assert list(tables) == ["members"]
    got = {r.member_id: r for r in tables["members"].cache().collect()}
    assert got[1].date_of_birth == dt.date(1980, 1, 2) and got[1]._corrupt_record is None
    assert got[2].date_of_birth is None and got[2]._corrupt_record is not None


def test_empty_source_is_reported(spark, small):
    tables = {"filled": small.src.member_ids, "empty": small.src.member_ids.filter("member_id < 0")}
    assert {r.table_name: r.has_rows for r in files.any_source_filled(tables).collect()} == {"filled": True, "empty": False}


def test_documents_survive_json(spark, small, tmp_path):
    docs = RR.rule_docs(small)
    path = str(tmp_path / "docs")
    files.sink_json(docs, path)
    back = spark.read.schema(RECOMMENDATION_DOCUMENT).json(path)
    assert back.count() == docs.count()
    first = json.loads(spark.read.text(path).first().value)
    assert [r["rank"] for r in first["recommendations"]] == [1, 2, 3, 4, 5]
    assert D.offers(docs, small.src.member_ids, small.asof).filter("size(attached) <> 2").count() == 0


def test_missing_document_gives_an_empty_list(spark, small):
    docs = RR.rule_docs(small).limit(1)
    wanted = spark.createDataFrame([("nobody",)], "customer_id string")
    assert D.for_customers(wanted, docs).first().recommendations == []


def test_default_profile_without_health(spark):
    members = spark.createDataFrame([(1, 1000.0, 50.0, 0.5)], "member_id bigint, annual_income double, total_balance double, on_time_payment_rate double")
    health = spark.createDataFrame([], "member_id bigint, credit_score int, debt_to_income_ratio double, payment_reliability_score double, savings_balance double, "
                                   "checking_balance double, total_debt double, health_score double, risk_category string")
    r = FE.with_health_or_defaults(members, health).first()
    assert (r.credit_score, r.debt_to_income_ratio, r.payment_reliability_score, r.savings_balance, r.checking_balance, r.total_debt, r.health_score,
            r.risk_category) == (650, 0.3, 50.0, 100.0, 50.0, 50.0, 75.0, "medium")


def test_favourite_method_tie_goes_to_the_smaller_name(spark):
    rows = [(1, i, dt.date(2001, 1, i), "on_time", 0, None, m) for i, m in enumerate(["phone", "mail", None, "phone", "mail", None, None], 1)]
    df = spark.createDataFrame(rows, "member_id bigint, payment_id bigint, payment_date date, payment_status string, days_late int, late_fee decimal(6,2), payment_method string")
    assert FE.payment_behaviour(df).first().payment_method_preference == "mail"


def test_basic_products_for_members_without_any(spark):
    health = spark.createDataFrame([(1, 400, 0.9, 50.0, 0.5, 50.0)], "member_id bigint, credit_score int, debt_to_income_ratio double, health_score double, "
                                   "credit_utilization_ratio double, payment_reliability_score double")
    members = spark.createDataFrame([(1, 10000.0)], "member_id bigint, annual_income double")
    products = spark.createDataFrame([(1, "a", "cd", "premium", 50000.0, 700, 0.3), (2, "b", "cd", "basic", 50000.0, 700, 0.3), (3, "c", "cd", "secured", None, 700, None)],
                                     "product_id bigint, product_name string, product_type string, product_category string, minimum_income_required double, "
                                     "minimum_credit_score int, maximum_debt_to_income double")
    pairs = R.catalogue_pairs(members, health, products)
    assert sorted(r.product_id for r in R.eligible_or_basic(pairs).collect()) == [2, 3]


def test_stream_counts_equal_batch_counts_after_a_replay(spark, small):
    keys, target = ["event_type"], work_path(spark, "log")
    events = small.raw("events")
    for _ in range(2):  # a new checkpoint replays the same batches over themselves
        Q.count_deltas(Q.read_events(spark, small.folder), keys, target, work_path(spark, "checkpoint")).awaitTermination()
    got = {(r.date, r.event_type): r.query_count for r in Q.read_counters(spark, target, keys).collect()}
    expected = {(r.d, r.event_type): r["count"] for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()}
    assert got == expected


def test_model_properties(small):
    scaled = RR.fitted(small)[1].persist()
    shares = [r.explained_variance for r in S.component_variance(scaled).orderBy("component").collect()]
    assert len(shares) == 15 and all(0 <= s <= 1 for s in shares) and sum(shares) <= 1 + 1e-9 and shares == sorted(shares, reverse=True)
    segments = S.customer_segments(scaled, k=4, restarts=2)
    assert segments.select("segment").distinct().count() == 4
    assert segments.count() == scaled.count()
    stats = S.model_stats(scaled, small.src.financial_products).first()
    assert (stats.feature_dimensions, stats.n_neighbors, stats.n_clusters) == (37, 50, 10)


def test_filters(small):
    products = small.wh.dim_financial_product
    assert P.filtered(products, "dim_financial_product", product_id=products.first().product_id).count() == 1
    with pytest.raises(ValueError):
        P.filtered(products, "dim_financial_product", colour="red")
    with pytest.raises(ValueError):
        P.search_customers(small.src.member_ids)
    assert P.unique_columns(products.select("product_id", "product_id", "product_id")).columns == ["product_id", "product_id_1", "product_id_2"]
    assert P.display(small.src.member_ids).columns == ["Customer ID", "Name", "Email", "Phone", "DOB"]


def test_jdbc_arguments(spark):
    with pytest.raises(ValueError):
        files.scan_jdbc(spark, "jdbc:none", "t", column="id", lower=5, upper=1, partitions=2)


def test_cut_uses_the_shared_folder(spark, small):
    df = cut(small.src.financial_products)
    assert df.count() == small.raw("part").select("p_type", "p_brand").distinct().count()
    assert os.path.isdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))


def test_facts_keep_history_after_a_reload(spark, small):
    """A reload gives members new keys; the payment summary still counts old payments."""
    from tellerlake.operators.keyed import scd2_load
    from tellerlake.plans.marts import member_payment_summary

    before = member_payment_summary(small.wh.fact_payment, small.wh.dim_member)
    rows = W.member_rows(small.src.members, small.asof)
    after = member_payment_summary(small.wh.fact_payment, scd2_load(
        small.wh.dim_member, rows, "member_id", "member_key", day("2002-06-01"), "expiry_date"))
    assert before.exceptAll(after).count() == 0 and before.count() == after.count()


def test_a_query_leaves_the_callers_options(spark):
    from tellerlake.registry import QUERIES

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        QUERIES["customer_count"](spark, "/root/testdata/sf0.001").collect()
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_streams_read_a_folder_of_files(spark, tmp_path):
    from tellerlake.registry import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for key in ("query_log_counter_stream", "query_log_daily_windows"):
        assert QUERIES[key](spark, str(tmp_path)).agg({"query_count": "sum"}).first()[0] == events.count()


def test_a_second_load_keeps_history(spark, small):
    """Members and cards get their next versions, facts are not doubled, and pages read the stored tables."""
    from tellerlake.plans.filters import point_lookup
    from tellerlake.plans.warehouse import Warehouse

    folder = work_path(spark, "two-loads")
    PL.run(small.spark, PL.warehouse_jobs(small.wh, folder), folder)
    later = Warehouse(small.src, "2002-02-01", 1995, 2002)
    for _ in range(2):  # the second run of a day replaces the first
        PL.run(small.spark, PL.warehouse_jobs(later, folder), folder)
    table = lambda name: PL.stored_table(small.spark, folder, name)
    members = table("dim_member")
    assert members.count() == 2 * small.src.members.count() and members.filter("is_current").count() == small.src.members.count()
    assert members.filter("NOT is_current").select("expiry_date").distinct().count() == 1
    assert table("dim_credit_card").count() == 2 * small.wh.dim_credit_card.count()
    assert table("fact_payment").count() == small.wh.fact_payment.count()
    assert table("fact_credit_card_balance").select("balance_key").distinct().count() == table("fact_credit_card_balance").count()
    one = point_lookup(table("fact_payment"), "payment_key", table("fact_payment").first().payment_key)
    assert one.count() == 1 and "EqualTo(payment_key" in one._jdf.queryExecution().toString()


def test_a_broken_load_is_written_over(spark, small):
    """A fact whose load broke off before its mark is not read, and the next run replaces it."""
    rows = spark.range(1, 11).selectExpr("id", "20010100 + id AS day")
    job = PL.Job("facts", "x", "fact_x", lambda: rows, lambda df: df, "id", "day")
    folder = work_path(spark, "loads")
    PL.run(spark, [job], folder)
    more = PL.Job("facts", "x", "fact_x", lambda: rows.unionAll(spark.range(11, 16).selectExpr("id", "20010200 + id AS day")), lambda df: df, "id", "day")
    files.append_fact(spark.range(90, 99).selectExpr("id", "20010200 AS day"), f"{folder}/fact_x/load=1", "day")
    assert PL.stored_table(spark, folder, "fact_x").count() == 10
    PL.run(spark, [more], folder)
    PL.run(spark, [more], folder)
    assert sorted(r.id for r in PL.stored_table(spark, folder, "fact_x").collect()) == list(range(1, 16))


def test_the_package_is_shipped(tmp_path):
    """Workers find the code although the program runs elsewhere and nothing is installed."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    program = f"""
import sys
sys.path.insert(0, {root!r})
from tellerlake.operators.neighbours import batch_top_k
from tellerlake.session import local_session, ship
spark = local_session("2", "elsewhere")
ship(spark, {str(tmp_path / 'code.zip')!r})
rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id bigint, v array<double>")
print("FOUND", batch_top_k(rows, rows, 2, id_column="id", vector="v", query_id="id").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 18" in done.stdout, done.stderr[-2000:]


def test_comparison_with_a_side_missing(spark):
    from tellerlake.plans import documents as D

    rule = spark.createDataFrame([("1", ["a"]), ("2", ["b"])], "customer_id string, recommendations array<string>")
    similar = spark.createDataFrame([("2", ["c"]), ("3", ["d"])], "customer_id string, recommendations array<string>")
    got = {r.customer_id: (r.rule_based, r.ml_based) for r in D.compared(rule, similar).collect()}
    assert got["1"][1] is None and got["3"][0] is None and got["2"][0].recommendations == ["b"] and "4" not in got


def test_payments_meet_pairs_of_their_keys(spark, small):
    """Cards and members by distinct pairs give the rows of the joins one by one, also for null, unknown and repeated keys; the payments are shuffled once."""
    w = small.wh
    some = small.src.payment_history.limit(200).localCheckpoint()
    odd = some.limit(20)
    payments = some.unionByName(odd.withColumn("card_id", F.lit(None).cast("bigint"))).unionByName(odd.withColumn("member_id", F.lit(None).cast("bigint"))).unionByName(
        odd.withColumn("member_id", F.lit(-1).cast("bigint"))).unionByName(odd)
    members = w.current_members.unionByName(w.current_members.filter("member_id % 3 = 0")).localCheckpoint()
    cards = w.current_cards.unionByName(w.current_cards.filter("card_id % 2 = 0")).localCheckpoint()
    for how in ("inner", "left"):
        args = (payments, members, cards, w.dim_date, w.dim_payment_method, how)
        plain, paired = (df.select("payment_id", "card_id", "member_id", "card_key", "member_key", "payment_date_key") for df in (W.payment_keys(*args), W.payment_keys(*args, stored=payments)))
        assert plain.count() == paired.count() > 200 and plain.exceptAll(paired).isEmpty()


def test_a_run_stages_the_payments_once(small, monkeypatch):
    from tellerlake.sources.bank import BankSources

    staged, real = [], BankSources.staged
    monkeypatch.setattr(BankSources, "staged", lambda self, *names: staged.append(names) or real(self, *names))
    folder = work_path(small.spark, "staged")
    jobs = PL.warehouse_jobs(small.wh, folder)
    for run in (1, 2):  # rows that have come since the first run are seen by the second
        assert PL.run(small.spark, jobs, folder).filter("status <> 'success'").isEmpty()
        assert staged == [("payment_history",)] * run
    assert PL.stored_table(small.spark, folder, "fact_payment").count() == small.wh.fact_payment.count()


def test_columns_of_a_row_are_derived_after_the_layout(spark):
    rows, path, seen = spark.range(40).selectExpr("id", "20010100 + id % 3 * 100 + 1 AS day"), work_path(spark, "laid"), []

    def finish(laid):
        seen.append(laid._jdf.queryExecution().toString())
        return laid.withColumn("twice", F.col("id") * 2)

    files.append_fact(rows, path, "day", finish=finish)
    assert "RebalancePartitions" in seen[0] and "twice" not in seen[0]
    got = spark.read.parquet(path)
    assert set(got.columns) == {"id", "day", "twice", "key_year", "key_month"} and got.filter("twice = 2 * id AND key_year = 2001 AND key_month = 1 + id % 3").count() == 40
