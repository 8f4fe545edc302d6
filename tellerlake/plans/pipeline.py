"""The warehouse load: nine jobs in dependency order, with audit rows and high-water marks.

Every job is a lazy DataFrame and one write to a numbered load of its target. The job's mark commits the load, so a
load that breaks off is never read and its number is used again. Row counts come from observations of the write.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed as K
from ..operators.versions import as_of
from ..sources.bank import BankSources
from ..sources.files import append_fact
from . import warehouse as W

AUDIT_SCHEMA = ("run_id STRING, job_name STRING, source_table STRING, target_table STRING, status STRING, "
                "records_read BIGINT, records_written BIGINT, duration_seconds DOUBLE, error_message STRING, seq INT")
MARK_SCHEMA = ("job_name STRING, source_table STRING, target_table STRING, last_processed_id BIGINT, records_processed BIGINT, "
               "load INT, adds BOOLEAN")


@dataclass(frozen=True)
class Job:
    name: str
    source: str
    target: str
    extract: Callable[[], DataFrame]
    transform: Callable[[DataFrame], DataFrame]
    id_column: str | None = None  # extract only rows above the mark of this id
    date_key: str | None = None  # loads of this job add up and are laid out by this key; others replace the load before
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows  # columns of a row alone, taken where the rows are written
    begin: Callable[[], object] = lambda: None  # called as a run begins


def warehouse_jobs(w: W.Warehouse, folder: str) -> list[Job]:
    """Jobs that read each other's written dimensions, not each other's plans.

    Four of them read all payments: the first of a run writes these to the work folder.
    """
    src, staged = w.src, []

    def paid() -> BankSources:
        if not staged:
            staged.append(src.staged("payment_history"))
        return staged[0]

    def done(table: str) -> DataFrame:
        return stored_table(w.spark, folder, table)

    def current(table: str) -> DataFrame:
        return done(table).filter("is_current")

    def versions(rows: DataFrame, table: str, natural: str, key: str, expiry: str) -> DataFrame:
        """The first load opens a version of every row; later ones close it and open the next."""
        if next_load(w.spark, folder, table) == 0:
            return K.first_versions(rows, natural, key, w.asof, expiry)
        return K.scd2_load(done(table), rows, natural, key, w.asof, expiry)

    def members(rows: DataFrame) -> DataFrame:
        return versions(W.member_rows(rows, w.asof), "dim_member", "member_id", "member_key", "expiry_date")

    def cards(rows: DataFrame) -> DataFrame:
        derived = W.card_rows(rows, current("dim_member"), w.asof)
        return versions(derived, "dim_credit_card", "card_id", "card_key", "expiry_date_scd")

    def reloaded(*tables: str) -> bool:
        return any(next_load(w.spark, folder, t) > 1 for t in tables)

    def dated(rows: DataFrame, table: str, natural: str, key: str, day: str) -> DataFrame:
        """Rows with the key of the version that was valid on their day; the first version holds for all time before it."""
        return as_of(rows, done(table), natural, day, "effective_date", [key], from_ever=True).filter(F.col(key).isNotNull())

    def payments(rows: DataFrame) -> DataFrame:
        if not reloaded("dim_member", "dim_credit_card"):  # one version of each key
            new = K.rows_since(paid().payment_history, "payment_id", last_mark(w.spark, folder, "payment_history"))
            return W.payment_keys(
                rows, current("dim_member"), current("dim_credit_card"), done("dim_date"), done("dim_payment_method"), stored=new)
        keyed = dated(dated(rows, "dim_member", "member_id", "member_key", "payment_date"), "dim_credit_card", "card_id", "card_key", "payment_date")
        return W.bounded_keys(keyed, done("dim_date"), done("dim_payment_method"))

    def health(rows: DataFrame) -> DataFrame:
        if not reloaded("dim_member"):
            return W.health_facts(rows, current("dim_member"), done("dim_date"))
        return W.health_facts(dated(rows, "dim_member", "member_id", "member_key", "assessment_date"), None, done("dim_date"))

    return [
        Job("date_dimension", "generated", "dim_date", lambda: w.dim_date, lambda rows: rows),
        Job("payment_method", "payment_history", "dim_payment_method", lambda: paid().payment_history,
            lambda rows: W.payment_method_rows(W.payment_method_usage(rows).select("payment_method")), begin=staged.clear),
        Job("member", "members", "dim_member", lambda: src.members, members),
        Job("credit_card", "credit_cards", "dim_credit_card", lambda: src.credit_cards, cards),
        Job("financial_product", "financial_products", "dim_financial_product", lambda: src.financial_products, W.product_rows),
        Job("payment_history", "payment_history", "fact_payment", lambda: paid().payment_history, payments,
            "payment_id", "payment_date_key", W.payment_facts, staged.clear),
        Job("financial_health", "financial_health_metrics", "fact_financial_health", lambda: paid().financial_health_metrics,
            health, "metric_id", "assessment_date_key", begin=staged.clear),
        Job("recommendation", "product_recommendations", "fact_product_recommendation", lambda: src.product_recommendations,
            lambda rows: W.recommendation_facts(rows, current("dim_member"), done("dim_financial_product"), done("dim_date"), w.asof)),
        Job("card_balance", "payment_history", "fact_credit_card_balance",
            lambda: W.monthly_balances(src.credit_cards, paid().payment_history, w.asof),
            lambda rows: W.balance_facts(rows, current("dim_credit_card"), done("dim_date")), begin=staged.clear),
    ]


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """Marks of the loads that jobs have committed."""
    path = os.path.join(folder, "etl_process_tracking")
    fields = [f.split() for f in MARK_SCHEMA.split(", ")]
    spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in fields]).write.mode("ignore").parquet(path)
    return spark.read.schema(MARK_SCHEMA).parquet(path)


def last_mark(spark: SparkSession, folder: str, job: str) -> int:
    """Highest id a job has processed so far, 0 at first."""
    found = marks(spark, folder).filter(F.col("job_name") == job)
    return found.agg(F.coalesce(F.max("last_processed_id"), F.lit(0))).first()[0]


def next_load(spark: SparkSession, folder: str, table: str) -> int:
    found = marks(spark, folder).filter(F.col("target_table") == table)
    return found.agg(F.coalesce(F.max("load") + 1, F.lit(0))).first()[0]


def stored_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A warehouse table as the committed loads have left it: all loads of a growing fact, else the last one."""
    found = marks(spark, folder).filter(F.col("target_table") == table).select("load", "adds").collect()  # one row per load
    if not found:
        raise LookupError(f"{table} has not been loaded")
    loads = sorted({m.load for m in found if m.adds}) or [max(m.load for m in found)]
    path = os.path.join(folder, table)
    return spark.read.option("basePath", path).parquet(*[f"{path}/load={n}" for n in loads]).drop("load")


def _append(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    """Append a few literal rows; they are built in the JVM, no Python worker starts for them."""
    fields = [field.split() for field in schema.split(", ")]
    built = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)]) for row in rows])
    spark.range(0, 1, 1, 1).select(F.inline(built)).write.mode("append").parquet(path)


def run(spark: SparkSession, jobs: list[Job], folder: str, names: list[str] | None = None) -> DataFrame:
    """Run the named jobs (default: all) in order; a failure is recorded and the next job still runs."""
    run_id = uuid.uuid4().hex
    audit = os.path.join(folder, "etl_job_audit_log")
    ended: list[tuple] = []
    wanted = [j for j in jobs if names is None or j.name in names]
    for job in wanted:
        job.begin()
    for job in wanted:
        head = (run_id, job.name, job.source, job.target)
        # the end of a job and the start of the next are one append
        _append(spark, [*ended, (*head, "started", 0, 0, 0.0, None, 0)], AUDIT_SCHEMA, audit)
        start = time.monotonic()
        try:
            seen = _run_job(spark, job, folder)
            ended = [(*head, "success", *seen, time.monotonic() - start, None, 1)]
        except Exception as error:  # recorded, and the remaining jobs still run
            ended = [(*head, "failed", 0, 0, time.monotonic() - start, str(error), 1)]
    if ended:
        _append(spark, ended, AUDIT_SCHEMA, audit)
    return latest_audit(spark.read.schema(AUDIT_SCHEMA).parquet(audit).filter(F.col("run_id") == run_id))


def _run_job(spark: SparkSession, job: Job, folder: str) -> tuple[int, int]:
    """One write and its mark; both counts and the new mark are observed while the write runs."""
    rows = job.extract()
    load = next_load(spark, folder, job.target)
    top = F.lit(0).alias("top")
    if job.id_column:
        rows = K.rows_since(rows, job.id_column, last_mark(spark, folder, job.name))
        top = F.coalesce(F.max(job.id_column), F.lit(0)).alias("top")
    read, written = Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    out = job.transform(rows.observe(read, count, top))
    path = os.path.join(folder, job.target, f"load={load}")

    def finish(laid: DataFrame) -> DataFrame:
        return job.finish(laid).observe(written, count)

    if job.date_key:
        append_fact(out, path, job.date_key, "overwrite", finish)
    else:
        finish(out).write.mode("overwrite").parquet(path)
    if read.get["n"] or not job.id_column:
        _append(spark, [(job.name, job.source, job.target, read.get["top"], read.get["n"], load, bool(job.date_key))], MARK_SCHEMA,
                os.path.join(folder, "etl_process_tracking"))
    return read.get["n"], written.get["n"]


def latest_audit(audit: DataFrame) -> DataFrame:
    """Last row per run and job."""
    return K.latest_per_key(audit, ["run_id", "job_name"], [F.desc("seq")])


def summary(audit: DataFrame) -> DataFrame:
    done = F.col("status") == "success"
    return audit.agg(
        F.count(F.when(done, 1)).alias("successful_jobs"), F.count(F.when(~done, 1)).alias("failed_jobs"),
        F.sum("records_read").alias("records_read"), F.sum("records_written").alias("records_written"),
        F.sum("duration_seconds").alias("duration_seconds"))
