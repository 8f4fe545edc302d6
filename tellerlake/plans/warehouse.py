"""Star schema: five dimensions and four facts, built lazily from the source tables.

Facts carry the natural keys next to the surrogate keys. A reload gives a member a new surrogate key, so
marts join the current dimension row through the natural key and keep the history.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import dates as D
from ..functions.numbers import half_up, num
from ..operators import keyed as K
from ..sources.bank import BankSources

RATIO_CAP = 9.9999  # fixed value: the largest ratio a DECIMAL(5,4) column holds
METHODS = ["auto_pay", "online", "phone", "mail", "branch"]  # fixed values, in key order


def dim_date(spark: SparkSession, first_year: int = 2020, last_year: int = 2030, fiscal_start: int = 1) -> DataFrame:
    """One row per calendar day; a bounded table by construction."""
    if first_year > last_year:
        raise ValueError("first_year <= last_year")
    days = spark.range(1).select(F.explode(F.sequence(
        D.day(f"{first_year}-01-01"), D.day(f"{last_year}-12-31"), F.expr("interval 1 day"))).alias("d"))
    return days.select(*[c.alias(n) for n, c in D.calendar_columns(F.col("d"), fiscal_start).items()])


def member_rows(members: DataFrame, asof: Column) -> DataFrame:
    """Members with their derived dimension attributes."""
    return members.withColumns({
        "age_group": B.age_group(F.col("date_of_birth"), asof),
        "region": B.region(F.col("state")),
        "income_bracket": B.income_bracket(F.col("annual_income")),
        **({"member_tenure_years": D.tenure_years(F.col("member_since"), asof)} if "member_since" in members.columns else {}),
    })


def card_rows(cards: DataFrame, current_members: DataFrame, asof: Column) -> DataFrame:
    """Cards of known members with their derived attributes; other cards are left out."""
    keys = current_members.select("member_id", "member_key")
    return cards.join(keys, "member_id").select(
        "card_id", "member_id", "member_key", "card_type", "credit_limit",
        B.credit_limit_tier(F.col("credit_limit")).alias("credit_limit_tier"), "apr_rate",
        B.apr_category(F.col("apr_rate")).alias("apr_category"), "card_status", "issue_date",
        D.repair_date(F.col("expiry_date")).alias("expiry_date"),
        D.months_apart(F.col("issue_date"), asof).alias("card_age_months"),
    )


def product_rows(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("product_id").alias("product_key"), "product_id", "product_name", "product_type", "product_category",
        "interest_rate", B.interest_rate_tier(F.col("interest_rate")).alias("interest_rate_tier"),
        "credit_limit_min", "credit_limit_max", "minimum_income_required", "minimum_credit_score",
        "maximum_debt_to_income", "annual_fee", B.fee_category(F.col("annual_fee")).alias("fee_category"),
        "rewards_program", B.has_rewards(F.col("rewards_program")).alias("has_rewards"),
        B.eligibility_tier(F.col("minimum_credit_score"), F.col("minimum_income_required"),
                           F.col("maximum_debt_to_income")).alias("eligibility_tier"),
        "is_active",
    )


def load_products(old: DataFrame, products: DataFrame, stamp: Column) -> DataFrame:
    """Overwrite by product_id; rows that already exist keep their created_at."""
    fresh = product_rows(products).withColumns({"created_at": stamp, "updated_at": stamp})
    born = old.select("product_id", F.col("created_at").alias("_born"))
    fresh = fresh.join(born, "product_id", "left").withColumn(
        "created_at", F.coalesce("_born", "created_at")).drop("_born")
    return K.upsert(old, fresh, ["product_id"])


def payment_method_usage(payments: DataFrame) -> DataFrame:
    """Usage of every stated payment method; unordered, at most one row per method."""
    method = F.col("payment_method")
    used = payments.filter(method.isNotNull() & (method != "")).groupBy("payment_method").agg(
        F.count("*").alias("usage_count"), F.sum("payment_amount").alias("amount"),
        F.sum(F.when(F.col("payment_status") == "on_time", 1).otherwise(0)).alias("on_time_count"),
        F.sum(F.when(F.col("payment_status") == "late", 1).otherwise(0)).alias("late_count"),
    )
    return used.select(
        "payment_method", "usage_count", half_up(num("amount") / num("usage_count"), 6).alias("avg_payment_amount"),
        "on_time_count", "late_count", half_up(num("on_time_count") / num("usage_count"), 6).alias("on_time_rate"))


def method_key(method: Column) -> Column:
    """Key of a method: its place in the fixed list; null for anything else."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in METHODS]), method), F.lit(0)).cast("int")


def payment_method_rows(methods: DataFrame) -> DataFrame:
    method = F.col("payment_method")
    return methods.select(
        method_key(method).alias("payment_method_key"), "payment_method",
        B.payment_channel(method).alias("payment_channel"), B.convenience_score(method).alias("convenience_score"))


def bounded_keys(payments: DataFrame, dates: DataFrame, methods: DataFrame, how: str = "inner") -> DataFrame:
    """Payments with the keys of their day and method; both dimensions are bounded, so they are broadcast."""
    days = F.broadcast(dates.select(F.col("date_key").alias("payment_date_key"), F.col("date_value").alias("payment_date")))
    kinds = F.broadcast(methods.select("payment_method_key", "payment_method"))
    return payments.join(kinds, "payment_method", how).join(days, "payment_date", how)


def payment_keys(payments: DataFrame, members: DataFrame, cards: DataFrame, dates: DataFrame,
                 methods: DataFrame, how: str = "inner", stored: DataFrame | None = None) -> DataFrame:
    """Payments with their four dimension keys.

    Members and cards are not bounded, so Spark picks the joins from their size. With ``stored``, the same payments in a
    table that is cheap to read again, they meet its distinct pairs of card and member, and the payments themselves are
    shuffled once for both keys. Hot members are split at run time.
    """
    cards, members = cards.select("card_id", "card_key"), members.select("member_id", "member_key")
    if stored is None:
        return bounded_keys(payments, dates, methods, how).join(cards, "card_id", how).join(members, "member_id", how)
    pairs = stored.select("card_id", "member_id").distinct().join(cards, "card_id", how).join(members, "member_id", how)
    pairs = pairs.select(F.col("card_id").alias("_card"), F.col("member_id").alias("_member"), "card_key", "member_key")
    same = F.col("card_id").eqNullSafe(F.col("_card")) & F.col("member_id").eqNullSafe(F.col("_member"))
    if how == "inner":  # rows without a card or member have no keys
        same = (F.col("card_id") == F.col("_card")) & (F.col("member_id") == F.col("_member"))
    return bounded_keys(payments, dates, methods, how).join(pairs, same, how).drop("_card", "_member")


def skipped_payments(payments: DataFrame, members: DataFrame, cards: DataFrame, dates: DataFrame,
                     methods: DataFrame) -> DataFrame:
    """Payments without all four keys, and which keys they lack."""
    found = payment_keys(payments, members, cards, dates, methods, "left")
    names = ["member_key", "card_key", "payment_date_key", "payment_method_key"]
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    return found.select("payment_id", missing.alias("missing")).filter(F.size("missing") > 0)


def payment_facts(keyed: DataFrame) -> DataFrame:
    paid, due, balance = F.col("payment_amount"), F.col("minimum_due"), F.col("statement_balance")
    usable = (due > 0) & (paid != 0)
    ratio = half_up(F.least(num(paid) / F.when(usable, num(due)), F.lit(RATIO_CAP)), 4)

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    return keyed.select(
        F.col("payment_id").alias("payment_key"), "member_key", "card_key", "payment_date_key", "payment_method_key",
        "member_id", "card_id", "payment_date", "payment_method", "payment_amount", "minimum_due",
        "statement_balance", "late_fee", "days_late",
        F.when(usable, ratio).alias("payment_ratio"), (paid - due).alias("excess_payment"),
        flag(F.col("payment_status") == "on_time").alias("is_on_time"), flag(paid >= balance).alias("is_full_payment"),
        flag(paid >= due).alias("is_minimum_payment"), flag(paid > balance).alias("is_over_payment"), "payment_status",
    )


def health_facts(metrics: DataFrame, members: DataFrame | None, dates: DataFrame) -> DataFrame:
    days = F.broadcast(dates.select(F.col("date_key").alias("assessment_date_key"), F.col("date_value").alias("assessment_date")))
    keyed = metrics.join(days, "assessment_date")
    if members is not None:  # else the metrics have their keys
        keyed = keyed.join(members.select("member_id", "member_key"), "member_id")
    zero = F.lit(0).cast("decimal(12,2)")
    assets = F.coalesce(F.col("savings_balance"), zero) + F.coalesce(F.col("checking_balance"), zero)
    debt = F.coalesce(F.col("total_debt"), zero)
    ratio = half_up(F.least(num(debt) / F.when(assets != 0, num(assets)), F.lit(RATIO_CAP)), 4)
    return keyed.select(
        F.col("metric_id").alias("health_key"), "member_key", "assessment_date_key", "member_id", "assessment_date",
        "credit_score", "debt_to_income_ratio", "credit_utilization_ratio", "payment_reliability_score",
        "savings_balance", "checking_balance", "total_debt", "number_of_accounts", "recent_inquiries",
        "delinquent_accounts", "health_score", assets.alias("total_liquid_assets"),
        ratio.alias("debt_to_assets_ratio"), (assets - debt).alias("net_worth"), "risk_category",
        B.credit_score_tier(F.col("credit_score")).alias("credit_score_tier"),
        B.utilization_tier(F.col("credit_utilization_ratio")).alias("utilization_tier"),
    )


def recommendation_facts(recs: DataFrame, members: DataFrame, products: DataFrame, dates: DataFrame, asof: Column) -> DataFrame:
    days = F.broadcast(dates.select(F.col("date_key").alias("recommendation_date_key"), F.col("date_value").alias("recommendation_date")))
    score = F.col("recommendation_score")
    return (
        recs.join(days, "recommendation_date")
        .join(products.select("product_id", "product_key"), "product_id")
        .join(members.select("member_id", "member_key"), "member_id")
        .select(
            F.col("recommendation_id").alias("recommendation_key"), "member_key", "product_key", "recommendation_date_key",
            D.date_key(F.col("expires_at")).alias("expires_date_key"), "member_id", "product_id", "recommendation_date",
            "recommendation_score", "member_health_score", "credit_utilization_at_time", "payment_reliability_at_time",
            B.recommendation_tier(score).alias("recommendation_tier"),
            F.datediff("expires_at", asof).alias("days_to_expiry"),
            F.coalesce(F.col("expires_at") < asof, F.lit(False)).alias("is_expired"),
            F.coalesce(score > 80, F.lit(False)).alias("is_high_confidence"), "recommendation_status",
        )
    )


def monthly_balances(cards: DataFrame, payments: DataFrame, asof: Column) -> DataFrame:
    """One balance per card and month end.

    Past months take the latest statement of the month; the last full month before ``asof`` takes the
    balance of the card itself.
    """
    closing = F.last_day(F.add_months(asof, -1))
    statements = payments.select(
        "card_id", F.last_day("payment_date").alias("snapshot_date"), "payment_date", "payment_id",
        F.col("statement_balance").alias("current_balance"), F.col("minimum_due").cast("decimal(8,2)").alias("minimum_payment"),
    ).filter(F.col("snapshot_date") < closing)
    # Latest statement by (day of month, id): a mergeable maximum, so a hot card is combined before the shuffle.
    # Both parts fit one number, which keeps the aggregate hash-based.
    recency = F.dayofmonth("payment_date").cast("decimal(2,0)") * F.lit(Decimal(10**19)) + F.col("payment_id")
    past = statements.groupBy("card_id", "snapshot_date").agg(
        F.max_by("current_balance", recency).alias("current_balance"),
        F.max_by("minimum_payment", recency).alias("minimum_payment"))
    now = cards.select("card_id", closing.alias("snapshot_date"), "current_balance",
                       F.lit(None).cast("decimal(8,2)").alias("minimum_payment"))
    return past.unionByName(now)


def balance_facts(balances: DataFrame, cards: DataFrame, dates: DataFrame) -> DataFrame:
    """Balance snapshots with utilization, trend and flags.

    A card has at most one snapshot per month, which bounds the lag window.
    """
    days = F.broadcast(dates.select(F.col("date_key").alias("snapshot_date_key"), F.col("date_value").alias("snapshot_date")))
    owners = cards.select("card_id", "card_key", "member_id", "member_key", "credit_limit")
    joined = balances.join(days, "snapshot_date").join(owners, "card_id")
    balance, limit = F.col("current_balance"), F.col("credit_limit")
    before = F.lag("current_balance").over(Window.partitionBy("card_id").orderBy("snapshot_date"))
    used = F.when(limit > 0, half_up(F.least(num(balance) / F.when(limit > 0, num(limit)), F.lit(RATIO_CAP)), 4)).otherwise(F.lit(0.0))
    trend = F.when(balance > before, "Increasing").when(balance < before, "Decreasing").otherwise("Stable")
    return joined.withColumn("balance_trend", trend).withColumn("utilization_ratio", used).select(
        (F.col("card_id") * 1000000 + F.floor(F.col("snapshot_date_key") / 100)).alias("balance_key"),
        "member_key", "card_key", "snapshot_date_key", "member_id", "card_id", "snapshot_date", "credit_limit",
        "current_balance", (limit - balance).alias("available_credit"), "minimum_payment", "utilization_ratio",
        B.utilization_tier(F.col("utilization_ratio")).alias("utilization_tier"), "balance_trend",
        (balance > limit).alias("is_over_limit"), (F.col("utilization_ratio") > 0.80).alias("is_high_utilization"),
        (F.col("utilization_ratio") > 0.95).alias("is_maxed_out"),
    )


class Warehouse:
    """First load of the star schema as of one date."""

    def __init__(self, sources: BankSources, asof: str, first_year: int, last_year: int):
        self.src = sources
        self.spark = sources.spark
        self.asof = D.day(asof)
        self.years = (first_year, last_year)

    @cached_property
    def dim_date(self) -> DataFrame:
        return dim_date(self.spark, *self.years)

    @cached_property
    def dim_member(self) -> DataFrame:
        return K.first_versions(member_rows(self.src.members, self.asof), "member_id", "member_key", self.asof, "expiry_date")

    @cached_property
    def current_members(self) -> DataFrame:
        """Current member rows without the tenure, for joins that need not read the orders."""
        rows = member_rows(self.src.member_ids, self.asof)
        return K.first_versions(rows, "member_id", "member_key", self.asof, "expiry_date").filter("is_current")

    @cached_property
    def dim_credit_card(self) -> DataFrame:
        rows = card_rows(self.src.credit_cards, self.current_members, self.asof)
        return K.first_versions(rows, "card_id", "card_key", self.asof, "expiry_date_scd")

    @cached_property
    def current_cards(self) -> DataFrame:
        return self.dim_credit_card.filter("is_current")

    @cached_property
    def dim_financial_product(self) -> DataFrame:
        return product_rows(self.src.financial_products)

    @cached_property
    def dim_payment_method(self) -> DataFrame:
        """The listed payment methods; bounded by the list."""
        rows = self.spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("payment_method"))
        return payment_method_rows(rows)

    @cached_property
    def fact_payment(self) -> DataFrame:
        return payment_facts(payment_keys(self.src.payment_history, self.current_members, self.current_cards,
                                          self.dim_date, self.dim_payment_method))

    @cached_property
    def fact_financial_health(self) -> DataFrame:
        return health_facts(self.src.financial_health_metrics, self.current_members, self.dim_date)

    @cached_property
    def fact_product_recommendation(self) -> DataFrame:
        return recommendation_facts(self.src.product_recommendations, self.current_members,
                                    self.dim_financial_product, self.dim_date, self.asof)

    @cached_property
    def fact_credit_card_balance(self) -> DataFrame:
        return balance_facts(monthly_balances(self.src.credit_cards, self.src.payment_history, self.asof),
                             self.current_cards, self.dim_date)

    def table(self, name: str) -> DataFrame:
        if not (name.startswith("dim_") or name.startswith("fact_")):
            raise KeyError(name)
        return getattr(self, name)
