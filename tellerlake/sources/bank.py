"""The six source tables, derived lazily from the order tables."""

from __future__ import annotations

from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import kept
from . import derivation_sql as D
from .schemas import SOURCE_SCHEMAS


_SCHEMAS: WeakKeyDictionary[SparkSession, dict[str, T.StructType]] = WeakKeyDictionary()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet scan; a session, and so a query, reads the schema of a path from its files once."""
    path = f"{folder}/{name}.parquet"
    known = _SCHEMAS.setdefault(spark, {})
    if path not in known:
        known[path] = spark.read.parquet(path).schema
    return spark.read.schema(known[path]).parquet(path)


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast to the declared schema; column order is the schema's."""
    return df.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in SOURCE_SCHEMAS[table]])


class BankSources:
    """Lazy source tables; nothing is read before an action runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def members(self) -> DataFrame:
        orders = self.raw("orders")
        sql = D.MEMBERS.format(customer="{customer}", member_since=D.SINCE_COLUMN, since_join=D.SINCE_JOIN)
        return _conform(self.spark.sql(sql, customer=self.raw("customer"), orders=orders), "members")

    @cached_property
    def member_ids(self) -> DataFrame:
        """Members without the tenure date, which alone needs the orders table."""
        sql = D.MEMBERS.format(customer="{customer}", member_since="CAST(NULL AS DATE)", since_join="")
        return _conform(self.spark.sql(sql, customer=self.raw("customer")), "members").drop("member_since")

    @cached_property
    def credit_cards(self) -> DataFrame:
        return _conform(self.spark.sql(D.CREDIT_CARDS, orders=self.raw("orders")), "credit_cards")

    @cached_property
    def payment_history(self) -> DataFrame:
        df = self.spark.sql(D.PAYMENT_HISTORY, lineitem=self.raw("lineitem"), orders=self.raw("orders"))
        return _conform(df, "payment_history")

    @cached_property
    def financial_products(self) -> DataFrame:
        return _conform(self.spark.sql(D.FINANCIAL_PRODUCTS, part=self.raw("part")), "financial_products")

    @cached_property
    def financial_health_metrics(self) -> DataFrame:
        sql = D.HEALTH.format(members=D.SPARK_HEALTH_MEMBERS, credit_cards="{credit_cards}",
                              payment_history="{payment_history}")
        df = self.spark.sql(sql, members=self.member_ids, credit_cards=self.credit_cards,
                            payment_history=self.payment_history)
        return _conform(df, "financial_health_metrics")

    @cached_property
    def product_recommendations(self) -> DataFrame:
        sql = D.RECOMMENDATIONS.format(members="{members}", financial_products="{financial_products}",
                                       match=D.SPARK_RECOMMENDATION_MATCH)
        df = self.spark.sql(sql, members=self.member_ids, financial_products=self.financial_products)
        return _conform(df, "product_recommendations")

    def staged(self, *names: str) -> BankSources:
        """The same sources; the named tables are written to the work folder once, for jobs that read them several times."""
        out = BankSources(self.spark, self.folder)
        for name in names:
            vars(out)[name] = kept(self.table(name), name)
        return out

    def table(self, name: str) -> DataFrame:
        if name not in SOURCE_SCHEMAS:
            raise KeyError(f"unknown source table {name}")
        return getattr(self, name)
