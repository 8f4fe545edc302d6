"""Recommendation documents: one row per customer with a profile and ranked items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import keyed as K
from . import similarity as S

ALGORITHMS = {"rule_based": "oltp", "ml_similarity": "dw"}  # fixed values: algorithm and the source it reads


def tagged(docs: DataFrame, algorithm: str) -> DataFrame:
    return docs.withColumns({"algorithm_type": F.lit(algorithm), "data_source": F.lit(ALGORITHMS[algorithm])})


def _nested(rows: DataFrame, customer: str, profile: list[Column], confidence: Column, reason: str, stamp: Column,
            algorithm: str) -> DataFrame:
    """Ranked rows to one document per customer; a customer has at most the top n rows."""
    item = F.struct(
        F.col("rank").cast("int").alias("rank"), "product_name", "product_type", F.col("score"),
        F.lit(100.0).alias("max_score"), confidence.alias("confidence"), F.col(reason).alias("reason"))
    docs = rows.groupBy(F.col(customer).cast("string").alias("customer_id")).agg(
        F.first(F.struct(*profile)).alias("customer_profile"), F.sort_array(F.collect_list(item)).alias("recommendations"))
    return tagged(docs.withColumns({"created_at": stamp, "updated_at": stamp}), algorithm)


def rule_documents(recommended: DataFrame, stamp: Column) -> DataFrame:
    profile = [F.concat(F.lit("Member "), F.col("member_id")).alias("name"), F.col("annual_income"), F.col("credit_score"),
               F.col("health_score"), F.col("risk_category"), F.col("utilization_ratio")]
    return _nested(recommended, "member_id", profile, half_up(F.col("probability") * 100, 1), "reasons", stamp, "rule_based")


def similarity_documents(recommended: DataFrame, members: DataFrame, stamp: Column) -> DataFrame:
    names = members.select(F.col("member_id").alias("customer_id"), F.concat_ws(" ", "first_name", "last_name").alias("name"))
    rows = recommended.join(names, "customer_id", "left")
    profile = [F.coalesce("name", F.lit("Unknown")).alias("name"), *S.profile_columns()]
    return _nested(rows, "customer_id", profile, F.col("confidence"), "reason", stamp, "ml_similarity")


def exploded(docs: DataFrame) -> DataFrame:
    """One row per recommended item."""
    return docs.select("customer_id", "algorithm_type", F.col("customer_profile.name").alias("name"),
                       F.explode("recommendations").alias("r")).select("customer_id", "algorithm_type", "name", "r.*")


def for_customers(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of the wanted customers; a customer without one gets an empty list."""
    empty = F.array().cast(docs.schema["recommendations"].dataType)
    return wanted.select(F.col("customer_id").cast("string").alias("customer_id")).join(docs, "customer_id", "left").withColumn(
        "recommendations", F.coalesce("recommendations", empty))


def with_product(docs: DataFrame, product_name: str) -> DataFrame:
    return docs.filter(F.exists("recommendations", lambda r: r["product_name"] == F.lit(product_name)))


def compared(rule: DataFrame, similar: DataFrame) -> DataFrame:
    """Both documents of a customer side by side."""
    left = rule.select("customer_id", F.struct(*[c for c in rule.columns if c != "customer_id"]).alias("rule_based"))
    right = similar.select("customer_id", F.struct(*[c for c in similar.columns if c != "customer_id"]).alias("ml_based"))
    return left.join(right, "customer_id", "full_outer")


def collection_stats(rule: DataFrame, similar: DataFrame) -> DataFrame:
    """Document counts, latest creation times and distinct customers of both collections."""
    both = rule.select("customer_id", "created_at", F.lit(1).alias("r")).unionByName(
        similar.select("customer_id", "created_at", F.lit(0).alias("r")))
    per_customer = both.groupBy("customer_id").agg(
        F.sum("r").alias("rules"), F.sum(1 - F.col("r")).alias("similar"),
        F.max(F.when(F.col("r") == 1, F.col("created_at"))).alias("rule_at"),
        F.max(F.when(F.col("r") == 0, F.col("created_at"))).alias("similar_at"))
    return per_customer.agg(
        F.sum("rules").alias("rule_based_count"), F.sum("similar").alias("ml_based_count"),
        F.max("rule_at").alias("rule_latest_created"), F.max("similar_at").alias("ml_latest_created"),
        F.count("*").alias("total_unique_customers"))


def processing_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count(F.when(F.col("algorithm_type") == "ml_similarity", 1)).alias("total_ml_recommendations"),
        F.count("*").alias("total_recommendations"), F.max("created_at").alias("latest_update"))


def cleanup(docs: DataFrame, asof: Column, days: int = 30, algorithm: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents that stay, and the number of deleted ones per algorithm."""
    old = F.col("created_at") < F.date_sub(asof, days).cast("timestamp")
    if algorithm is not None:
        old = old & (F.col("algorithm_type") == algorithm)
    old = F.coalesce(old, F.lit(False))
    gone = docs.groupBy("algorithm_type").agg(F.count(F.when(old, 1)).alias("deleted_count"))
    return docs.filter(~old), gone


def offers(docs: DataFrame, members: DataFrame, stamp: Column, top: int = 2) -> DataFrame:
    """One offer per known customer with the first recommendations attached.

    The offer id is a digest of the customer id: a repeated run writes the same offer.
    """
    known = members.select(F.col("member_id").cast("string").alias("customer_id"))
    return docs.join(known, "customer_id", "left_semi").select(
        "customer_id", F.upper(F.substring(F.sha2("customer_id", 256), 1, 8)).alias("offer_id"),
        F.lit("created").alias("status"),
        F.concat(F.lit("Offer created successfully for customer id : "), F.col("customer_id")).alias("message"),
        F.slice("recommendations", 1, top).alias("attached"), stamp.alias("created_at"))


def save(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by customer; the latest document of a customer wins."""
    return K.upsert(old, new, ["customer_id"], [F.desc("created_at"), F.desc("algorithm_type")])


def missing_customers(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Active members without a stored document."""
    active = members.filter("member_status = 'active'").select(F.col("member_id").cast("string").alias("customer_id"))
    return active.join(docs.select("customer_id"), "customer_id", "left_anti")


def model_metadata(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert model metadata on name and version."""
    return K.upsert(runs, new, ["model_name", "version"], [F.desc("created_at")])


def latest_model(metadata: DataFrame) -> DataFrame:
    return K.latest_per_key(metadata, ["model_name"], [F.desc("created_at"), F.desc("version")])

