"""Explicit schemas, allowed values and key constraints of the source and star tables."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DATE": T.DateType(),
           "BOOLEAN": T.BooleanType()}


def _type(kind: str) -> T.DataType:
    if kind.startswith("DECIMAL"):
        precision, scale = kind[8:-1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return _SIMPLE[kind]


def _schema(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in fields])


MEMBERS = _schema(
    ("member_id", "BIGINT"), ("first_name", "STRING"), ("last_name", "STRING"), ("email", "STRING"),
    ("phone", "STRING"), ("date_of_birth", "DATE"), ("address", "STRING"), ("city", "STRING"),
    ("state", "STRING"), ("zip_code", "STRING"), ("annual_income", "DECIMAL(12,2)"),
    ("employment_status", "STRING"), ("member_since", "DATE"), ("member_status", "STRING"),
)
CREDIT_CARDS = _schema(
    ("card_id", "BIGINT"), ("member_id", "BIGINT"), ("card_number", "STRING"), ("card_type", "STRING"),
    ("credit_limit", "DECIMAL(10,2)"), ("current_balance", "DECIMAL(10,2)"), ("apr_rate", "DECIMAL(5,4)"),
    ("card_status", "STRING"), ("issue_date", "DATE"), ("expiry_date", "STRING"),
)
PAYMENT_HISTORY = _schema(
    ("payment_id", "BIGINT"), ("member_id", "BIGINT"), ("card_id", "BIGINT"), ("payment_date", "DATE"),
    ("payment_amount", "DECIMAL(10,2)"), ("minimum_due", "DECIMAL(10,2)"), ("payment_status", "STRING"),
    ("days_late", "INT"), ("late_fee", "DECIMAL(6,2)"), ("statement_balance", "DECIMAL(10,2)"),
    ("payment_method", "STRING"),
)
FINANCIAL_HEALTH_METRICS = _schema(
    ("metric_id", "BIGINT"), ("member_id", "BIGINT"), ("assessment_date", "DATE"), ("credit_score", "INT"),
    ("debt_to_income_ratio", "DECIMAL(5,4)"), ("credit_utilization_ratio", "DECIMAL(5,4)"),
    ("payment_reliability_score", "DECIMAL(5,2)"), ("savings_balance", "DECIMAL(12,2)"),
    ("checking_balance", "DECIMAL(12,2)"), ("total_debt", "DECIMAL(12,2)"), ("number_of_accounts", "INT"),
    ("recent_inquiries", "INT"), ("delinquent_accounts", "INT"), ("health_score", "DECIMAL(5,2)"),
    ("risk_category", "STRING"),
)
FINANCIAL_PRODUCTS = _schema(
    ("product_id", "BIGINT"), ("product_name", "STRING"), ("product_type", "STRING"),
    ("product_category", "STRING"), ("interest_rate", "DECIMAL(5,4)"), ("credit_limit_min", "DECIMAL(10,2)"),
    ("credit_limit_max", "DECIMAL(10,2)"), ("minimum_income_required", "DECIMAL(10,2)"),
    ("minimum_credit_score", "INT"), ("maximum_debt_to_income", "DECIMAL(5,4)"), ("annual_fee", "DECIMAL(6,2)"),
    ("rewards_program", "STRING"), ("benefits", "STRING"), ("eligibility_criteria", "STRING"),
    ("is_active", "BOOLEAN"),
)
PRODUCT_RECOMMENDATIONS = _schema(
    ("recommendation_id", "BIGINT"), ("member_id", "BIGINT"), ("product_id", "BIGINT"),
    ("recommendation_date", "DATE"), ("recommendation_score", "DECIMAL(5,2)"),
    ("member_health_score", "DECIMAL(5,2)"), ("credit_utilization_at_time", "DECIMAL(5,4)"),
    ("payment_reliability_at_time", "DECIMAL(5,2)"), ("recommendation_status", "STRING"), ("expires_at", "DATE"),
)

SOURCE_SCHEMAS = {
    "members": MEMBERS,
    "credit_cards": CREDIT_CARDS,
    "payment_history": PAYMENT_HISTORY,
    "financial_health_metrics": FINANCIAL_HEALTH_METRICS,
    "financial_products": FINANCIAL_PRODUCTS,
    "product_recommendations": PRODUCT_RECOMMENDATIONS,
}

# Document rows: one per customer, recommendations nested in rank order.
RECOMMENDATION_DOCUMENT = (
    "customer_id STRING, customer_profile STRUCT<name:STRING, annual_income:DOUBLE, credit_score:INT, health_score:DOUBLE, "
    "risk_category:STRING, utilization_ratio:DOUBLE>, recommendations ARRAY<STRUCT<rank:INT, product_name:STRING, "
    "product_type:STRING, score:DOUBLE, max_score:DOUBLE, confidence:DOUBLE, reason:STRING>>, created_at TIMESTAMP, "
    "updated_at TIMESTAMP, algorithm_type STRING, data_source STRING"
)

# Allowed values of the enumerated columns.
ENUM_DOMAINS = {
    ("members", "employment_status"): ["employed", "self_employed", "unemployed", "retired"],
    ("members", "member_status"): ["active", "inactive", "suspended"],
    ("credit_cards", "card_type"): ["visa", "mastercard", "amex", "discover"],
    ("credit_cards", "card_status"): ["active", "blocked", "expired", "closed"],
    ("payment_history", "payment_status"): ["on_time", "late", "missed", "partial"],
    ("payment_history", "payment_method"): ["auto_pay", "online", "phone", "mail", "branch"],
    ("financial_health_metrics", "risk_category"): ["low", "medium", "high"],
    ("financial_products", "product_type"):
        ["credit_card", "personal_loan", "mortgage", "savings_account", "cd", "investment"],
    ("financial_products", "product_category"): ["premium", "standard", "basic", "secured"],
    ("product_recommendations", "recommendation_status"): ["pending", "accepted", "declined", "expired"],
}

# Foreign keys: (child table, child column, parent table, parent column).
SOURCE_FOREIGN_KEYS = [
    ("credit_cards", "member_id", "members", "member_id"),
    ("payment_history", "member_id", "members", "member_id"),
    ("payment_history", "card_id", "credit_cards", "card_id"),
    ("financial_health_metrics", "member_id", "members", "member_id"),
    ("product_recommendations", "member_id", "members", "member_id"),
    ("product_recommendations", "product_id", "financial_products", "product_id"),
]
STAR_FOREIGN_KEYS = [
    ("dim_credit_card", "member_key", "dim_member", "member_key"),
    ("fact_payment", "member_key", "dim_member", "member_key"),
    ("fact_payment", "card_key", "dim_credit_card", "card_key"),
    ("fact_payment", "payment_date_key", "dim_date", "date_key"),
    ("fact_payment", "payment_method_key", "dim_payment_method", "payment_method_key"),
    ("fact_financial_health", "member_key", "dim_member", "member_key"),
    ("fact_financial_health", "assessment_date_key", "dim_date", "date_key"),
    ("fact_product_recommendation", "member_key", "dim_member", "member_key"),
    ("fact_product_recommendation", "product_key", "dim_financial_product", "product_key"),
    ("fact_product_recommendation", "recommendation_date_key", "dim_date", "date_key"),
    ("fact_credit_card_balance", "member_key", "dim_member", "member_key"),
    ("fact_credit_card_balance", "card_key", "dim_credit_card", "card_key"),
    ("fact_credit_card_balance", "snapshot_date_key", "dim_date", "date_key"),
]
