"""Scalar rules at and around their boundaries."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tellerlake.functions import bands as B
from tellerlake.functions import dates as D
from tellerlake.functions import encodings as E
from tellerlake.functions import numbers as N
from tellerlake.functions import text as X


def apply(spark, rule, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def dec(*values):
    return [None if v is None else Decimal(v) for v in values]


CASES = [
    (B.income_bracket, dec(None, "0", "24999.99", "25000", "49999.99", "50000", "99999.99", "100000"), "decimal(12,2)",
     ["Unknown", "Unknown", "Low", "Medium", "Medium", "High", "High", "Premium"]),
    (B.credit_limit_tier, dec(None, "0", "999.99", "1000", "4999.99", "5000", "9999.99", "10000"), "decimal(10,2)",
     ["Unknown", "Unknown", "Low", "Medium", "Medium", "High", "High", "Premium"]),
    (B.apr_category, dec(None, "0", "0.0999", "0.1", "0.1999", "0.2"), "decimal(5,4)",
     ["Unknown", "Unknown", "Low", "Medium", "Medium", "High"]),
    (B.interest_rate_tier, dec(None, "0", "0.0499", "0.05", "0.1499", "0.15"), "decimal(5,4)",
     ["Unknown", "Low", "Low", "Medium", "Medium", "High"]),
    (B.fee_category, dec(None, "0", "0.01", "99.99", "100"), "decimal(6,2)", ["Unknown", "No Fee", "Low Fee", "Low Fee", "High Fee"]),
    (B.has_rewards, [None, "", "  ", "None", "Points"], "string", [False, False, False, True, True]),
    (B.credit_score_tier, [None, 0, 579, 580, 669, 670, 739, 740, 799, 800], "int",
     ["Unknown", "Unknown", "Poor", "Fair", "Fair", "Good", "Good", "Very Good", "Very Good", "Excellent"]),
    (B.utilization_tier, dec(None, "0", "0.0999", "0.1", "0.2999", "0.3", "0.7999", "0.8"), "decimal(5,4)",
     ["Unknown", "Low", "Low", "Medium", "Medium", "High", "High", "Maxed"]),
    (B.risk_category, [59.99, 60.0, 79.99, 80.0], "double", ["high", "medium", "medium", "low"]),
    (B.recommendation_tier, dec(None, "59.99", "60", "80", "80.01"), "decimal(5,2)", ["Unknown", "Low", "Medium", "Medium", "High"]),
    (B.region, [None, "", "ny", "NY", "OH", "TX", "CA", "PR"], "string",
     ["Unknown", "Unknown", "Northeast", "Northeast", "Midwest", "South", "West", "Other"]),
    (B.payment_channel, [None, "", "AUTO_PAY", "phone", "mail", "branch", "pigeon"], "string",
     ["Unknown", "Unknown", "Digital", "Digital", "Physical", "Physical", "Other"]),
    (B.convenience_score, [None, "auto_pay", "Online", "phone", "mail", "branch", "pigeon"], "string", [0, 5, 4, 3, 2, 1, 0]),
    (E.encode_risk, [None, "low", "Medium", "HIGH", "odd"], "string", [0, 1, 2, 3, 0]),
    (E.encode_status, [None, "active", "inactive", "suspended", "odd"], "string", [0, 1, 0, -1, 0]),
    (E.decode_risk, [0, 1, 2, 3, 9], "int", ["unknown", "low", "medium", "high", "unknown"]),
    (N.finite_or_zero, [None, float("nan"), float("inf"), float("-inf"), 1.5], "double", [0.0, 0.0, 0.0, 0.0, 1.5]),
    (lambda x: N.half_up(x, 1), [0.25, 0.35, -0.05, 2.0], "double", [0.3, 0.4, 0.0, 2.0]),
    (X.money, [1234567.5, 0.4, 999.49], "double", ["$1,234,568", "$0", "$999"]),
    (X.percent, [0.351, 0.0, 1.0], "double", ["35.1%", "0.0%", "100.0%"]),
    (D.repair_date, [None, "2023-02-29", "2024-02-29", "2023-2-28", "2023-13-01", "soon", "2023-02-30"], "string",
     [None, dt.date(2023, 2, 28), dt.date(2024, 2, 29), dt.date(2023, 2, 28), None, None, None]),
    (X.clean_statement, ["```sql\nSELECT 1;\n```", "```\nSELECT 1\n```", "SQL select 1 ;", "  select 1;;", "sqlite", ""], "string",
     ["SELECT 1", "SELECT 1", "select 1", "select 1;", "ite", ""]),
    (X.is_destructive, ["select created_at from t", "select 1", "DROP table t"], "string", [True, False, True]),
    (lambda x: X.is_destructive(x, "word"), ["select created_at from t", "select 1", "DROP table t"], "string", [False, False, True]),
    (X.lineage, ["select 1 from BANK_OLTP.a", "select 1 from bank_dw.a", "from bank_dw.a join bank_oltp.b", "select 1"], "string",
     ["OLTP", "DW", "Both", "Unknown"]),
    (X.ensure_column, ["SELECT a FROM t", "select a from (select b from t)", "SELECT product_id FROM t", "with x as (select 1)"], "string",
     ["SELECT product_id, a FROM t", "select product_id, a from (select b from t)", "SELECT product_id FROM t", "with x as (select 1)"]),
]


@pytest.mark.parametrize("rule, values, kind, expected", CASES)
def test_bands(spark, rule, values, kind, expected):
    assert apply(spark, rule, values, kind) == expected


def test_age_and_tenure(spark):
    asof = D.day("2002-01-01")
    births = [None, dt.date(1984, 1, 1), dt.date(1984, 1, 2), dt.date(1976, 1, 1), dt.date(1976, 1, 2), dt.date(1975, 12, 31), dt.date(1936, 1, 1), dt.date(1935, 6, 1)]
    assert apply(spark, lambda c: B.age_group(c, asof), births, "date") == [
        "Unknown", "18-25", "Under 18", "26-35", "18-25", "26-35", "65+", "65+"]
    leap = apply(spark, lambda c: D.whole_years(c, D.day("2001-02-28")), [dt.date(2000, 2, 29)], "date")
    assert leap == [0]
    assert apply(spark, lambda c: D.tenure_years(c, asof), [None, dt.date(2005, 1, 1), dt.date(1999, 1, 1)], "date") == [0, 0, 3]
    assert apply(spark, lambda c: D.months_apart(c, asof), [None, dt.date(2005, 1, 1), dt.date(2001, 11, 30)], "date") == [0, 0, 2]


def test_eligibility_tier(spark):
    rows = [(None, None, None), (599, None, None), (0, 70000, Decimal("0.36")), (700, 60000, Decimal("0.35")), (650, 40000, Decimal("0.4"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, m int, d decimal(5,4)")
    got = [r.t for r in df.select("i", B.eligibility_tier(F.col("s"), F.col("m"), F.col("d")).alias("t")).orderBy("i").collect()]
    # A score of 0 is stated but adds nothing: (0 + 3 + 2) / 3.
    assert got == ["Unknown", "Easy", "Medium", "Strict", "Medium"]


def test_fiscal_year_from_october(spark):
    df = spark.createDataFrame([(dt.date(2001, 9, 30),), (dt.date(2001, 10, 1),)], "d date")
    got = df.select(*[c.alias(n) for n, c in D.fiscal(F.col("d"), 10).items()]).collect()
    assert [tuple(r) for r in got] == [(2000, 4, 12), (2001, 1, 1)]


def test_holidays(spark):
    days = [dt.date(2001, 1, 1), dt.date(2001, 5, 28), dt.date(2001, 5, 21), dt.date(2001, 9, 3), dt.date(2001, 11, 22), dt.date(2001, 11, 29), dt.date(2001, 12, 25)]
    assert apply(spark, D.is_holiday, days, "date") == [True, True, False, True, True, False, True]


def test_star_expansion(spark):
    got = apply(spark, X.expand_star, ["select * from members", "SELECT  a from t", "select *"], "string")
    assert got == ["SELECT member_id AS customer_id, first_name, last_name, email, phone, date_of_birth from members", "SELECT  a from t", "select *"]


def test_wrong_arguments():
    with pytest.raises(ValueError):
        X.is_destructive(F.lit("x"), "letters")
    with pytest.raises(ValueError):
        D.fiscal(F.current_date(), 13)
