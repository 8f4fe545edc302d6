"""The derived source tables hold every row of the tables they come from."""

from pyspark.sql import functions as F


def test_nothing_is_cut(small):
    orders, lines = small.raw("orders"), small.raw("lineitem")
    assert small.src.credit_cards.count() == orders.count()
    assert small.src.payment_history.count() == lines.join(orders, lines.l_orderkey == orders.o_orderkey).count()
    products = small.src.financial_products
    parts = products.agg(F.sum(F.regexp_extract("benefits", r"(\d+)", 1).cast("long"))).first()[0]
    assert parts == small.raw("part").count() and products.count() == small.raw("part").select("p_type", "p_brand").distinct().count()


def test_ids_of_large_keys_are_unique(spark):
    """Order keys above 2^31, two million parts, and lines that repeat their number within an order."""
    from tellerlake.sources import derivation_sql as D

    lines = spark.range(4000).selectExpr(
        "CAST(3000000000 + id % 700 AS BIGINT) AS l_orderkey", "id % 3 AS l_linenumber", "2000000 + id % 1000 AS l_partkey", "id AS l_suppkey",
        "TIMESTAMP '2001-01-01 00:00:00' AS l_shipdate", "0.05D AS l_discount", "10.0D AS l_quantity", "1000.0D AS l_extendedprice")
    orders = spark.range(700).selectExpr("CAST(3000000000 + id AS BIGINT) AS o_orderkey", "id AS o_custkey")
    ids = spark.sql(D.PAYMENT_HISTORY, lineitem=lines, orders=orders).select("payment_id")
    assert ids.count() == ids.distinct().count() == 4000
    parts = spark.range(3000).selectExpr("id AS p_partkey", "concat('Brand#', id % 55 + 1) AS p_brand", "element_at(array('ECONOMY','LARGE','SMALL'), CAST(id % 3 + 1 AS INT)) AS p_type", "id % 50 AS p_size")
    products = spark.sql(D.FINANCIAL_PRODUCTS, part=parts)
    top = products.agg(F.max("product_id"), F.count("*"), F.countDistinct("product_id")).first()
    assert top[0] < 1000 and top[1] == top[2]
