"""Stored structures: vector index, versions by date, digests of loads, substring index, profiles and page directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import lexer as LX
from ..functions.text import STAR_COLUMNS
from ..operators import digests as DG
from ..operators import keyed as K
from ..operators import profiles as PR
from ..operators import versions as V
from ..operators.page_directory import PagedTable
from ..operators.substring_index import SubstringIndex
from ..operators.vector_index import VectorIndex
from ..plans import discovery as DI
from ..plans import filters as P
from ..plans import marts as M
from ..plans import pipeline as PL
from ..plans import threshold_grid as TG
from ..plans import warehouse as W
from ..plans.stored import JoinLayout, StoredWarehouse
from ..plans.warehouse import Warehouse
from ..session import kept, work_path
from ..sources import embedded as EM
from ..sources.schemas import SOURCE_SCHEMAS
from .base import ASOF, FIRST_YEAR, LAST_YEAR, Context, query
from .oracle_tables import hu
from .recommend import rule_features, rule_products

# Vector index: every label's rows are indexed with their label, the rows divisible by 50 are the stated queries.
PROBES, RECALL = 8, 0.9


def _index(c: Context) -> VectorIndex:
    return VectorIndex.build(c.raw("embeddings"), work_path(c.spark, "vector-index"), "vec_id", "embedding", ["label"])


def _asked(c: Context):
    return c.raw("embeddings").filter("vec_id % 50 = 0")


_EXACT = hu("list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1]-p[2])*(p[1]-p[2])))", 9)
_NEAREST = f"""SELECT query_id, neighbour_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, {_EXACT} AS distance FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0)) WHERE rank = 1"""


@query("vector_index_nearest", "query_id b, neighbour_id b, distance d", _NEAREST)
def _(c: Context):
    """The indexed row itself, or its copy with the smallest id, at distance 0."""
    return _index(c).search(_asked(c), 1, "vec_id", probes=PROBES, kept=50).drop("rank")


@query("vector_index_recall", "queries b, recall_reached o", "SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def _(c: Context):
    index, asked = _index(c), _asked(c)
    _, reached = index.tuned(asked, 10, RECALL, "vec_id")
    return asked.agg(F.count("*").alias("queries")).withColumn("recall_reached", F.lit(reached >= RECALL))


@query("vector_index_filtered", "queries b, hits b, foreign_hits b, recall_reached o",
       "SELECT count(*) AS queries, 10*count(*) AS hits, 0 AS foreign_hits, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def _(c: Context):
    """The ten nearest rows of the labels from 5 on; how many of the hits have another label."""
    index, asked, wanted = _index(c), _asked(c), F.col("label") >= 5
    options, reached = index.tuned(asked, 10, RECALL, "vec_id", where=wanted)
    hits = index.search(asked, 10, "vec_id", where=wanted, **options)
    labels = c.raw("embeddings").select(F.col("vec_id").alias("neighbour_id"), "label")
    seen = hits.join(labels, "neighbour_id").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("hits"), F.count_if(F.col("label") < 5).alias("foreign_hits"))
    return seen.withColumn("recall_reached", F.lit(reached >= RECALL))


@query("vector_index_upsert", "query_id b, neighbour_id b, distance d",
       "SELECT vec_id AS query_id, vec_id AS neighbour_id, 0.0 AS distance FROM embeddings WHERE label=3")
def _(c: Context):
    """Label 3 is embedded again, label 4 goes; the new vectors find themselves."""
    index, rows = _index(c), c.raw("embeddings")
    again = rows.filter("label = 3").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.upsert(again, "vec_id", attributes=["label"])
    index.delete(rows.filter("label = 4"), "vec_id")
    return index.search(again, 1, "vec_id", probes=PROBES, kept=50).drop("rank")


@query("vector_index_rows", "label b, n b, first d", f"SELECT label, count(*) AS n, {hu('sum(CASE WHEN label=3 THEN -embedding[1] ELSE embedding[1] END)', 4)} AS first "
       "FROM embeddings WHERE label<>4 GROUP BY label")
def _(c: Context):
    """What the index holds after the same changes, in one load again."""
    index, rows = _index(c), c.raw("embeddings")
    index.upsert(rows.filter("label = 3").withColumn("embedding", F.transform("embedding", lambda x: -x)), "vec_id", attributes=["label"])
    index.delete(rows.filter("label = 4"), "vec_id")
    index.compact()
    return index.rows().groupBy("label").agg(F.count("*").alias("n"), F.floor(F.sum(F.element_at("vector", 1)) * 10000 + 0.5).cast("double").alias("first")).withColumn("first", F.col("first") / 10000)


# Versions by date: incomes are loaded three times, cards twice; a payment takes the versions of its day.
_RAISES = [("1994-01-01", "true", 0), ("1995-07-01", "annual_income >= 80000", 1000), ("1997-03-15", "employment_status = 'retired' OR annual_income < 60000", 500)]


def _member_history(c: Context):
    history = None
    rows = c.src.member_ids.select("member_id", "annual_income", "employment_status")
    for date, condition, more in _RAISES:
        rows = rows.withColumn("annual_income", F.expr(f"CAST(CASE WHEN {condition} THEN annual_income + {more} ELSE annual_income END AS DECIMAL(12,2))"))
        history = (K.first_versions(rows, "member_id", "member_key", DT.day(date), "expiry_date") if history is None
                   else K.scd2_load(history, rows, "member_id", "member_key", DT.day(date), "expiry_date", ["annual_income"]))
    return history


def _card_history(c: Context):
    rows = c.src.credit_cards.select("card_id", "card_status", "credit_limit")
    first = K.first_versions(rows, "card_id", "card_key", DT.day("1996-01-01"), "expiry_date")
    higher = rows.withColumn("credit_limit", F.expr("CAST(CASE WHEN card_status = 'active' THEN credit_limit + 500 ELSE credit_limit END AS DECIMAL(10,2))"))
    return K.scd2_load(first, higher, "card_id", "card_key", DT.day("1998-01-01"), "expiry_date", ["credit_limit"])


_INCOMES = """i1 AS (SELECT member_id, annual_income, employment_status FROM members),
i2 AS (SELECT member_id, employment_status, CASE WHEN annual_income >= 80000 THEN annual_income + 1000 ELSE annual_income END AS annual_income, annual_income >= 80000 AS rises FROM i1),
i3 AS (SELECT member_id, employment_status = 'retired' OR annual_income < 60000 AS rises FROM i2),
dates AS (SELECT member_id, DATE '1994-01-01' AS begins FROM i1 UNION ALL SELECT member_id, DATE '1995-07-01' FROM i2 WHERE rises UNION ALL SELECT member_id, DATE '1997-03-15' FROM i3 WHERE rises),
member_versions AS (SELECT *, member_id*100000 + datediff('day', DATE '1970-01-01', begins) AS member_key FROM dates)"""
_CARDS = """card_dates AS (SELECT card_id, DATE '1996-01-01' AS begins FROM credit_cards UNION ALL SELECT card_id, DATE '1998-01-01' FROM credit_cards WHERE card_status = 'active'),
card_versions AS (SELECT *, card_id*100000 + datediff('day', DATE '1970-01-01', begins) AS card_key FROM card_dates)"""


@query("payment_versions", "payment_id b, payment_date s, member_key b, card_key b", f"""SELECT * FROM (WITH {_INCOMES}, {_CARDS}
SELECT p.payment_id, p.payment_date, m.member_key, k.card_key FROM payment_history p
ASOF LEFT JOIN member_versions m ON p.member_id = m.member_id AND p.payment_date >= m.begins ASOF LEFT JOIN card_versions k ON p.card_id = k.card_id AND p.payment_date >= k.begins)""")
def _(c: Context):
    """Both keys of every payment as of its day; null before the first version."""
    payments = c.src.payment_history.select("payment_id", "payment_date", "member_id", "card_id")
    keyed = V.as_of(payments, _member_history(c), "member_id", "payment_date", "effective_date", ["member_key"])
    return V.as_of(keyed, _card_history(c), "card_id", "payment_date", "effective_date", ["card_key"])


@query("health_versions", "metric_id b, member_id b, member_key b", f"""SELECT * FROM (WITH {_INCOMES}
SELECT h.metric_id, h.member_id, m.member_key FROM financial_health_metrics h ASOF JOIN member_versions m ON h.member_id = m.member_id AND h.assessment_date >= m.begins)""")
def _(c: Context):
    metrics = c.src.financial_health_metrics.select("metric_id", "member_id", "assessment_date")
    return V.as_of(metrics, _member_history(c), "member_id", "assessment_date", "effective_date", ["member_key"]).filter("member_key IS NOT NULL")


@query("card_versions_from_ever", "payment_id b, card_key b", f"""SELECT * FROM (WITH {_CARDS}
SELECT p.payment_id, k.card_key FROM payment_history p ASOF JOIN (SELECT * REPLACE (CASE WHEN begins = DATE '1996-01-01' THEN DATE '1900-01-01' ELSE begins END AS begins) FROM card_versions) k
ON p.card_id = k.card_id AND p.payment_date >= k.begins)""")
def _(c: Context):
    """The first version of a card also holds for payments before it."""
    payments = c.src.payment_history.select("payment_id", "payment_date", "card_id")
    return V.as_of(payments, _card_history(c), "card_id", "payment_date", "effective_date", ["card_key"], from_ever=True).filter("card_key IS NOT NULL")


# Digests: the state of payments before some came late, some changed and some went.
def _earlier(c: Context):
    rows = c.src.payment_history
    changed = F.when((F.col("payment_method") == "phone") & (F.col("payment_status") == "late"), F.col("late_fee") + 1).otherwise(F.col("late_fee"))
    stayed = rows.filter("payment_method IS NULL OR payment_method <> 'mail'").withColumn("late_fee", changed.cast(rows.schema["late_fee"].dataType))
    return stayed.unionByName(rows.filter("payment_method = 'branch'").withColumn("payment_id", -F.col("payment_id")))


def _digested(c: Context, before, depth: int | None = None):
    loads = DG.Loads(c.spark, work_path(c.spark, "digests"), ["payment_id"], depth)
    loads.write(before, 0)
    loads.write(c.src.payment_history, 1)
    return loads


@query("digest_changes", "payment_id b, change s", """
SELECT payment_id, 'inserted' AS change FROM payment_history WHERE payment_method='mail' UNION ALL
SELECT payment_id, 'changed' FROM payment_history WHERE payment_method='phone' AND payment_status='late' AND late_fee IS NOT NULL UNION ALL
SELECT -payment_id, 'deleted' FROM payment_history WHERE payment_method='branch'""")
def _(c: Context):
    return _digested(c, _earlier(c)).changes(0, 1)


@query("digest_incremental_load", "payment_id b, payment_method s, payment_status s, late_fee d", "SELECT * FROM payment_history")
def _(c: Context):
    """Late, changed and deleted payments reach a target that was loaded before; others are not touched."""
    before = _earlier(c)
    return DG.apply_changes(before, c.src.payment_history, _digested(c, before).changes(0, 1), ["payment_id"])


@query("digest_late_row", "payment_id b, change s, most_leaves_equal o",
       "SELECT min(payment_id) AS payment_id, 'inserted' AS change, true AS most_leaves_equal FROM payment_history")
def _(c: Context):
    """One row that comes late, with the smallest id of all: a mark of ids would miss it, one leaf of 4,096 shows it."""
    first = c.src.payment_history.agg(F.min("payment_id").alias("payment_id"))
    loads = _digested(c, c.src.payment_history.join(F.broadcast(first), "payment_id", "left_anti"), 3)
    return loads.changes(0, 1).withColumn("most_leaves_equal", F.lit(len(loads.differing(0, 1)) == 1))


# Substring index over the members' names and contacts, and over product names.
def _member_texts(c: Context) -> SubstringIndex:
    fields = {"name": F.concat_ws(" ", "first_name", "last_name"), "email": F.col("email"), "phone": F.col("phone")}
    return SubstringIndex.build(c.src.member_ids, work_path(c.spark, "member-texts"), "member_id", fields)


@query("substring_members", "member_id b", "SELECT member_id FROM members WHERE lower(first_name||' '||last_name) LIKE '%r 00000001%' OR lower(email) LIKE '%member7%' OR phone LIKE '%-00%'")
def _(c: Context):
    return _member_texts(c).search({"name": "R 00000001", "email": "MEMBER7", "phone": "-00"}).withColumnRenamed("key", "member_id")


@query("substring_short_patterns", "member_id b", "SELECT member_id FROM members WHERE lower(first_name||' '||last_name) LIKE '%r %' OR phone LIKE '%9-%' OR lower(email) LIKE '%nobody has this%'")
def _(c: Context):
    """Patterns of two characters, and one that no row has."""
    return _member_texts(c).search({"name": "R ", "phone": "9-", "email": "nobody has this"}).withColumnRenamed("key", "member_id")


@query("substring_documents", "doc_id b", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%licensed under%'")
def _(c: Context):
    """Long texts."""
    index = SubstringIndex.build(c.raw("documents"), work_path(c.spark, "document-texts"), "doc_id", {"text": F.col("text")})
    return index.search({"text": "Licensed Under"}).withColumnRenamed("key", "doc_id")


# Profiles: payments come in a load for each year, the parents in one.
_PROFILED = ["payment_id", "card_id", "payment_amount", "late_fee", "payment_method"]


def _profiles(c: Context) -> PR.Profiles:
    profiles, payments = PR.Profiles(c.spark, work_path(c.spark, "profiles")), c.src.payment_history
    for load, (first, last) in enumerate([(None, 1994), (1995, 1996), (1997, None)]):
        year = F.year("payment_date")
        part = payments.filter((year >= (first or 0)) & (year <= (last or 9999)))
        profiles.write("payment_history", load, part, _PROFILED)
    return profiles


@query("profile_merged", "column_name s, n b, nulls b, low d, high d, distinct_close o, median_close o", " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, count(*) AS n, count(*) - count({name}) AS nulls, {low} AS low, {high} AS high, true AS distinct_close, {median} AS median_close FROM payment_history"
    for name in _PROFILED for low, high, median in [("NULL", "NULL", "NULL") if name == "payment_method" else (f"CAST(min({name}) AS DOUBLE)", f"CAST(max({name}) AS DOUBLE)", "true")]))
def _(c: Context):
    """Sketches of three loads as one profile, held against exact counts: five standard errors, and twice the error of ranks."""
    profiles, rows = _profiles(c), c.src.payment_history
    merged = profiles.merged().select("column_name", "n", "nulls", "low", "high", "distinct_count").join(profiles.quantile(0.5), "column_name", "left")
    medians = {r["column_name"]: r["value"] for r in merged.select("column_name", "value").collect()}  # a row a column
    exact = rows.agg(*[F.count_distinct(n).alias(f"d_{n}") for n in _PROFILED],
                     *[(F.count_if(F.col(n).cast("double") < F.lit(v)) / F.count(n)).alias(f"l_{n}") for n, v in medians.items() if v is not None],
                     *[(F.count_if(F.col(n).cast("double") <= F.lit(v)) / F.count(n)).alias(f"u_{n}") for n, v in medians.items() if v is not None]).first().asDict()
    close, middle = F.lit(None).cast("boolean"), F.lit(None).cast("boolean")
    for n in _PROFILED:
        close = F.when(F.col("column_name") == n, F.abs(F.col("distinct_count") - exact[f"d_{n}"]) <= 5 * PR.DISTINCT_ERROR * exact[f"d_{n}"]).otherwise(close)
        if f"l_{n}" in exact:
            middle = F.when(F.col("column_name") == n, F.lit(exact[f"l_{n}"] <= 0.5 + 2 * PR.RANK_ERROR and exact[f"u_{n}"] >= 0.5 - 2 * PR.RANK_ERROR)).otherwise(middle)
    return merged.withColumn("distinct_close", close).withColumn("median_close", middle)


_LINKS_CHECKED = [("payment_history", "card_id", "credit_cards", "card_id"), ("product_recommendations", "product_id", "financial_products", "product_id"),
                  ("product_recommendations", "member_id", "members", "member_id")]


@query("profile_orphans", "constraint_name s, orphans b", """
SELECT 'payment_history.card_id' AS constraint_name, count(*) FILTER (card_id NOT IN (SELECT card_id FROM credit_cards)) AS orphans FROM payment_history UNION ALL
SELECT 'product_recommendations.product_id', count(*) FILTER (product_id NOT IN (SELECT product_id FROM financial_products WHERE product_category <> 'basic')) FROM product_recommendations UNION ALL
SELECT 'product_recommendations.member_id', count(*) FILTER (member_id NOT IN (SELECT member_id FROM members)) FROM product_recommendations""")
def _(c: Context):
    """The basic products are missing; only this link is counted on its rows."""
    tables = {"payment_history": c.src.payment_history, "credit_cards": c.src.credit_cards, "product_recommendations": c.src.product_recommendations,
              "financial_products": c.src.financial_products.filter("product_category <> 'basic'"), "members": c.src.member_ids}
    profiles = PR.Profiles(c.spark, work_path(c.spark, "profiles"))
    for table, rows in tables.items():
        profiles.write(table, 0, rows, sorted({f for a, f, b, k in _LINKS_CHECKED if a == table} | {k for a, f, b, k in _LINKS_CHECKED if b == table}))
    return PR.orphans(profiles, tables, _LINKS_CHECKED)


@query("profile_repeats", "key_name s, repeated_keys b, rows_affected b", """
SELECT 'payment_history.payment_id' AS key_name, count(*) FILTER (payment_method = 'branch') AS repeated_keys, 2 * count(*) FILTER (payment_method = 'branch') AS rows_affected FROM payment_history
UNION ALL SELECT 'credit_cards.card_id', 0, 0""")
def _(c: Context):
    """Payments at the branch have come twice, in two loads."""
    payments = c.src.payment_history
    again = payments.filter("payment_method = 'branch'")
    profiles = PR.Profiles(c.spark, work_path(c.spark, "profiles"))
    for load, rows in enumerate((payments, again)):
        profiles.write("payment_history", load, rows, ["payment_id"])
    profiles.write("credit_cards", 0, c.src.credit_cards, ["card_id"])
    return PR.repeats(profiles, {"payment_history": payments.unionByName(again), "credit_cards": c.src.credit_cards},
                      [("payment_history", "payment_id"), ("credit_cards", "card_id")])


# Pages and lookups of stored facts.
_PAGE = ", total b, page_number b, total_pages b"


def _paged_sql(table: str, key: str, where: str, skip: int, limit: int) -> str:
    return (f"SELECT *, count(*) OVER () AS total, {skip // limit + 1} AS page_number, CAST(ceil(count(*) OVER () / {limit}.0) AS INT) AS total_pages "
            f"FROM {table} WHERE {where} ORDER BY {key} LIMIT {limit} OFFSET {skip}")


@query("stored_page", "payment_key b, payment_amount d" + _PAGE, _paged_sql("fact_payment", "payment_key", "true", 300, 100))
def _(c: Context):
    return PagedTable.write(c.wh.fact_payment, work_path(c.spark, "paged"), "payment_key", file_rows=5000).page(300, 100)


@query("stored_filtered_page", "payment_key b, member_key b, payment_status s, payment_ratio d" + _PAGE, _paged_sql("fact_payment", "payment_key", "payment_status='late'", 50, 25))
def _(c: Context):
    table = PagedTable.write(c.wh.fact_payment, work_path(c.spark, "paged"), "payment_key", ["payment_status", "is_on_time"], 5000)
    return table.page(50, 25, ("payment_status", "late"))


@query("stored_lookup", "balance_key b, card_key b, member_key b, current_balance d", "SELECT * FROM fact_credit_card_balance WHERE balance_key IN (6000000+200112, 7000000+200112, 1)")
def _(c: Context):
    return PagedTable.write(c.wh.fact_credit_card_balance, work_path(c.spark, "paged"), "balance_key", file_rows=5000).lookup(6000000 + 200112, 7000000 + 200112, 1)


# Marts, pages and lookups over the stored loads; the pipeline writes them once.
def _warehouse(c: Context, jobs: list[str]) -> StoredWarehouse:
    folder = work_path(c.spark, "warehouse")
    failed = PL.run(c.spark, PL.warehouse_jobs(c.wh, folder), folder, ["date_dimension", "payment_method", "member", "credit_card", *jobs]).filter("status <> 'success'")
    if rows := failed.collect():  # a row for each job
        raise RuntimeError(rows[0]["error_message"])
    return StoredWarehouse(c.spark, folder)


@query("stored_member_summary", "member_id b, income_bracket s, total_payments b, avg_payment_amount d", "SELECT m.member_id, m.income_bracket, count(*) AS total_payments, "
       + hu("CAST(sum(p.payment_amount) AS DOUBLE)/count(*)", 6) + " AS avg_payment_amount FROM dim_member m JOIN fact_payment p USING (member_id) GROUP BY ALL")
def _(c: Context):
    w = _warehouse(c, ["payment_history"])
    return M.member_payment_summary(w.table("fact_payment"), w.current("dim_member"))


@query("stored_payments_page", "payment_key b, member_key b, payment_status s, is_on_time o, payment_ratio d" + _PAGE,
       _paged_sql("fact_payment", "payment_key", "payment_status='late' AND NOT is_on_time AND payment_date_key BETWEEN 19960101 AND 19960331", 10, 10))
def _(c: Context):
    """Late payments of a quarter: only its days are read."""
    fact = _warehouse(c, ["payment_history"]).day("fact_payment", "payment_date_key", 19960101, 19960331)
    return P.filtered_page(fact, "fact_payment", 10, 10, payment_status="late", is_on_time=False)


@query("stored_health_page", "health_key b, member_key b, risk_category s, credit_score_tier s" + _PAGE,
       _paged_sql("fact_financial_health", "health_key", "risk_category='high' AND assessment_date_key=20011215", 0, 100))
def _(c: Context):
    fact = _warehouse(c, ["financial_health"]).day("fact_financial_health", "assessment_date_key", 20011215, 20011215)
    return P.filtered_page(fact, "fact_financial_health", risk_category="high")


@query("stored_balance_lookup", "card_key b, card_id b, member_key b, balance_key b, current_balance d", "SELECT * FROM fact_credit_card_balance WHERE card_id=6 AND snapshot_date_key=20011231")
def _(c: Context):
    """A card's balance at a month end, by its natural key: the filter reaches the files."""
    return _warehouse(c, ["card_balance"]).table("fact_credit_card_balance").filter("card_id = 6 AND snapshot_date_key = 20011231")


@query("bucketed_card_payments", "card_id b, card_type s, n b, paid d, snapshots b", """
SELECT k.card_id, k.card_type, p.n, p.paid, b.snapshots FROM dim_credit_card k JOIN (SELECT card_id, count(*) AS n, CAST(sum(payment_amount) AS DOUBLE) AS paid FROM fact_payment GROUP BY 1) p USING (card_id)
JOIN (SELECT card_id, count(*) AS snapshots FROM fact_credit_card_balance GROUP BY 1) b USING (card_id)""")
def _(c: Context):
    """Two facts and a dimension in buckets by card: joined and grouped where they lie."""
    return card_payments(card_layout(c, 8))


def card_layout(c: Context, buckets: int) -> JoinLayout:
    layout = JoinLayout(c.spark, work_path(c.spark, "layout"), "card_id", buckets)
    w = Warehouse(c.src.staged("payment_history"), ASOF, FIRST_YEAR, LAST_YEAR)  # both facts read the payments
    payments = w.src.payment_history
    layout.write("cards", w.dim_credit_card.filter("is_current"))
    layout.write("payments", W.payment_facts(W.payment_keys(payments, w.current_members, w.current_cards, w.dim_date, w.dim_payment_method, stored=payments)))
    layout.write("balances", w.fact_credit_card_balance)
    return layout


def card_payments(layout: JoinLayout):
    paid = layout.read("payments").groupBy("card_id").agg(F.count("*").alias("n"), F.sum("payment_amount").alias("paid"))
    seen = layout.read("balances").groupBy("card_id").agg(F.count("*").alias("snapshots"))
    return layout.read("cards").select("card_id", "card_type").join(paid, "card_id").join(seen, "card_id")


# Statements by tokens: conversation turns inside comments, strings and quoted names around harmless and harmful words.
_KINDS = ["-- {0}\nSELECT * FROM `bank_oltp`.members", "SELECT 'drop ' || x, \"delete\" FROM bank_dw . facts /* {0} */",
          "DELETE FROM bank_oltp.members WHERE note = '{0}' -- bank_dw.x", "SELECT * , product_id FROM (SELECT a FROM b) t WHERE n = '{0}''s bank_oltp.x'",
          "select distinct created_at, update_time from bank_dw.t join \"bank_oltp\".u -- {0}"]


def _wrapped(c: Context):
    said = F.regexp_replace(F.col("text"), r"[\r\n]|\*/", " ")
    out = F.lit(None).cast("string")
    for i, pattern in enumerate(_KINDS):
        head, tail = pattern.split("{0}")
        body = F.replace(said, F.lit("'"), F.lit("''")) if i in (2, 3) else said
        out = F.when(F.col("turn") % len(_KINDS) == i, F.concat(F.lit(head), body, F.lit(tail))).otherwise(out)
    return c.raw("conversations").select("conv_id", "turn", out.alias("statement"))


def _wrapped_sql() -> str:
    def text(part: str) -> str:
        return "'" + part.replace("'", "''") + "'"

    said = r"regexp_replace(text, '[\r\n]|\*/', ' ', 'g')"
    cases = []
    for i, pattern in enumerate(_KINDS):
        head, tail = (text(p).replace("\n", "'||chr(10)||'") for p in pattern.split("{0}"))
        body = f"replace({said}, '''', '''''')" if i in (2, 3) else said
        cases.append(f"WHEN {i} THEN {head}||{body}||{tail}")
    return f"SELECT conv_id, turn, text, CASE turn % {len(_KINDS)} {' '.join(cases)} END AS statement FROM conversations"


@query("token_guard", "conv_id b, turn b, is_destructive o, lineage s",
       f"SELECT conv_id, turn, turn % 5 = 2 AS is_destructive, CASE turn % 5 WHEN 0 THEN 'OLTP' WHEN 1 THEN 'DW' WHEN 2 THEN 'OLTP' WHEN 3 THEN 'Unknown' ELSE 'Both' END AS lineage FROM ({_wrapped_sql()}) WHERE statement IS NOT NULL")
def _(c: Context):
    """Words in strings, comments and quoted names neither warn nor name a schema."""
    statement = F.col("statement")
    return _wrapped(c).filter(statement.isNotNull()).select("conv_id", "turn", LX.is_destructive(statement).alias("is_destructive"), LX.lineage(statement).alias("lineage"))


_STARS = ", ".join(STAR_COLUMNS)


@query("token_rewrites", "conv_id b, turn b, expanded s, patched s", f"""SELECT conv_id, turn,
 CASE turn % 5 WHEN 0 THEN replace(statement, 'SELECT * FROM `bank', 'SELECT {_STARS} FROM `bank') WHEN 3 THEN 'SELECT {_STARS} '||substr(statement, 23) ELSE statement END AS expanded,
 CASE turn % 5 WHEN 0 THEN replace(statement, chr(10)||'SELECT * FROM `bank', chr(10)||'SELECT product_id, * FROM `bank') WHEN 1 THEN 'SELECT product_id,'||substr(statement, 7)
  WHEN 4 THEN 'select distinct product_id,'||substr(statement, 16) ELSE statement END AS patched FROM ({_wrapped_sql()})""")
def _(c: Context):
    return _wrapped(c).select("conv_id", "turn", LX.expand_star(F.col("statement")).alias("expanded"), LX.ensure_column(F.col("statement")).alias("patched"))


@query("grid_recommend", "member_id b, rank b, product_id b, product_name s, product_type s, score d, probability d, eligible o, reasons s",
       f"SELECT * REPLACE ({hu('probability', 3)} AS probability) FROM rule_top")
def _(c: Context):
    """The rule recommendations, scored once a cell of members."""
    return TG.recommend(rule_features(c), rule_products(c))


# The catalogue as the session lists it.
_KEPT = {"members": "member_id", "credit_cards": "card_id", "payment_history": "payment_id", "financial_health_metrics": "metric_id", "financial_products": "product_id",
         "product_recommendations": "recommendation_id"}


def _bank(c: Context):
    return {t: DI.described(kept(c.src.table(t), t), {k: f"key of {t}"}, {k}) for t, k in _KEPT.items()}


def _catalogue_sql() -> str:
    parts = []
    for table, schema in SOURCE_SCHEMAS.items():
        for i, f in enumerate(schema.fields, 1):
            unique = f"(SELECT count({f.name}) = count(*) AND count(DISTINCT {f.name}) = count(*) AND count(*) > 0 FROM {table})"
            targets = [f"CASE WHEN (SELECT count({f.name}) = count(*) AND count(DISTINCT {f.name}) = count(*) AND count(*) > 0 FROM {t}) "
                       f"AND NOT EXISTS (SELECT 1 FROM {table} x WHERE x.{f.name} IS NOT NULL AND x.{f.name} NOT IN (SELECT {f.name} FROM {t})) THEN '{t}.{f.name}' END"
                       for t, s in sorted(SOURCE_SCHEMAS.items()) if t != table and f.name in s.names and s[f.name].dataType == f.dataType]
            refers = f"nullif(array_to_string(list_filter([{', '.join(targets)}], lambda x: x IS NOT NULL), ', '), '')" if targets else "NULL"
            key = _KEPT[table] == f.name
            parts.append(f"SELECT '{table}' AS table_name, {i} AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS column_type, {not key} AS nullable, "
                         f"{repr(f'key of {table}') if key else 'NULL'} AS comment, {unique} AS is_key, {refers} AS refers_to")
    return " UNION ALL ".join(parts)


@query("session_catalogue", "table_name s, position b, column_name s, column_type s, nullable o, comment s, is_key o, refers_to s", _catalogue_sql())
def _(c: Context):
    """Columns, nullability and comments from the session, keys and links from the rows."""
    return DI.catalogue(c.spark, work_path(c.spark, "profiles"), _bank(c))


# Tables in embedded database files.
@query("scan_embedded", "payment_id b, member_id b, payment_date s, payment_amount d, late_fee d, payment_method s, payment_status s", "SELECT * FROM payment_history")
def _(c: Context):
    return _embedded(c, "payment_history", "payment_id")


@query("scan_embedded_filtered", "payment_id b, payment_amount d, payment_method s",
       "SELECT * FROM payment_history WHERE payment_id > 20000 AND payment_method IN ('mail', 'phone') AND payment_status = 'late'")
def _(c: Context):
    """Key range, list and equality are part of the files' queries."""
    return _embedded(c, "payment_history", "payment_id", [("payment_id", ">", 20000), ("payment_method", "in", ["mail", "phone"]), ("payment_status", "=", "late")])


def _embedded(c: Context, table: str, key: str, where: list[tuple[str, str, object]] | None = None):
    folder, rows = work_path(c.spark, "embedded"), c.src.table(table)
    # files of the advisory size: what a task writes does not grow with the table
    EM.write_embedded(rows.hint("rebalance", key), folder, table, key)
    return EM.scan_embedded(c.spark, folder, table, rows.schema, key, where=where)
