"""Stored structures against plain versions: vector index, versions by date, digests, substring index, profiles, pages."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tellerlake.operators import digests, profiles, versions
from tellerlake.operators.page_directory import PagedTable
from tellerlake.operators.substring_index import SubstringIndex
from tellerlake.operators.vector_index import VectorIndex
from tellerlake.session import work_path

DAY = datetime.date(2000, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def vectors(spark, seed, ids):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, [rnd.gauss(i % 5, 1) for _ in range(10)], i % 3) for i in ids], "id long, embedding array<float>, kind int").repartition(3)


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def test_vector_index(spark):
    rows = vectors(spark, 1, range(300))
    index = VectorIndex.build(rows, work_path(spark, "vi"), attributes=["kind"])
    index.upsert(vectors(spark, 2, [3, 4, 900]), attributes=["kind"])
    index.upsert(vectors(spark, 3, [4, 5]), attributes=["kind"])
    index.delete(spark.createDataFrame([(7,), (12345,)], "id long"))
    index.upsert(vectors(spark, 4, []), attributes=["kind"])
    state = {r.id: r for df in (rows, vectors(spark, 2, [3, 4, 900]), vectors(spark, 3, [4, 5])) for r in df.collect()}
    del state[7]
    asked = vectors(spark, 5, range(0, 40, 3))

    def wanted(k, kind=None):
        out = []
        for q in asked.collect():
            near = sorted((int(squared(q.embedding, r.embedding) * 1e9 + 0.5) / 1e9, i) for i, r in state.items() if kind is None or r.kind == kind)[:k]
            out += [(q.id, i, n) for n, (_, i) in enumerate(near, 1)]
        return sorted(out)

    def got(**options):
        return sorted((r.query_id, r.neighbour_id, r["rank"]) for r in index.search(asked, 4, probes=1000, kept=1000, **options).collect())

    assert got() == wanted(4) and got(where=F.col("kind") == 1) == wanted(4, 1)
    options, reached = index.tuned(asked, 5, 0.9)
    assert reached >= 0.9 and options["probes"] <= len(index.model.centres)
    index.compact()
    assert got() == wanted(4) and index.rows().count() == len(state)
    assert "PartitionFilters: [isnotnull(cell" in plan(index.rows([1])) or "PartitionFilters: [cell" in plan(index.rows([1]))


def test_copies_of_a_vector_are_found(spark):
    """Most rows equal: one cell holds them, several tasks rank them."""
    rows = spark.range(500).select("id", F.array(F.lit(1.0), (F.col("id") >= 490).cast("double")).alias("embedding"))
    index = VectorIndex.build(rows, work_path(spark, "vi"), cells=4)
    assert [r.neighbour_id for r in index.search(rows.filter("id = 495"), 3, probes=1).orderBy("rank").collect()] == [490, 491, 492]


def test_versions_of_a_hot_key(spark):
    rnd = random.Random(2)
    held = {(k, DAY + datetime.timedelta(rnd.randint(0, 90))): f"{k}-{i}" for i in range(40) for k in (rnd.choice([1, 1, 1, 2, 3]),)}
    known = spark.createDataFrame([(k, d, v) for (k, d), v in held.items()] + [(None, DAY, "none"), (5, None, "never")], "k long, since date, value string")
    rows = [(i, rnd.choice([1, 1, 1, 1, 2, 3, 4, None]), None if i % 50 == 0 else DAY + datetime.timedelta(rnd.randint(-10, 110))) for i in range(800)] + [(1000, 5, DAY)]
    events = spark.createDataFrame([(*r, "old") for r in rows + rows[:5]], "id long, k long, day date, value string").repartition(4)
    for from_ever in (False, True):
        first = {k: min(d for k2, d in held if k2 == k) for k in (1, 2, 3)}

        def wanted(k, day):
            own = [(d, v) for (k2, d), v in held.items() if k2 == k and day is not None and (d <= day or from_ever and d == first[k])]
            return max(own)[1] if own else None

        out = versions.as_of(events, known, "k", "day", "since", ["value"], from_ever, range_rows=30)
        assert out.columns == ["id", "k", "day", "value"]
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((i, k, d, wanted(k, d))) for i, k, d in rows + rows[:5])
        assert "BroadcastNestedLoopJoin" not in plan(out)


def test_pipeline_gives_late_facts_the_version_of_their_day(spark, small):
    from tellerlake.plans import pipeline as PL
    from tellerlake.plans.warehouse import Warehouse

    folder = work_path(small.spark, "warehouse")
    dims = ["date_dimension", "payment_method", "member", "credit_card"]
    begin = Warehouse(small.src, "1996-01-01", 1990, 2002)
    assert PL.run(small.spark, PL.warehouse_jobs(begin, folder), folder, dims).filter("status <> 'success'").isEmpty()
    again = Warehouse(small.src, "1997-01-01", 1990, 2002)
    assert PL.run(small.spark, PL.warehouse_jobs(again, folder), folder, [*dims[2:], "payment_history", "financial_health"]).filter("status <> 'success'").isEmpty()
    fact = PL.stored_table(small.spark, folder, "fact_payment")
    assert fact.count() == small.wh.fact_payment.count()
    days = F.when(F.col("payment_date") < F.lit("1997-01-01").cast("date"), F.datediff(F.lit("1996-01-01").cast("date"), F.lit("1970-01-01").cast("date")))
    days = days.otherwise(F.datediff(F.lit("1997-01-01").cast("date"), F.lit("1970-01-01").cast("date")))
    assert fact.filter((F.col("member_key") != F.col("member_id") * 100000 + days) | (F.col("card_key") != F.col("card_id") * 100000 + days)).isEmpty()
    assert fact.select((F.col("member_key") % 100000).alias("d")).distinct().count() == 2


@pytest.mark.parametrize("depth", [None, 2, 3])
def test_digests_find_every_change(spark, depth):
    before = spark.createDataFrame([(i, "a" if i % 2 else None, i * 1.5) for i in range(2000)], "id long, name string, x double")
    after = before.filter("id NOT IN (5, 6)").withColumn("name", F.when(F.col("id") == 7, "b").when(F.col("id") == 8, "").otherwise(F.col("name")))
    after = after.unionByName(spark.createDataFrame([(-3, None, None), (None, "n", 1.0)], before.schema))
    loads = digests.Loads(spark, work_path(spark, "digests"), ["id"], depth)
    loads.write(before, 0)
    loads.write(after, 1)
    loads.write(after.repartition(7), 2)
    found = loads.changes(0, 1)
    assert {(r.id, r.change) for r in found.collect()} >= {(5, "deleted"), (6, "deleted"), (7, "changed"), (8, "changed"), (-3, "inserted")}
    assert found.filter("id IS NOT NULL").count() == 5
    assert loads.differing(1, 2) == [] and loads.changes(1, 2).isEmpty()
    if depth:
        assert 0 < len(loads.differing(0, 1)) <= 6 and "folder" in plan(found)
    moved = digests.apply_changes(before, after, found, ["id"])
    assert sorted(map(repr, moved.filter("id IS NOT NULL").collect())) == sorted(map(repr, after.filter("id IS NOT NULL").collect()))


def test_substring_index(spark):
    rnd = random.Random(3)
    texts = ["", None, "a", "ab", "ABC", "abcabc", "x\ny", "100%", "a_b", "\U0001f600\U0001f601z", "Ärger", "naïve", "[a](b)*"]
    texts += ["".join(rnd.choice("abcXY ") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(texts)], "id long, t string, other string")
    index = SubstringIndex.build(rows, work_path(spark, "si"), "id", {"t": F.col("t"), "other": F.col("other")}, block_rows=40)
    for pattern in ["", "a", "AB", "abc", "cab", "xy ", "%", "_", "100%", "\U0001f601", "\U0001f600\U0001f601z", "äRG", "\ny", "(b)*", "aaaaaaaaaaaaa", "abcabca"]:
        wanted = {i for i, t in enumerate(texts) if t is not None and pattern.lower() in t.lower()}
        assert sorted(r.key for r in index.search({"t": pattern}).collect()) == sorted(wanted), pattern
    assert {r.key for r in index.search({"t": "abcabc", "other": "K10"}).collect()} == {i for i, t in enumerate(texts) if "abcabc" in (t or "").lower() or f"k{i}".startswith("k10")}
    assert "PartitionFilters: [isnotnull(bucket" in plan(index.candidates("t", "abc")) or "PartitionFilters: [bucket" in plan(index.candidates("t", "abc"))


def test_substring_index_without_rows(spark):
    none = spark.createDataFrame([], "id long, t string")
    assert SubstringIndex.build(none, work_path(spark, "si"), "id", {"t": F.col("t")}).search({"t": "abc"}).isEmpty()


def test_profiles_merge(spark):
    """Loads profiled apart say what one profile of all rows says, within the stated errors."""
    stored = profiles.Profiles(spark, work_path(spark, "profiles"))
    rows = spark.range(60_000).select("id", (F.col("id") % 9000).alias("few"), F.when(F.col("id") % 10 > 0, F.col("id") * 0.5).alias("part"))
    for load in range(3):
        stored.write("t", load, rows.filter(F.col("id") % 3 == load), ["id", "few", "part"])
    stored.write("t", 2, rows.filter(F.col("id") % 3 == 2), ["id", "few", "part"])  # again
    found = {r.column_name: r for r in stored.merged().collect()}
    for name, exact in (("id", 60_000), ("few", 9000), ("part", 54_000)):
        assert abs(found[name].distinct_count - exact) < 4 * profiles.DISTINCT_ERROR * exact
    assert (found["part"].n, found["part"].nulls, found["id"].low, found["id"].high) == (60_000, 6000, 0.0, 59_999.0)
    for p in (0.01, 0.5, 0.9):
        value = {r.column_name: r.value for r in stored.quantile(p).collect()}["id"]
        assert abs(value / 60_000 - p) <= profiles.RANK_ERROR
    assert {r.column_name for r in stored.suspected_repeats().collect()} == {"few"}


def test_suspected_orphans(spark):
    stored = profiles.Profiles(spark, work_path(spark, "profiles"))
    stored.write("parent", 0, spark.range(0, 50_000), ["id"])
    for name, rows in (("sound", spark.range(100, 45_000)), ("some", spark.range(49_000, 51_000)), ("none", spark.range(0)), ("one", spark.range(-1, 10))):
        stored.write(name, 0, rows, ["id"])
    links = [(n, "id", "parent", "id") for n in ("sound", "some", "none")]
    assert [x[0] for x in stored.suspected_orphans(links)] == ["some"]
    tables = {"parent": spark.range(0, 50_000), "some": spark.range(49_000, 51_000), "sound": spark.range(100, 45_000), "none": spark.range(0)}
    assert {r.constraint_name: r.orphans for r in profiles.orphans(stored, tables, links).collect()} == {"sound.id": 0, "some.id": 1000, "none.id": 0}


def test_pages_read_their_files_only(spark):
    rows = spark.range(0, 3000, 3).select("id", (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias("kind"))
    table = PagedTable.write(rows.repartition(5), work_path(spark, "paged"), "id", ["even", "kind"], file_rows=60)
    data = sorted(map(tuple, rows.collect()))
    for where, keep in ((None, lambda r: True), (("even", True), lambda r: r[1]), (("kind", "c3"), lambda r: r[2] == "c3"), (("kind", "none"), lambda r: False)):
        own = [r for r in data if keep(r)]
        for skip, limit in ((0, 10), (57, 9), (480, 100), (995, 20), (5000, 10)):
            got = table.page(skip, limit, where).collect()
            assert sorted(tuple(r)[:3] for r in got) == own[skip : skip + limit]
            assert all((r.total, r.page_number, r.total_pages) == (len(own), skip // limit + 1, -(-len(own) // limit)) for r in got)
    assert len(table.page(300, 10).inputFiles()) <= 2 and len(table.lookup(300).inputFiles()) == 1
    assert sorted(r.id for r in table.lookup(300, 303, 301, -5).collect()) == [300, 303]
    none = PagedTable.write(rows.filter("false"), work_path(spark, "paged"), "id")
    assert none.page().isEmpty() and none.lookup(1).isEmpty()


def test_bucketed_tables_join_without_a_shuffle(small):
    from tellerlake.registry.stored import card_layout, card_payments

    layout = card_layout(small, 4)
    small.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = card_payments(layout)
    assert out.count() > 0 and "Exchange" not in out._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    layout.release()


def test_rows_of_a_layout_are_written_where_they_lie(small):
    from tellerlake.plans.stored import JoinLayout

    layout = JoinLayout(small.spark, work_path(small.spark, "layout"), "id", 4)
    for name in ("a", "b"):
        layout.write(name, small.spark.range(400).repartition(5).withColumn(name, F.col("id") % 7))
    assert 4 < len(layout.read("a").inputFiles()) <= 20  # a file for each task and bucket
    both = layout.read("a").join(layout.read("b"), "id")
    assert both.count() == 400 and "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    layout.release()


def test_stored_marts_read_few_files(small):
    from tellerlake.plans import filters as P
    from tellerlake.registry.stored import _warehouse

    w = _warehouse(small, ["payment_history", "card_balance"])
    days = w.day("fact_payment", "payment_date_key", 19960101, 19960105)
    assert 0 < days.count() == small.wh.fact_payment.filter("payment_date_key BETWEEN 19960101 AND 19960105").count()
    scan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "key_month" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    lookup = w.table("fact_credit_card_balance").filter("card_id = 6")
    assert "PushedFilters: [IsNotNull(card_id), EqualTo(card_id,6)]" in plan(lookup) and "Join" not in plan(lookup)
    page = P.filtered_page(w.table("fact_payment"), "fact_payment", 5, 7, payment_status="late")
    assert sorted(map(tuple, page.select("payment_key", "total").collect())) == sorted(
        map(tuple, P.filtered_page(small.wh.fact_payment, "fact_payment", 5, 7, payment_status="late").select("payment_key", "total").collect()))


STATEMENTS = [
    # statement, destructive, lineage, expanded, with product_id
    ("-- drop it\nselect 1 from t", False, "Unknown", None, "-- drop it\nselect product_id, 1 from t"),
    ("select 'delete' from bank_dw.t", False, "DW", None, "select product_id, 'delete' from bank_dw.t"),
    ("select created_at, updated from t where x = 'it''s bank_dw.t; drop'", False, "Unknown", None, "select product_id, created_at, updated from t where x = 'it''s bank_dw.t; drop'"),
    ("/* update */ DELETE FROM bank_oltp.t", True, "OLTP", None, None),
    ("select \"drop\", `alter` from a", False, "Unknown", None, "select product_id, \"drop\", `alter` from a"),
    ("x = 'open string drop", False, "Unknown", None, None),
    ("/* open comment drop", False, "Unknown", None, None),
    ("SELECT * FROM a", False, "Unknown", "SELECT {} FROM a", "SELECT product_id, * FROM a"),
    ("select /* all */ *, (select max(x) from b) m from c", False, "Unknown", "SELECT {} from c", "select product_id, /* all */ *, (select max(x) from b) m from c"),
    ("select a * b from c", False, "Unknown", None, "select product_id, a * b from c"),
    ("select '*' from c", False, "Unknown", None, "select product_id, '*' from c"),
    ("insert into bank_dw.t select * from bank_oltp . u", True, "Both", "insert into bank_dw.t SELECT {} from bank_oltp . u", None),
    ("select Product_ID from t", False, "Unknown", None, None),
    ("select 'product_id' from t", False, "Unknown", None, "select product_id, 'product_id' from t"),
    ("select count(*) from bank_dw", False, "Unknown", None, "select product_id, count(*) from bank_dw"),
    ("  Select Distinct a from t", False, "Unknown", None, "  Select Distinct product_id, a from t"),
    ("", False, "Unknown", None, None), ("drop", True, "Unknown", None, None), ("dropped", False, "Unknown", None, None), ("it''''''s " * 3000 + "drop", True, "Unknown", None, None),
]


def test_statements_by_tokens(spark):
    from tellerlake.functions import lexer
    from tellerlake.functions.text import STAR_COLUMNS

    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(STATEMENTS)] + [(-1, None)], "i int, s string")
    s = F.col("s")
    out = df.select("i", s, F.array_join(lexer.tokens(s), "").alias("whole"), lexer.is_destructive(s).alias("d"), lexer.lineage(s).alias("l"),
                    lexer.expand_star(s).alias("e"), lexer.ensure_column(s).alias("p")).collect()
    for r in out:
        if r.i >= 0:
            text, destructive, lineage, expanded, patched = STATEMENTS[r.i]
            assert (r.whole, r.d, r.l) == (text, destructive, lineage), text
            assert r.e == (expanded.format(", ".join(STAR_COLUMNS)) if expanded else text), text
            assert r.p == (patched or text), text
        else:
            assert r.e is None and r.p is None


def test_grid_gives_the_rules_best(small):
    from tellerlake.plans import rules, threshold_grid
    from tellerlake.registry.recommend import rule_features, rule_products

    features, products = rule_features(small).cache(), rule_products(small)
    twice = products.unionByName(products.withColumn("product_id", F.col("product_id") + 100_000).withColumn("minimum_credit_score", F.lit(None).cast("int")))
    for catalogue in (products, twice):
        for n in (1, 5):
            want, got = (sorted(map(repr, f(features, catalogue, n).select("member_id", "rank", "product_id", "score", "eligible", "reasons", "probability").collect()))
                         for f in (rules.recommend, threshold_grid.recommend))
            assert want == got and want
    cells = threshold_grid.with_cells(features, products).select(*threshold_grid.CELL).distinct().count()
    assert cells < features.count()


def test_catalogue_finds_keys_and_links(spark):
    from tellerlake.plans import discovery
    from tellerlake.session import own_session

    own = own_session(spark)
    parents = own.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), F.concat(F.lit("n"), "id").alias("name"))
    sound = own.range(1000).select(F.col("id").alias("c"), (F.col("id") % 300).alias("k"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") % 5)).alias("name"))
    broken = own.range(1000).select((F.col("id") % 301).alias("k"), F.col("id").cast("int").alias("c"))
    none = parents.filter("false").select(F.col("k").alias("z"))
    tables = {"parents": discovery.described(parents, {"k": "the key"}, {"k"}), "sound": sound, "broken": broken, "nothing": none}
    found = {(r.table_name, r.column_name): r for r in discovery.catalogue(own, work_path(own, "profiles"), tables).collect()}
    assert {k for k, r in found.items() if r.is_key} == {("parents", "k"), ("parents", "name"), ("sound", "c"), ("broken", "c")}
    assert {k: r.refers_to for k, r in found.items() if r.refers_to} == {("sound", "k"): "parents.k", ("sound", "name"): "parents.name"}
    assert found["parents", "k"].comment == "the key" and not found["parents", "k"].nullable and found["sound", "name"].nullable and ("nothing", "z") in found


def test_embedded_tables(spark):
    from tellerlake.sources import embedded

    rows = spark.createDataFrame([(i if i % 40 else None, f"it's {i % 7}" if i % 3 else None, i * 0.5, DAY + datetime.timedelta(i), i % 2 == 0) for i in range(500)],
                                 "id long, name string, x double, day date, flag boolean").withColumn("amount", F.col("x").cast("decimal(10,2)"))
    folder = work_path(spark, "embedded")
    embedded.write_embedded(rows.repartition(3), folder, "t", "id")
    back = embedded.scan_embedded(spark, folder, "t", rows.schema, "id", 5)
    assert back.select(F.spark_partition_id()).distinct().count() > 3
    asked = embedded.scan_embedded(spark, folder, "t", rows.schema, "id", 5, [("id", ">", 100), ("id", "<=", 222), ("name", "in", ["it's 1", "it's 2"])])
    assert sorted(map(repr, asked.collect())) == sorted(map(repr, rows.filter("id > 100 AND id <= 222 AND name IN ('it''s 1', 'it''s 2')").collect()))
    with pytest.raises(ValueError):
        embedded.scan_embedded(spark, folder, "t", rows.schema, "id", 5, [("day", "=", "2000-01-01")])
    for test in ("true", "id > 100 AND id <= 222", "name = 'it''s 3' OR id IS NULL", "name IN ('it''s 1', 'nothing')", "id = 7 AND flag", "x < 3 AND day >= DATE '2000-01-03'", "name IS NULL"):
        assert sorted(map(repr, back.filter(test).collect())) == sorted(map(repr, rows.filter(test).collect())), test
    embedded.write_embedded(rows.filter("false"), folder, "empty", "id")
    assert embedded.scan_embedded(spark, folder, "empty", rows.schema, "id").isEmpty()

def test_numbers_of_a_profile(spark):
    """A value counts as a number if its text can be read as one, as before, whatever the column's type."""
    from tellerlake.operators.profiles import number

    texts = ["1", " 1.5 ", "-2e3", "+.5", "5.", "7d", "0x1p3", "0x1.8P-1f", "NaN", "inf", "-Infinity", "+INF", "\t3\n", "1 Main Street", "555-0001", "2001-06-15", "", ".", "e5", "1_0", "\u0661", "nano", "12\n\n", "1e", None]
    rows = spark.createDataFrame([(t, i * 3**30 if t else None) for i, t in enumerate(texts)], "s string, n long").withColumns({
        "m": (F.col("n") / 1000).cast("decimal(30,5)"), "x": F.col("n") / 7, "f": (F.col("n") / 7).cast("float"), "d": F.lit(DAY).cast("date"), "t": F.current_timestamp(),
        "b": F.col("n") > 5, "i": (F.col("n") % 1000).cast("int")})
    for name in rows.columns:
        before = F.expr(f"try_cast(try_cast(`{name}` AS STRING) AS DOUBLE)")
        assert rows.select(name, number(name, rows.schema[name].dataType).alias("now"), before.alias("then")).filter("NOT now <=> then").collect() == [], name
    assert "rlike" in number("s", rows.schema["s"].dataType)._jc.toString().lower()


def test_files_of_embedded_tables_follow_the_size(spark, monkeypatch):
    import glob
    import os

    from conftest import SMALL
    from tellerlake.registry import Context, stored

    folders = []
    monkeypatch.setattr(stored, "work_path", lambda *a: folders.append(work_path(*a)) or folders[-1])
    own = Context(spark, SMALL)  # its options end with it
    for size in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize"):
        own.spark.conf.set(f"spark.sql.adaptive.{size}", "4k")
    rows = stored._embedded(own, "payment_history", "payment_id")
    assert rows.count() == own.src.payment_history.count()
    assert len(glob.glob(os.path.join(folders[0], "payment_history", "*.db"))) > 4


def test_a_directory_has_a_bounded_number_of_files(spark, monkeypatch):
    from tellerlake.operators import page_directory

    monkeypatch.setattr(page_directory, "MAX_FILES", 7)
    table = page_directory.PagedTable.write(spark.range(1000), work_path(spark, "paged"), "id", file_rows=10)
    assert table._directory().count() <= 7
    assert [r.id for r in table.page(500, 20).collect()] == list(range(500, 520))
    assert sorted(r.id for r in table.lookup(3, 997).collect()) == [3, 997]


def test_exact_answers_of_a_search_are_found_once(spark, monkeypatch):
    """The rounds of ``tuned`` share one table of answers, and distances are those of the whole vectors."""
    import numpy as np

    from tellerlake.operators import vector_index

    calls = []
    monkeypatch.setattr(vector_index.session, "kept", lambda df, label: calls.append(label) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 9))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<double>")
    index = vector_index.VectorIndex.build(rows, work_path(spark, "vi"), cells=12)
    asked = rows.filter("id % 20 = 0")
    options, reached = index.tuned(asked, 5, 0.99)
    assert calls == ["truth"] and reached >= 0.99 and options["probes"] > 4
    found = index.search(asked, 5, probes=12, kept=300).collect()
    for r in found:
        assert abs(r.distance - ((data[r.query_id] - data[r.neighbour_id]) ** 2).sum()) < 1e-8
    want = {(q, int(n)) for q in range(0, 300, 20) for n in ((data - data[q]) ** 2).sum(1).argsort()[:5]}
    assert {(r.query_id, r.neighbour_id) for r in found} == want


def test_a_search_gives_on_the_best_rows_only(spark, monkeypatch):
    """What leaves the ranking of codes are the rows kept for a query, not those of every cell that it visits."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from tellerlake.operators import vector_index

    ranked, apply = [], PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda *args: ranked.append(apply(*args)) or ranked[-1])
    rows = vectors(spark, 8, range(400))
    index = VectorIndex.build(rows, work_path(spark, "vi"), cells=10)
    asked = rows.filter("id % 20 = 0")
    whole = sorted(map(tuple, index.search(asked, 5, probes=10, kept=12).collect()))
    assert ranked[0].count() == 20 * 12
    for name, value in (("QUERY_BLOCK", 3), ("CHUNK_ROWS", 90), ("BLOCK_ROWS", 7)):  # several blocks, chunks and cuts
        if hasattr(vector_index, name):
            monkeypatch.setattr(vector_index, name, value)
        assert sorted(map(tuple, index.search(asked, 5, probes=10, kept=12).collect())) == whole


def test_rounds_that_cannot_reach_the_recall_are_not_searched(spark, monkeypatch):
    """The first number of probes that is searched is the first whose cells hold enough of the answers."""
    rows = vectors(spark, 8, range(400))
    index, searched, search = VectorIndex.build(rows, work_path(spark, "vi"), cells=40), [], VectorIndex.search
    asked = rows.filter("id % 20 = 0")

    def tried(self, *args, **options):
        searched.append({n: options[n] for n in ("probes", "kept")})
        return search(self, *args, **options)

    monkeypatch.setattr(VectorIndex, "search", tried)
    options, reached = index.tuned(asked, 10, 0.95)
    assert reached >= 0.95 and options["probes"] > 4 and options["kept"] / 100 == 2 ** len([p for p in (4, 8, 16, 32) if p < options["probes"]])
    assert searched[-1] == options and len(searched) <= 2 and searched[0]["probes"] > 4
