"""Keyed, ordered, pairing and neighbour operators against brute force on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellerlake.functions.dates import day
from tellerlake.functions.numbers import cents
from tellerlake.operators import checks as C
from tellerlake.operators import keyed as K
from tellerlake.operators import neighbours as NB
from tellerlake.operators import ordered as O
from tellerlake.operators.pairing import first_with, pair_with
from tellerlake.plans.rules import best_per_customer, falling, recommend


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_upsert_keeps_latest_of_the_batch(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("b", 2, "p"), ("b", 3, "q"), ("c", 1, "r")], "k string, at int, v string")
    assert rows(K.upsert(old, new, ["k"], [F.desc("at")])) == [("a", 1, "x"), ("b", 3, "q"), ("c", 1, "r")]


def test_patch_and_delete(spark):
    old = spark.createDataFrame([("a", 1, "x", "2001"), ("b", 1, "y", "2001")], "k string, n int, v string, updated_at string")
    changes = spark.createDataFrame([("b", None, "z"), ("c", 5, "w")], "k string, n int, v string")
    assert rows(K.patch(old, changes, ["k"], F.lit("2002"))) == [("a", 1, "x", "2001"), ("b", 1, "z", "2002")]
    assert rows(K.delete_keys(old, changes, ["k"])) == [("a", 1, "x", "2001")]


def test_scd2_double_load(spark):
    members = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id bigint, v string")
    history = K.first_versions(members, "id", "key", day("2001-01-01"), "expiry")
    changed = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "n")], "id bigint, v string")
    for compare, versions in ((["v"], 5), (None, 7)):
        loaded = K.scd2_load(history, changed, "id", "key", day("2001-06-01"), "expiry", compare)
        assert loaded.count() == versions
        assert loaded.filter("is_current").groupBy("id").count().filter("count <> 1").count() == 0
        assert loaded.select("key").distinct().count() == versions
        # The same load again changes nothing.
        again = K.scd2_load(loaded, changed, "id", "key", day("2001-06-01"), "expiry", None)
        assert again.filter("is_current").count() == 4
    closed = K.scd2_load(history, changed, "id", "key", day("2001-06-01"), "expiry", ["v"]).filter("NOT is_current").collect()
    assert [(r.id, r.expiry) for r in closed] == [(2, dt.date(2001, 6, 1))]


def hot_payments(spark):
    """One member holds most rows, over few days, with ids in several blocks."""
    random = np.random.default_rng(1)
    out = []
    for i in range(3000):
        member = 1 if i % 3 else int(random.integers(2, 60))
        out.append((member, dt.date(2001, 1, 1) + dt.timedelta(days=int(random.integers(0, 12))),
                    int(i * 400_000 + random.integers(0, 1000)), float(random.integers(0, 500_00)) / 100))
    return spark.createDataFrame(out, "m bigint, d date, id bigint, a double").withColumn("a", F.col("a").cast("decimal(10,2)")).repartition(7)


@pytest.mark.parametrize("spread", [1, 10**9])
def test_trend_sums_of_a_hot_member(spark, spread):
    """Two thirds of the rows are one member's, half of them on one day, with dense and with sparse ids."""
    df = hot_payments(spark).withColumn("id", F.col("id") * spread if spread > 1 else F.col("id")).withColumn(
        "d", F.when((F.col("m") == 1) & (F.col("id") % 2 == 0), F.lit(dt.date(2001, 1, 5))).otherwise(F.col("d")))
    got = {r.m: r for r in O.trend_sums(df, "m", "d", "id", cents(F.col("a")), range_rows=100).collect()}
    groups = {}
    for r in sorted(df.collect(), key=lambda r: (r.m, r.d, r.id)):
        groups.setdefault(r.m, []).append(r)
    assert set(got) == set(groups)
    for m, part in groups.items():
        c = [int(r.a * 100) for r in part]
        assert (got[m].n, int(got[m].s), int(got[m].sx), int(got[m].ss)) == (
            len(c), sum(c), sum(i * v for i, v in enumerate(c)), sum(v * v for v in c))
        assert (got[m].first_day, got[m].last_day) == (part[0].d, part[-1].d)


def test_previous_day_of_a_hot_member(spark):
    df = hot_payments(spark)
    got = {r.id: r.previous_day for r in O.previous_day(df, "m", "d", "id").collect()}
    last = {}
    for r in sorted(df.collect(), key=lambda r: (r.m, r.d, r.id)):
        assert got[r.id] == last.get(r.m)
        last[r.m] = r.d


def test_number_rows_over_blocks(spark):
    df = hot_payments(spark).select("id")
    got = rows(O.number_rows(df, "id"), "id")
    assert [p for _, p in got] == list(range(1, 3001))


def test_exact_quantiles_with_copies_and_constants(spark):
    random = np.random.default_rng(2)
    values = np.round(random.exponential(100, 2500), 2)
    data = [(float(v), 0.0 if i % 3 else float(i), 7.0, None if i % 5 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(5)
    got = O.exact_quantiles(df, ["a", "b", "c", "d"], [0.25, 0.5, 0.75, 1.0], fetched=20)
    for i, name in enumerate("abcd"):
        column = [r[i] for r in data if r[i] is not None]
        for p, q in got[name].items():
            assert q == pytest.approx(np.quantile(column, p), abs=1e-9)


def test_page(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    got = rows(O.page(df, ["k"], 20, 10))
    assert [r[0] for r in got] == [20, 21, 22, 23, 24] and {r[1:] for r in got} == {(25, 3, 3)}
    assert O.page(df.filter("k > 99"), ["k"]).count() == 0
    with pytest.raises(ValueError):
        O.page(df, ["k"], -1)


@pytest.mark.parametrize("block", [1000, 3])
def test_pairing_is_the_full_product(spark, block):
    left = spark.range(5).withColumnRenamed("id", "m")
    right = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "p bigint, name string")
    got = rows(pair_with(left, right, "p", block))
    assert got == [(m, p, f"p{p}") for m in range(5) for p in range(10)]


@pytest.mark.parametrize("block", [1000, 3])
def test_best_pairs_leave_a_row_alone(spark, block):
    """n pairs of each row and block, and among them the n first of every customer, also of one with several rows."""
    left = spark.createDataFrame([(1, 0), (1, 3), (2, 5), (None, 1), (3, None)], "m int, x int")
    right = spark.createDataFrame([(i, f"p{i % 4}", None if i == 2 else float("nan") if i == 5 else float(i % 3)) for i in range(10)], "p bigint, name string, y double")

    def score(product):
        return product("y") - F.abs(F.col("x") - product("p") % 5)

    def order(product):
        return [*falling(score(product)), product("name"), product("p")]

    def top(pairs):
        by = [F.desc("score"), F.col("name"), F.col("p")]
        return rows(best_per_customer(pairs.withColumn("score", score(F.col)), "m", by, 2).select("m", "rank", "p", "name"))

    for keep in (None, lambda product: product("p") != 5):
        cut = first_with(left, right, "p", order, 2, keep, block)
        every = pair_with(left, right, "p", block)
        assert top(cut) == top(every if keep is None else every.filter("p <> 5"))
        assert cut.count() <= 2 * left.count() * (1 if block > 10 else 4)


def test_best_products_are_cut_before_any_sort(small):
    """The window over a customer's products gets a few rows of each, not all."""
    from tellerlake.registry.recommend import rule_features, rule_products

    plan = recommend(rule_features(small), rule_products(small))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(slice(sort_array(" in plan and "explode(_items" not in plan


def brute(ids, data, queries, k, cosine):
    def unit(m):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    if cosine:
        gaps = 1 - unit(queries) @ unit(data).T
    else:
        gaps = ((queries[:, None, :] - data[None, :, :]) ** 2).sum(2)
    gaps = np.floor(gaps * 1e9 + 0.5) / 1e9
    return [sorted(zip(row, ids))[:k] for row in gaps]


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("cell_rows", [2048, 40])
def test_neighbours_match_brute_force(spark, monkeypatch, cosine, cell_rows):
    """Clusters, a third of copies of one vector, and zero vectors; many small cells and blocks."""
    monkeypatch.setattr(NB, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(NB, "PIVOTS_FROM", 2)
    random = np.random.default_rng(3)
    centres = random.normal(size=(8, 6)) * 5
    data = np.round(centres[random.integers(0, 8, 400)] + random.normal(size=(400, 6)), 3)
    data[:130] = data[0]
    data[200:203] = 0.0
    ids = list(range(1, 401))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, data)], "id bigint, v array<double>").repartition(4)
    got = {}
    for r in NB.nearest(df, 7, id_column="id", vector="v", metric="cosine" if cosine else "l2").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    expected = brute(ids, data, data, 7, cosine)
    for i, best in zip(ids, expected):
        assert [(d, n) for _, d, n in sorted(got[i])] == [(pytest.approx(d, abs=1e-9), n) for d, n in best]


@pytest.mark.parametrize("cosine", [True, False])
def test_large_tables_stream_past_their_queries(spark, monkeypatch, cosine):
    """Blocks of a few queries, parts, values that single precision confounds, and vectors that are not finite."""
    for name, value in {"CELL_ROWS": 30, "PIVOTS_FROM": 2, "BLOCK_BYTES": 2000, "PART_BYTES": 7000, "FOUND_ROWS": 100, "TILE": 16}.items():
        monkeypatch.setattr(NB, name, value)
    random = np.random.default_rng(7)
    data = np.round(random.normal(size=(300, 4)), 3) + (0 if cosine else 3000)
    data[100:120] = data[0] * (1 if cosine else 1 + 1e-9)
    data[150] = 0.0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {}
    for r in NB.nearest(df, 9, id_column="id", vector="v", metric="cosine" if cosine else "l2").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    for i, best in enumerate(brute(range(300), data, data, 9, cosine)):
        assert [d for _, d, _ in sorted(got[i])] == pytest.approx([d for d, _ in best], abs=2e-8)
        assert len({n for _, _, n in got[i]}) == 9
    if not cosine:
        odd = spark.createDataFrame(rows + [(300, [float("nan")] * 4), (301, [float("inf"), 0.0, 0.0, 0.0])], "id bigint, v array<double>")
        again = {}
        for r in NB.nearest(odd, 9, id_column="id", vector="v", metric="l2").collect():
            again.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
        assert {i: sorted(v) for i, v in again.items() if i < 300} == {i: sorted(v) for i, v in got.items()} and len(again) == 302
    asked = spark.createDataFrame([(1000 + i, [float(x) for x in data[i]]) for i in range(0, 300, 50)], "id bigint, v array<double>")
    for r in NB.nearest(df, 9, id_column="id", vector="v", metric="cosine" if cosine else "l2", queries=asked).collect():
        assert (r.rank, r.distance, r.neighbour_id) in got[r.query_id - 1000]


def test_vectors_are_shuffled_once_for_each_block(spark, monkeypatch):
    """No row of a piece is emitted that lies beyond the k-th row of the query's own piece."""
    monkeypatch.setattr(NB, "CELL_ROWS", 50)
    random = np.random.default_rng(8)
    data = random.normal(size=(200, 3))
    packs = [{"reps": np.arange(i, i + 50).tobytes(), "vecs": data[i : i + 50].tobytes(), "radius": 10.0,
              "bounds": (np.floor(np.sort(((data[i : i + 50, None] - data[None, i : i + 50]) ** 2).sum(2), 1)[:, 4] * 1e9 + 0.5) + 1).tobytes()} for i in range(0, 200, 50)]
    block = NB._Block(packs[:1], 5, False)
    for pack in packs:
        block.visit(np.zeros(3), pack)
    assert block.rows < 50 * 5 * 4
    assert len(block.result()) == 250


@pytest.mark.parametrize("cosine", [True, False])
def test_a_leaf_meets_only_the_queries_that_reach_it(monkeypatch, cosine):
    """Most pairs are never multiplied, and those that are give the exact answer."""
    random = np.random.default_rng(11)
    data = random.normal(size=(40, 6))[random.integers(0, 40, 3000)] + random.normal(size=(3000, 6)) / 5
    if cosine:
        data /= np.linalg.norm(data, axis=1, keepdims=True)
    data, k, pairs = data[NB._by_leaves(data)], 5, []
    square = lambda a, b: 1.0 - a @ b.T if cosine else ((a[:, None] - b[None]) ** 2).sum(2)
    packs = [{"reps": np.arange(i, i + 1000).tobytes(), "vecs": data[i : i + 1000].tobytes(), "radius": 10.0,
              "bounds": (NB._steps(np.sort(square(data[i : i + 1000], data[i : i + 1000]), 1)[:, k - 1]) + 1).tobytes()} for i in range(0, 3000, 1000)]
    multiply = NB._Block._multiply
    monkeypatch.setattr(NB._Block, "_multiply", lambda self, queries, rows, *rest: pairs.append(len(queries) * (rows.stop - rows.start)) or multiply(self, queries, rows, *rest))
    block = NB._Block(packs, k, cosine)
    for pack in packs:
        block.visit(data.mean(0), pack)
    assert sum(pairs) < 0.4 * 3000 * 3000
    found, steps = block.result(), NB._steps(square(data, data))
    best = np.argsort(steps, 1, kind="stable")[:, :k]
    assert found["rep"].tolist() == np.repeat(np.arange(3000), k).tolist()
    assert np.abs(found["distance"].to_numpy().reshape(-1, k) - np.take_along_axis(steps, best, 1) / NB.QUANTUM).max() < 3e-9


def test_six_gigabytes_are_sent_a_dozen_times():
    """Large blocks of queries: 27 copies of the vectors before."""
    for k in (10, 15, 50):
        assert sum(NB._grid(5_060_000, 5_060_000, 38 * 8, k)) <= 15


def test_vectors_without_copies_find_no_rows(spark):
    """Only a vector that comes twice is joined to its rows, also under the same id."""
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100, [3.0, 1.0]), (3, [3.0, 1.0]), (101, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").filter("v IS NOT NULL")
    got = NB.nearest(df, 4, id_column="id", vector="v", metric="l2").collect()
    assert len(got) == 31 * 4
    assert sorted((r.rank, r.neighbour_id, r.distance) for r in got if r.query_id == 100) == [(1, 3, 0.0), (2, 3, 0.0), (3, 100, 0.0), (4, 2, 1.0)]


def test_few_copies_of_the_vectors_are_sent():
    """Blocks of queries and parts of the rows: bounded, enough tasks, and far fewer copies than tasks."""
    width = 38 * 8
    for n in (150_000, 900_000, 5_400_000):
        for k in (10, 15, 50):
            blocks, parts = NB._grid(n, n, width, k)
            assert blocks * parts >= NB.SEARCH_TASKS and n * width <= min(blocks * NB.BLOCK_BYTES, parts * NB.PART_BYTES)
            if n < 1_000_000:
                assert (blocks + parts) * width + parts * k * NB.FOUND_BYTES < 0.9 * (NB.SEARCH_TASKS + 1) * width
    assert NB._grid(40_000, 100, width, 10) == (1, 20)  # few queries still make many tasks


def test_approximate_recall(spark):
    random = np.random.default_rng(4)
    centres = random.normal(size=(10, 16)) * 3
    data = centres[random.integers(0, 10, 900)] + random.normal(size=(900, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, v array<double>")
    exact = {(r.query_id, r.neighbour_id) for r in NB.nearest(df, 10, id_column="id", vector="v").collect()}
    near = {(r.query_id, r.neighbour_id) for r in NB.nearest(df, 10, id_column="id", vector="v", probes=8).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_batch_search_paths_agree(spark):
    random = np.random.default_rng(5)
    data, batch = random.normal(size=(200, 8)) + 1000, random.normal(size=(20, 8)) + 1000
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id bigint, e array<double>")
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(batch)], "q bigint, e array<double>")
    small = NB.batch_top_k(df, asked, 5, id_column="vec_id", vector="e", query_id="q")
    large = NB.batch_top_k(df, asked, 5, id_column="vec_id", vector="e", query_id="q", block_rows=3)
    columns = ["query_id", "rank", "neighbour_id", "distance"]
    assert rows(small.select(columns)) == rows(large.select(columns)) and small.count() == 100
    for r in small.collect():
        assert r.distance == pytest.approx(((data[r.neighbour_id] - batch[r.query_id]) ** 2).sum(), abs=1e-8)
    with pytest.raises(ValueError):
        NB.batch_top_k(df, asked, 51, id_column="vec_id", vector="e", query_id="q")


def test_checks(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, "a"), (3, "b"), (3, "b"), (None, "c")], "pid int, s string")
    orphans = C.orphan_counts({"c": child, "p": parent}, [("c", "pid", "p", "id")]).collect()
    assert [tuple(r) for r in orphans] == [("c.pid", 2)]
    assert [tuple(r) for r in C.enum_counts({"c": child}, {("c", "s"): ["a", "b"]}).collect()] == [("c.s", 1)]
    assert [tuple(r) for r in C.repeated_keys(child, "c.pid", ["pid"]).collect()] == [("c.pid", 1, 2)]
    overflow = C.decimal_overflow(parent, {"x": (F.col("id") * 6, 3, 2)}).collect()
    assert [tuple(r) for r in overflow] == [("x", 1)]
