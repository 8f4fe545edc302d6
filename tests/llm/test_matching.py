"""Joins and searches on word runs, and the url cascade, against plain versions in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from documents import nasty, nothing  # noqa: F401
from tellerlake.llm import decontamination, graph, jaccard_join, substrings, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def gram_set(text):
    own = words(text, True)
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def plain_components(rows):
    sets = [gram_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def found_components(df):
    return Counter(tuple(r) for r in jaccard_join.linked_components(df).select("doc_id", "n_shingles", "component_id").collect())


def test_jaccard_components(nasty):
    assert found_components(nasty) == plain_components([(r.doc_id, r.text) for r in nasty.collect()])
    left = jaccard_join.one_of_each(nasty)
    assert left.columns == nasty.columns
    wanted = {c for _, _, c in plain_components([(r.doc_id, r.text) for r in nasty.collect()])}
    assert {r.doc_id for r in left.collect()} - {None} == wanted - {None}


def test_one_row_of_each_component_stays(spark, tmp_path):
    """Ids that stand for several texts, rows that are repeated, and rows without an id."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (8, c, "x"), (8, c, "x"), (8, c, "y"), (None, d, "x"), (None, d, "x"), (None, d, None),
            (None, e, "x"), (9, e, "x"), (None, a, "x"), (5, None, "x"), (5, None, "x"), (None, "", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    left = jaccard_join.one_of_each(spark.read.parquet(str(tmp_path / "d")))
    assert left.columns == ["doc_id", "text", "source"]
    wanted = [(3, a), (7, b), (8, c), (None, d), (9, e), (5, None), (5, None), (None, "")]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(wanted)


def test_jaccard_components_of_a_large_group_in_small_blocks(spark, tmp_path, monkeypatch):
    """Chains and stars of near copies that are cut into many blocks, among texts that share one long passage."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", 16)
    rnd = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(50)]
    rows, chain = [], base[:]
    for i in range(40):
        if i % 2:
            chain = chain[:]
            chain[rnd.randrange(120)] = f"c{i}"
            own = chain
        else:
            own = base[:]
            for _ in range(rnd.randint(1, 4)):
                own[rnd.randrange(120)] = f"e{i}{rnd.random()}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000 + i, " ".join([f"u{i}{j}" for j in range(rnd.randint(3, 40))] + passage)) for i in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    assert found_components(spark.read.parquet(str(tmp_path / "d"))) == plain_components(rows)


def plain_links(rows):
    """(Links between different sets, links of each row) by comparing all pairs."""
    sets = [gram_set(t) for _, t in rows]
    between, own = set(), Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                own[i] += 1
                own[j] += 1
                if a != sets[j]:
                    between.add(frozenset((a, sets[j])))
    return between, Counter((doc, len(sets[i]), own[i]) for i, (doc, _) in enumerate(rows))


def found_links(df):
    return Counter(tuple(r) for r in jaccard_join.link_counts(df).select("doc_id", "n_shingles", "n_links").collect())


def test_all_links_of_the_join(nasty, nothing):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    between, own = plain_links(rows)
    assert found_links(nasty) == own
    members, links = jaccard_join.join_links(nasty)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert len(pairs) == len(set(pairs)) == len(between) > 2 and all(a < b for a, b in pairs)
    of_node = defaultdict(set)
    for r in members.collect():
        of_node[r.node].add(r.n_shingles)
    assert all(len(v) == 1 for v in of_node.values()) and jaccard_join.link_counts(nothing).count() == 0


def test_all_links_in_small_blocks(spark, tmp_path, monkeypatch):
    """Groups of near copies that are cut into many blocks and meet in many cells: each link once."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 3)
    rnd, rows = random.Random(21), []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(160)]
        for i in range(12):
            own = base[:]
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(160)] = f"x{rnd.random()}"
            own += [f"tail{group}{i}{j}" for j in range(rnd.randrange(14))]
            rows += [(len(rows), " ".join(own))] * rnd.choice([1, 1, 2])
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    between, own = plain_links(rows)
    members, links = jaccard_join.join_links(df)
    assert links.count() == links.distinct().count() == len(between) > 50
    assert found_links(df) == own


@pytest.mark.parametrize("dense_from", [0, 1, 64, 10**9])
def test_products_by_lists_and_by_blocks(monkeypatch, dense_from):
    """Light and dense columns, few or many, give the same overlaps wherever a pair can reach what it needs."""
    monkeypatch.setattr(jaccard_join, "DENSE_FROM", dense_from)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", 8)
    monkeypatch.setattr(jaccard_join, "SLICE", 5)
    rnd = np.random.default_rng(dense_from % 1000)
    sets = [np.unique(np.concatenate((rnd.choice(40, rnd.integers(0, 30)), 100 + rnd.choice(3000, rnd.integers(0, 20))))).astype(np.uint64) for _ in range(50)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]])
    for least in (1, 10, 25):
        found = jaccard_join.products(sets[:20], sets[20:], np.full(exact.shape, least))
        assert np.array_equal(found >= least, exact >= least) and np.array_equal(found[exact >= least], exact[exact >= least])


def test_words_of_slices():
    """Lower-casing a slice of an array must not touch its neighbours."""
    import pyarrow as pa

    from tellerlake.llm.common import split_words

    texts = ["\u00c9A b\u00e9 " * (i % 7) + f" Word{i}" for i in range(900)] + [None, " X "]
    whole = pa.array(texts).slice(250, 652)
    bounds, codes, found = split_words(whole, lower=True)
    for i, text in enumerate(whole.to_pylist()):
        assert [found[c] for c in codes[bounds[i] : bounds[i + 1]]] == words(text, True)


def test_overlaps_equal_plain_counts():
    rnd = np.random.default_rng(3)
    sets = [np.sort(rnd.choice(60, size=n, replace=False)).astype(np.uint64) for n in rnd.integers(1, 50, 30)]
    n = np.array([len(s) for s in sets])
    found = jaccard_join.overlaps(sets[:12], sets[12:], n[:12], n[12:], 30)
    for i, a in enumerate(sets[:12]):
        for j, b in enumerate(sets[12:]):
            common = len(np.intersect1d(a, b))
            assert found[i, j] == (100 * common >= 30 * (len(a) + len(b) - common))


def test_components_of_a_long_chain(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(41)) and got["x"] == got["y"] == "x"


def test_repeated_windows(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    for k, m in ((35, 8), (6, 2)):
        seen = Counter()
        for _, text in rows:
            own = words(text)
            seen.update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
        wanted = Counter()
        for doc, text in rows:
            own = words(text)
            gone = {j for i in range(len(own) - k + 1) if seen[tuple(own[i : i + k])] > 1 for j in range(i, i + k)}
            wanted[doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)] += 1
        out = substrings.remove_repeats(nasty, ["doc_id", "kept", "n_words"], k=k, m=m)
        found = Counter(map(tuple, out.collect()))
        assert found == wanted


def test_windows_across_many_groups(nasty, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 3000)
    many = Counter((r.doc_id, r.n_removed, r.kept) for r in substrings.remove_repeats(nasty, ["doc_id"]).collect())
    monkeypatch.setattr(substrings, "GROUP_BYTES", 1 << 30)
    assert many == Counter((r.doc_id, r.n_removed, r.kept) for r in substrings.remove_repeats(nasty, ["doc_id"]).collect())


def test_a_line_of_many_texts_does_not_fill_one_bucket(spark, monkeypatch):
    """A line and a passage among words of each text's own: the strings of any one key stay under the bound."""
    import pyarrow as pa

    rnd = random.Random(9)
    own = lambda n: " ".join(f"o{rnd.random()}" for _ in range(n))
    line, passage = " ".join(f"l{i}" for i in range(8)), " ".join(f"p{i}" for i in range(50))
    texts = [f"{own(40)} {passage if i % 3 == 0 else line} {own(40)}" for i in range(600)]
    monkeypatch.setattr(substrings, "GROUP_BYTES", 40_000)
    monkeypatch.setattr(substrings, "COMMON_WORDS", 62 * 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)

    def load(common):
        held = substrings.Texts(pa.chunked_array([texts]))
        first, windows, _, key, _ = substrings.super_kmers(held, 35, 8, common)
        strings = {(int(c), held.slice(f, f + w + 34)) for f, w, c in zip(first.tolist(), windows.tolist(), key.tolist())}
        out = Counter()
        for c, s in strings:
            out[c] += len(s.split())
        return max(out.values())

    assert load(np.zeros(0, np.uint64)) > 5 * substrings.COMMON_WORDS
    assert load(substrings.common_minimisers(docs, "text", sum(map(len, texts)), 35, 8)) <= substrings.COMMON_WORDS
    found = {r.doc_id: (r.n_removed, r.kept) for r in substrings.remove_repeats(docs, ["doc_id"]).collect()}
    assert found == {i: (0, t) if i % 3 else (50, t.replace(passage + " ", "")) for i, t in enumerate(texts)}


def test_windows_do_not_depend_on_common_minimisers(nasty, monkeypatch):
    for k, m in ((35, 8), (6, 2)):
        monkeypatch.setattr(substrings, "COMMON_WORDS", 2 << 20)
        plain = Counter(map(tuple, substrings.remove_repeats(nasty, ["doc_id"], k=k, m=m).collect()))
        monkeypatch.setattr(substrings, "COMMON_WORDS", 1)
        assert Counter(map(tuple, substrings.remove_repeats(nasty, ["doc_id"], k=k, m=m).collect())) == plain


@pytest.fixture(scope="module")
def items(spark, nasty):
    texts = [r.text for r in nasty.collect() if r.text and len(words(r.text)) > 70]
    rows = [(i, " ".join(words(t)[5:5 + n]).upper() if i % 2 else " ".join(words(t)[20:20 + n])) for i, (t, n) in enumerate(zip(texts * 3, [6, 12, 30, 50, 9, 64, 5, 40, 20] * 3))]
    rows += [(100, None), (101, ""), (102, "one two"), (104, "ONE two Three"), (105, "two one"), (106, "X"), (107, "x y x y"), (108, "\u6f22\u5b57"), (103, "never seen words in any of these texts at all"), (1, rows[1][1]), (None, rows[3][1])]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_finds_every_item(nasty, items):
    def distinct(text, short=False):
        own = words(text, True)
        return {tuple(own[i : i + n]) for n in ((1, 2, 3, 4, 5) if short else (5,)) for i in range(len(own) - n + 1)}

    # an item of less than five words is one shingle, its whole sequence
    asked = [(r.item_id, distinct(r.text) or {tuple(words(r.text, True))} - {()}) for r in items.collect()]
    assert {len(w) for _, ws in asked for w in ws} == {1, 2, 3, 4, 5}
    wanted = Counter()
    for r in nasty.collect():
        own = distinct(r.text, True)
        for item, wants in asked:
            if wants and 100 * len(wants & own) >= 80 * len(wants):
                wanted[r.doc_id, item, len(wants & own), len(wants)] += 1
    out = decontamination.contaminated(nasty, items, ["doc_id"])
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in out.collect()) == wanted and wanted
    clean = decontamination.without_items(nasty, items)
    assert clean.columns == nasty.columns
    held = {d for d, *_ in wanted}
    assert clean.count() == sum(not any(w and 100 * len(w & distinct(r.text, True)) >= 80 * len(w) for _, w in asked) for r in nasty.collect())
    assert held


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def plain_verdict(url, rules, default="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules(spark, tmp_path):
    rnd = random.Random(1)
    hosts = ["example.net", "EXAMPLE.net", "a.b.example.net", "xexample.net", "net", ".net", "example.com", "m.example.com", "x.org", "org", "", "example.com.", "net.example", "\u00dcx.Org"]
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en', '/de/x', '/fr/1', '?q=/en/', '#/fr/', '/en/a://b.net/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://net/", "a\nb://x.net/\nq", "http://net/en/" + "x" * 20000]
    rows = [(i, u, "clash", None) for i, u in enumerate(urls)] + [(None, "http://a.net/", "clash", None)] * 2
    spark.createDataFrame(rows, "page_id long, url string, host string, rule string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    out = url_filter.judge_urls(pages, RULES, ["page_id", "host", "rule"])
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, out.collect())) == Counter((p, *plain_verdict(u, RULES)) for p, u, *_ in rows)


def test_cascade_is_exact_on_a_long_list(spark):
    keys = [f"host{i}.example/" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys[:400]], "key string")
    cascade = url_filter.build_cascade(listed, spark.createDataFrame([(k,) for k in keys], "key string"))
    assert len(cascade.levels) > 1
    assert cascade.test(keys).tolist() == [i < 400 for i in range(3000)]


def test_empty_tables(spark, nothing, items):
    assert jaccard_join.linked_components(nothing).count() == 0
    assert substrings.remove_repeats(nothing, ["doc_id"]).count() == 0
    assert decontamination.contaminated(nothing, items, ["doc_id"]).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, RULES, ["page_id"]).count() == 0


def test_without_items(nasty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(nasty, none, ["doc_id"]).count() == 0
    assert decontamination.without_items(nasty, none).count() == nasty.count()
