"""Exact Jaccard join on word n-grams: blocked products of the document by n-gram incidence matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, gram_sets, mix, pieces, stored, text_bytes
from .graph import components

N = 5
#: A pair is linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
COLUMN_BYTES = 10 << 20  # text whose n-grams one column block holds
BLOCK_ROWS = 400  # documents of one matrix block
BLOCK_GRAMS = 4096  # n-grams of one dense matrix block
DENSE_FROM = 64  # a column is dense if its pairs are more than one in so many of the block's
SLICE = 1 << 20  # pairs that one step of a product by lists writes down
MESSAGE = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("docs", pa.binary()), ("grams", pa.binary())])
SEEN = np.dtype([("doc", "<u4"), ("n", "<u4"), ("sig", "<u8")])
META = np.dtype([("n", "<u4"), ("sig1", "<u8"), ("sig2", "<u8"), ("sent", "?")])
BACK = np.dtype([("doc", "<u4"), ("n", "<u4")])
GRAM = np.dtype([("hash", "<u8"), ("df", "<u4")])


def set_signatures(bounds: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; equal sets have equal sums."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)))))
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return out[0], out[1]


def sender(buckets: int, n: int):
    """Deals the n-grams of each chunk of documents to column blocks; copies inside a chunk are sent once."""

    def send(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for chunk in chunks(batch, "_j_text"):
                grp = (part << 32) + number
                number += 1
                bounds, grams = gram_sets(chunk["_j_text"], n)
                size = np.diff(bounds)
                sig1, sig2 = set_signatures(bounds, grams)
                meta = np.zeros(len(size), dtype=META)
                meta["n"], meta["sig1"], meta["sig2"] = size, sig1, sig2
                firsts = np.unique(np.stack([sig1, sig2, size.astype(np.uint64)]), axis=1, return_index=True)[1]
                meta["sent"][firsts] = True
                meta["sent"] &= size > 0
                out = {"bucket": [-1 - grp], "grp": [grp], "docs": [meta.tobytes()], "grams": [serialise(chunk["_j_id"])]}
                sent = np.repeat(meta["sent"], size)
                grams, owner = grams[sent], np.repeat(np.arange(len(size)), size)[sent]
                bucket = (mix(grams) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                grams, owner, bucket = grams[order], owner[order], bucket[order]
                cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else [0]
                for a, b in zip(cut[:-1], cut[1:]):
                    docs, counts = np.unique(owner[a:b], return_counts=True)
                    seen = np.zeros(len(docs), dtype=SEEN)
                    seen["doc"], seen["n"], seen["sig"] = docs, counts, sig1[docs]
                    for name, value in zip(MESSAGE.names, (int(bucket[a]), grp, seen.tobytes(), grams[a:b].tobytes())):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=MESSAGE)

    return send


def serialise(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([column], names=["id"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def deserialise(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all()["id"].combine_chunks()


def column_block(key: tuple, rows: pa.Table) -> pa.Table:
    """Counts in how many distinct sets each n-gram of a block is and answers with the ones in two or more.

    Of equal sets only the first (by group and place) is answered, the same one in every block.
    """
    if key[0].as_py() < 0:
        return rows.select(MESSAGE.names).cast(MESSAGE)
    groups = rows["grp"].to_numpy()
    seen = [np.frombuffer(b, SEEN) for b in rows["docs"].to_pylist()]
    grams = np.concatenate([np.frombuffer(b, np.uint64) for b in rows["grams"].to_pylist()])
    where = np.repeat(groups, [len(s) for s in seen])
    seen = np.concatenate(seen)
    order = np.lexsort((seen["doc"], where, seen["sig"]))
    first = np.ones(len(order), dtype=bool)
    first[1:] = seen["sig"][order][1:] != seen["sig"][order][:-1]
    chosen = np.zeros(len(seen), dtype=bool)
    chosen[order[first]] = True
    row = np.repeat(np.arange(len(seen)), seen["n"])
    mine = chosen[row]
    grams, row = grams[mine], row[mine]
    value, place, df = np.unique(grams, return_inverse=True, return_counts=True)
    shared = df[place] > 1
    row, answer = row[shared], np.zeros(int(shared.sum()), dtype=GRAM)
    answer["hash"], answer["df"] = grams[shared], df[place][shared]
    out: dict[str, list] = {name: [] for name in MESSAGE.names}
    by_group = np.argsort(where[row], kind="stable")
    row, answer = row[by_group], answer[by_group]
    at = where[row]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)])) if len(at) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        docs, begin, counts = np.unique(row[a:b], return_index=True, return_counts=True)
        back = np.zeros(len(docs), dtype=BACK)
        back["doc"], back["n"] = seen["doc"][docs], counts
        grouped = answer[a:b][np.argsort(row[a:b], kind="stable")]
        for name, v in zip(MESSAGE.names, (key[0].as_py(), int(at[a]), back.tobytes(), grouped.tobytes())):
            out[name].append(v)
    return pa.table(out, schema=MESSAGE)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Rarest n-grams of a set of ``n`` of which two linked sets must share one: n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def gatherer(schema: pa.Schema, percent: int):
    """Puts a chunk's answers together: every document, and the shared n-grams of those that can have a link.

    N-grams of one set only cannot be shared, so a document with more of them than its prefix is long has no link.
    The rest of the prefix, rarest n-grams first, are the ones by which it is compared with others.
    """

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        meta = ids = None
        docs, grams = [], []
        for bucket, d, g in zip(rows["bucket"].to_pylist(), rows["docs"].to_pylist(), rows["grams"].to_pylist()):
            if bucket < 0:
                meta, ids = np.frombuffer(d, META), deserialise(g)
            else:
                back = np.frombuffer(d, BACK)
                docs.append(np.repeat(back["doc"], back["n"]))
                grams.append(np.frombuffer(g, GRAM))
        own = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
        all_grams = np.concatenate(grams) if grams else np.zeros(0, GRAM)
        order = np.lexsort((all_grams["hash"], all_grams["df"], own))
        own, all_grams = own[order], all_grams[order]
        found = np.bincount(own, minlength=len(meta))
        bounds = np.concatenate(([0], np.cumsum(found)))
        n = meta["n"].astype(np.int64)
        prefix = prefix_length(n, percent) - (n - found)
        sets, prefixes, centre = [], [], []
        for i in range(len(meta)):
            if found[i] and prefix[i] > 0:
                mine = all_grams[bounds[i] : bounds[i + 1]]
                sets.append(np.sort(mine["hash"]).tobytes())
                prefixes.append(mine["hash"][: prefix[i]].view(np.int64))
                centre.append(float(mine["df"].sum()) / float(n[i]))
            else:
                sets.append(None)
                prefixes.append(None)
                centre.append(None)
        node = [f"{a:016x}{b:016x}" for a, b in zip(meta["sig1"].tolist(), meta["sig2"].tolist())]
        return pa.table([ids.cast(schema.field(0).type), pa.array(n), pa.array(node), pa.array(sets, pa.binary()),
                         pa.array(prefixes, pa.list_(pa.int64())), pa.array(centre, pa.float64())], schema=schema)

    return gather


def overlaps(left: list[np.ndarray], right: list[np.ndarray], left_n: np.ndarray, right_n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (row of left, row of right) are linked: a pair needs an overlap of percent (m + n) / (100 + percent)."""
    need = -(-percent * (left_n[:, None] + right_n[None, :]) // (100 + percent))
    return products(left, right, need) >= need


def products(left: list[np.ndarray], right: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Overlaps of the rows of two incidence matrices, right wherever they reach ``need`` and below it elsewhere.

    Columns that few rows hold are multiplied as lists of rows, at the cost of the pairs that share them; the others,
    as in blocks of near copies, in dense column blocks, whose products are added up. A pair is dropped by its sizes
    alone, or as soon as what it has and what is left of the smaller set cannot reach ``need``; the sum ends when no
    pair is left.
    """
    a, b = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(a, b)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])

    def located(values, rows):
        at = np.searchsorted(columns, values)
        hit = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == values) if len(columns) else np.zeros(len(values), bool)
        return at[hit], rows[hit]

    at_a, row_a = located(a, row_a)
    at_b, row_b = located(b, row_b)
    left_over, right_over = np.bincount(row_a, minlength=len(left)), np.bincount(row_b, minlength=len(right))
    total = np.zeros(need.shape, dtype=np.float32)
    if not len(columns) or not (np.minimum(left_over[:, None], right_over[None, :]) >= need).any():
        return total
    count_a, count_b = np.bincount(at_a, minlength=len(columns)), np.bincount(at_b, minlength=len(columns))
    light = DENSE_FROM * count_a * count_b <= need.size
    # Light columns first, so that either kind is a range of columns; the rows of a column stand together.
    place = np.empty(len(columns), np.int64)
    place[np.argsort(~light, kind="stable")] = np.arange(len(columns))
    sides, lights = [], int(light.sum())
    for at, rows, over, height in ((at_a, row_a, left_over, len(left)), (at_b, row_b, right_over, len(right))):
        at = place[at]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], rows[order], over, height))
    if lights:
        total += listed_products(sides, lights, need.shape)
    for start in range(lights, len(columns), BLOCK_GRAMS):
        if not (total + np.minimum(left_over[:, None], right_over[None, :]) >= need).any():
            break
        pair = []
        for at, rows, over, height in sides:
            i, j = np.searchsorted(at, [start, start + BLOCK_GRAMS])
            block = np.zeros((height, min(BLOCK_GRAMS, len(columns) - start)), dtype=np.float32)
            block[rows[i:j], at[i:j] - start] = 1
            over -= np.bincount(rows[i:j], minlength=height)
            pair.append(block)
        total += pair[0] @ pair[1].T
    return total


def listed_products(sides: list[tuple], lights: int, shape: tuple[int, int]) -> np.ndarray:
    """Product of the first ``lights`` columns as lists of rows, in slices of bounded size; takes them off what is left."""
    cut = [int(np.searchsorted(at, lights)) for at, _, _, _ in sides]
    (at_a, row_a), (at_b, row_b) = ((at[:c], rows[:c]) for c, (at, rows, _, _) in zip(cut, sides))
    for rows, (_, _, over, height) in ((row_a, sides[0]), (row_b, sides[1])):
        over -= np.bincount(rows, minlength=height)
    begin = np.searchsorted(at_b, at_a)
    times = np.searchsorted(at_b, at_a, side="right") - begin
    ends = np.cumsum(times)
    total = np.zeros(shape[0] * shape[1], dtype=np.int64)
    i = 0
    while i < len(at_a):
        done = int(ends[i] - times[i])
        j = max(i + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        mine = np.repeat(np.arange(i, j), times[i:j])
        other = np.arange(len(mine)) + done - (ends[mine] - times[mine]) + begin[mine]
        total += np.bincount(row_a[mine] * shape[1] + row_b[other], minlength=len(total))
        i = j
    return total.reshape(shape)


def forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links that connect whatever ``linked`` (rows by columns) connects, at most one for each row and column."""
    height, width = linked.shape
    parent = list(range(height if same else height + width))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = root(i), root(j if same else height + j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def as_sets(rows: pa.Table, name: str = "set") -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in rows[name].to_pylist()]


def inner_links(percent: int):
    """Links inside one block of a cell and to the cell's pivot, and every member's distance to the pivot."""

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        node, sets, n = rows["node"].to_pylist(), as_sets(rows), rows["n"].to_numpy().astype(np.int64)
        found = overlaps(sets, sets, n, n, percent)
        pairs = forest(np.triu(found, 1), same=True)
        pivot = node.index(key[0].as_py())
        common = np.array([len(np.intersect1d(s, sets[pivot], assume_unique=True)) for s in sets])
        distance = 1 - common / (n + n[pivot] - common)
        ends = [*(node[j] for _, j in pairs), *[None] * len(node)]
        return pa.table({"pivot": [key[0].as_py()] * len(ends), "a": [*(node[i] for i, _ in pairs), *node], "b": ends,
                         "distance": [*[None] * len(pairs), *distance.tolist()]},
                        schema=pa.schema([("pivot", pa.string()), ("a", pa.string()), ("b", pa.string()), ("distance", pa.float64())]))

    return link


def cross_links(percent: int):
    """Links between two blocks of a cell, of members that are not connected yet."""

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        node, sets, n = rows["node"].to_pylist(), as_sets(rows), rows["n"].to_numpy().astype(np.int64)
        _, root = np.unique(rows["root"].to_pylist(), return_inverse=True)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        if len(left) and len(right):
            found = overlaps([sets[i] for i in left], [sets[i] for i in right], n[left], n[right], percent)
            found &= root[left][:, None] != root[right][None, :]
            out = [(node[left[i]], node[right[j]]) for i, j in forest(found, same=False)]
        return pa.table({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema=pa.schema([("a", pa.string()), ("b", pa.string())]))

    return link


def reduced_sets(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (name of the set), and for one document of each set that may have links: its shared
    n-grams (set), its prefix of them, and the mean number of sets they are in (centre)."""
    buckets = pieces(text_bytes(docs, text), COLUMN_BYTES)
    fields = "bucket long, grp long, docs binary, grams binary"
    rows = docs.select(F.col(doc_id).alias("_j_id"), F.col(text).alias("_j_text"))
    sent = rows.mapInArrow(sender(buckets, n), fields)
    answered = sent.groupBy("bucket").applyInArrow(column_block, fields)
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema
    schema = StructType([*kind.fields, StructField("n_shingles", LongType())])
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    arrow = to_arrow_schema(StructType.fromDDL(out))  # as declared: the fields of an id may be null
    for name, t in (("node", pa.string()), ("set", pa.binary()), ("prefix", pa.list_(pa.int64())), ("centre", pa.float64())):
        arrow = arrow.append(pa.field(name, t))
    return answered.groupBy("grp").applyInArrow(gatherer(arrow, percent), f"{out}, node string, set binary, prefix array<long>, centre double")


def cells_of(sets: DataFrame) -> DataFrame:
    """(pivot, node): the cells in which a set is; linked sets have one in common."""
    prefix = sets.select("node", "centre", F.explode("prefix").alias("gram"))
    pivots = prefix.groupBy("gram").agg(F.max(F.struct("centre", "node")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return stored(prefix.join(pivots.select("gram", F.col("p.node").alias("pivot")), "gram").select("pivot", "node").distinct(), "jaccard-cells")


def links_between(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the sets as all links do. ``sets``: node, n, set, prefix, centre.

    Two linked sets share an n-gram of both prefixes. Each such n-gram elects the most central of its sets as pivot;
    the sets that name a pivot form its cell, so linked sets meet in a cell. A cell is cut into blocks, and each
    block, with the pivot, is multiplied with itself. Members that are then still unconnected are compared across
    the blocks of their cell (``across``).
    """
    cells = cells_of(sets)
    blocks = cells.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    heads = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("pivot", "block", F.col("pivot").alias("node"))
    dealt = (cells.filter("node <> pivot").join(blocks, "pivot")
             .select("pivot", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node").union(heads))
    data = sets.select("node", "n", "set")
    inner = stored(dealt.join(data, "node").groupBy("pivot", "block").applyInArrow(
        inner_links(percent), "pivot string, a string, b string, distance double"), "jaccard-inner")
    links = inner.filter("b is not null").select("a", "b")
    large = blocks.filter("blocks > 1").select("pivot")
    if large.isEmpty():
        return links
    members = inner.filter("b is null").select("pivot", F.col("a").alias("node"), "distance").distinct().join(large, "pivot")
    return links.union(across(members, data, components(links), percent))


def across(members: DataFrame, data: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between members (pivot, node, distance) of a cell that no link so far connects.

    Members are put in bands of their distance to the pivot and in blocks inside a band; those connected with the
    pivot are kept apart from the others. Two blocks are compared unless both are connected with the pivot, or their
    bands are further apart than a link can span: the Jaccard distance is a metric.
    """
    bands = 20
    reach = bands * (100 - percent) // 100 + 1
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = (rooted.groupBy("pivot").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max(F.when(F.col("node") == F.col("pivot"), F.col("root"))).alias("main"))
             .filter("r <> s").select("pivot", "main"))
    rooted = (rooted.join(open_, "pivot")
              .select("pivot", "node", "root", F.floor(F.col("distance") * bands).cast("int").alias("band"), (F.col("root") == F.col("main")).alias("tied")))
    rooted = stored(rooted, "jaccard-open")
    counts = rooted.groupBy("pivot", "band", "tied").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("of"))
    blocks = counts.select("pivot", "band", "tied", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("part"))
    block = F.concat_ws(":", "band", "tied", "part")
    one = blocks.select("pivot", F.col("band").alias("band1"), F.col("tied").alias("tied1"), block.alias("block1"))
    two = blocks.select("pivot", F.col("band").alias("band2"), F.col("tied").alias("tied2"), block.alias("block2"))
    pairs = one.join(two, "pivot").filter(f"block1 <= block2 and not (tied1 and tied2) and abs(band1 - band2) <= {reach}").select("pivot", "block1", "block2")
    placed = rooted.join(counts, ["pivot", "band", "tied"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("of"))).select("pivot", block.alias("block"), "node", "root")
    sides = [placed.join(pairs.withColumn("block", F.col(name)), ["pivot", "block"]).withColumn("side", F.lit(side)) for side, name in ((0, "block1"), (1, "block2"))]
    dealt = sides[0].union(sides[1]).select("pivot", "block1", "block2", "side", "node", "root")
    return dealt.join(data, "node").groupBy("pivot", "block1", "block2").applyInArrow(cross_links(percent), "a string, b string")


def every_link(percent: int):
    """All links between two blocks of a cell, or inside one, that no earlier cell of both their ends shows."""

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        cell, same = key[0].as_py(), key[1].as_py() == key[2].as_py()
        side, node = rows["side"].to_numpy(), np.array(rows["node"].to_pylist(), dtype=object)
        sets, n = as_sets(rows), rows["n"].to_numpy().astype(np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        ends: list[np.ndarray] = [np.zeros(0, object)] * 2
        if len(left) and len(right):
            found = overlaps([sets[i] for i in left], [sets[i] for i in right], n[left], n[right], percent)
            if same:
                found = np.triu(found, 1)
            if found.any():
                before = [np.array([c for c in cells if c < cell], dtype=np.int64) for cells in rows["cells"].to_pylist()]
                found &= products([before[i] for i in left], [before[i] for i in right], np.ones(found.shape, np.int64)) < 1
            i, j = np.nonzero(found)
            ends = [node[left[i]], node[right[j]]]
        pairs = [(min(a, b), max(a, b)) for a, b in zip(*ends)]
        return pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, schema=pa.schema([("a", pa.string()), ("b", pa.string())]))

    return link


def all_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: every link between two sets, once. ``sets`` as for ``links_between``.

    Each cell is cut into bands of set size, so wide that linked sets are in the same or in neighbouring ones, and
    these into blocks; blocks that may have links are multiplied. A pair that meets in several cells is returned by
    the first of them. The work of a cell of m like-sized sets is m * m, as is, where they are near copies, its result.
    """
    cells = cells_of(sets).select(F.xxhash64("pivot").alias("cell"), "node").distinct()
    held = cells.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    sized = sets.select("node", "n", F.floor(F.log("n") / (float(np.log(100 / percent)) + 1e-9)).alias("band"))
    placed = cells.join(sized.select("node", "band"), "node")
    counts = placed.groupBy("cell", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("of"))
    blocks = counts.select("cell", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("part"))
    name = F.concat_ws(":", "band", "part")
    one = blocks.select("cell", F.col("band").alias("band1"), name.alias("block1"))
    two = blocks.select("cell", F.col("band").alias("band2"), name.alias("block2"))
    pairs = one.join(two, "cell").filter("block1 <= block2 and abs(band1 - band2) <= 1").select("cell", "block1", "block2")
    placed = placed.join(counts, ["cell", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("of"))).select("cell", name.alias("block"), "node")
    first = placed.join(pairs.withColumn("block", F.col("block1")), ["cell", "block"]).withColumn("side", F.lit(0))
    second = placed.join(pairs.filter("block1 < block2").withColumn("block", F.col("block2")), ["cell", "block"]).withColumn("side", F.lit(1))
    dealt = first.union(second).select("cell", "block1", "block2", "side", "node")
    rows = dealt.join(sets.select("node", "n", "set"), "node").join(held, "node")
    return rows.groupBy("cell", "block1", "block2").applyInArrow(every_link(percent), "a string, b string")


def join_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The whole join: (doc_id, n_shingles, node) for each row, and (a, b) for each link between two different sets.

    ``node`` names a set, so rows with equal sets share one, which stands for the links among them. Empty sets, of
    null texts and texts without words, have a node too, but no links.
    """
    table = stored(reduced_sets(docs, doc_id, text, n, percent), "jaccard-sets")
    sets = table.filter("set is not null").select("node", F.col("n_shingles").alias("n"), "set", "prefix", "centre")
    return table.select("doc_id", "n_shingles", "node"), stored(all_links(sets, percent), "jaccard-links")


def link_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, n_links for each row: how many other rows it is linked with.

    Rows with equal sets are linked with each other; an empty set has no links.
    """
    members, links = join_links(docs, doc_id, text, n, percent)
    sizes = members.filter("n_shingles > 0").groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    both = links.union(links.select("b", "a")).toDF("node", "other")
    others = both.join(sizes.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("rows").alias("others"))
    counted = sizes.join(others, "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counted, "node", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def linked_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; component_id is the smallest doc_id reachable by links.

    Sets are the distinct runs of ``n`` words, A-Z lower-cased; a text with fewer words has its whole sequence as
    one run. A null text, or one without words, has an empty set, is linked with nothing and is its own component.
    Rows with equal sets are linked. Repeated ids are separate rows; a null id names a component only if all its ids
    are null. ``docs`` must give the same rows in the same order when it is read again, as a stored table does.
    """
    table = stored(reduced_sets(docs, doc_id, text, n, percent), "jaccard-sets")
    sets = table.filter("set is not null").select("node", F.col("n_shingles").alias("n"), "set", "prefix", "centre")
    roots = components(links_between(sets, percent))
    full = table.filter("n_shingles > 0").select("doc_id", "n_shingles", "node")
    classes = full.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = classes.select("node", "root").join(named, "root").select("node", "component_id")
    empty = table.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.join(of_node, "node").select("doc_id", "n_shingles", "component_id").union(empty)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns: the one with the smallest id, and among those the smallest row hash.

    Any id comes before a null one. Rows are told apart by id and the hash of all columns, so other rows under the id
    are not touched; of rows that are equal throughout one stays. A row without words is its own component and stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*columns, *[c.isNull() for c in columns])
    keyed = docs.withColumn("_j_key", F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), row.alias("row")))
    found = linked_components(keyed, "_j_key", text, n, percent).filter("n_shingles > 0")
    marks = found.groupBy(F.col("doc_id").alias("_j_mark")).agg(
        F.max(~F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("_j_gone"), F.count(F.lit(1)).alias("_j_rows"))
    marks = stored(marks.filter("_j_gone or _j_rows > 1"), "jaccard-marks")
    gone, twins = marks.filter("_j_gone"), marks.filter("not _j_gone")
    same = (F.col("_j_key.row") == F.col("_j_mark.row")) & F.col("_j_key.id").eqNullSafe(F.col("_j_mark.id"))
    left = keyed.join(gone, same, "left_anti")
    if not twins.isEmpty():
        left = left.join(twins, same, "left_anti").union(left.join(twins, same, "left_semi").dropDuplicates(["_j_key"]))
    return left.drop("_j_key")
