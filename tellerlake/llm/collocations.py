"""Phrase collocations from a weighted de Bruijn graph of word triples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, hash_strings, lower_words, mix, pieces, raw, stored, strings, text_bytes

#: Text whose graph a task builds at a time (some 70 bytes of arrays for each of its bytes), and text whose edges share a bucket.
CHUNK, BUCKET_BYTES = 2 << 20, 4 << 20
#: Edges that one node may bring to its bucket; a node that may bring more has its edges dealt singly.
NODE_EDGES = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands in place of the third word: nothing where the piece ends, MARK in the note that a node is dealt singly.
MARK = b"\x0b"
MESSAGE = "lang string, bucket long, single boolean, chunk long, edges binary, numbers binary"
PART = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()),
                  ("a", pa.int64()), ("f", pa.int64()), ("chunk", pa.int64()), ("place", pa.int64())])
EDGE, NODE, WORD, SINGLE = range(4)

_KIND = np.zeros(256, dtype=np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def between(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[begin:end], of places that go upwards and do not overlap."""
    flags = np.zeros(len(data) + 1, np.int8)
    flags[begin] += 1
    flags[end] -= 1
    return strings(data[np.cumsum(flags[:-1], dtype=np.int8).view(bool)], end - begin)


def split_pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary, code, text number and piece number of each word); piece numbers go upwards."""
    kind, words, code, text, at = lower_words(column, _KIND)
    return words, code, text, np.cumsum(kind == 2)[at] + text


def sender(buckets: int, hot: int):
    """The graph of each chunk of texts, as messages to the buckets of its nodes."""

    def messages(batches):
        number = 0
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in chunks(batch, "_c_text", CHUNK):
                yield from graph(part, (TaskContext.get().partitionId() << 32) | number, pack)
                number += 1

    def graph(part: pa.RecordBatch, chunk: int, pack: zstandard.ZstdCompressor):  # a function of its own, so that a chunk's arrays are gone when the next one is read
        out = {name: [] for name in ("lang", "bucket", "single", "chunk", "edges", "numbers")}
        words, code, text, piece = split_pieces(part["_c_text"])
        if not len(code):
            return
        langs = part["_c_lang"].dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
        end = len(words)
        second, third = np.full(len(code), end), np.full(len(code), end)
        second[:-1] = np.where(piece[:-1] == piece[1:], code[1:], end)
        third[:-2] = np.where(piece[:-2] == piece[2:], code[2:], end)
        _, node = np.unique((lang * (end + 1) + code) * (end + 1) + second, return_inverse=True)
        key = node * (end + 1) + third
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        place, times = order[new], np.diff(np.append(new, len(order)))  # the first place of each edge
        lang, first, second, third, node = lang[place], code[place], second[place], third[place], node[place]
        single = np.bincount(node)[node] > hot
        noted = np.flatnonzero(single & np.concatenate(([True], node[1:] != node[:-1])))

        word_hash = np.append(hash_strings(words.to_pylist()), np.uint64(1))
        home = mix(word_hash[first] * np.uint64(0x9E3779B97F4A7C15) + word_hash[second])
        bucket = np.where(single, mix(home + word_hash[third]), home) % np.uint64(buckets)
        bucket = np.concatenate([bucket, home[noted] % np.uint64(buckets)]).astype(np.int64)
        lang, first, second, place = (np.concatenate([x, x[noted]]) for x in (lang, first, second, place))
        third = np.concatenate([third, np.full(len(noted), end + 1)])
        times = np.concatenate([times, np.zeros(len(noted), np.int64)])
        single = np.concatenate([single, np.zeros(len(noted), bool)])

        group = (lang * 2 + single) * buckets + bucket
        order = np.argsort(group, kind="stable")
        last = pa.concat_arrays([words, pa.array([b"", MARK], pa.large_binary())])
        lines = pc.binary_join_element_wise(
            words.take(pa.array(first[order])), last.take(pa.array(second[order])),
            pc.binary_join_element_wise(last, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary())).take(pa.array(third[order])),
            pa.scalar(b" ", pa.large_binary()))
        data, bounds = raw(lines)
        edge = np.concatenate(([0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = order[i:j]
            out["lang"].append(langs.dictionary[int(lang[own[0]])].as_py())
            out["bucket"].append(int(bucket[own[0]]))
            out["single"].append(bool(single[own[0]]))
            out["chunk"].append(chunk)
            out["edges"].append(pack.compress(data[bounds[i] : bounds[j]].tobytes()))
            out["numbers"].append(pack.compress(np.concatenate([times[own], place[own]]).astype(np.uint32).tobytes()))
            if len(out["lang"]) == 256:
                yield pa.RecordBatch.from_pydict(out, schema=_MESSAGE)
                out = {name: [] for name in out}
        if out["lang"]:
            yield pa.RecordBatch.from_pydict(out, schema=_MESSAGE)

    return messages


_MESSAGE = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("single", pa.bool_()), ("chunk", pa.int64()),
                      ("edges", pa.binary()), ("numbers", pa.binary())])


def merger(least: int):
    """Adds up the edges of a bucket and takes the counts of its nodes from their flow."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        rows = rows.sort_by("chunk")
        lines = b"".join(unpack.decompress(b) for b in rows["edges"].to_pylist())
        numbers = [np.frombuffer(unpack.decompress(b), np.uint32).astype(np.int64).reshape(2, -1) for b in rows["numbers"].to_pylist()]
        chunk = np.repeat(rows["chunk"].to_numpy(), [n.shape[1] for n in numbers])
        times, place = np.concatenate(numbers, axis=1)
        data = np.frombuffer(lines, np.uint8)
        coded = strings(data, np.diff(np.concatenate(([0], np.flatnonzero(data == 10) + 1)))).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        a = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(a, code, times)
        at = np.zeros(len(a), np.int64)
        at[code[::-1]] = np.arange(len(code))[::-1]  # the first place, as messages come by chunk
        chunk, place = chunk[at], place[at]

        data, bounds = raw(coded.dictionary)
        blank = np.flatnonzero(data == 32).reshape(-1, 2)
        w1, w2 = between(data, bounds[:-1], blank[:, 0]), between(data, blank[:, 0] + 1, blank[:, 1])
        w3 = between(data, blank[:, 1] + 1, bounds[1:] - 1)
        nodes = between(data, bounds[:-1], blank[:, 1]).dictionary_encode()
        node = nodes.indices.to_numpy(zero_copy_only=False)
        flow, best = np.zeros(len(nodes.dictionary), np.int64), np.zeros(len(nodes.dictionary), np.int64)
        np.add.at(flow, node, a)
        third = np.diff(bounds) - 1 - (blank[:, 1] + 1 - bounds[:-1])  # bytes of the third word
        marks = pc.equal(w3, pa.scalar(MARK, pa.large_binary())).to_numpy(zero_copy_only=False)
        often = (third > 0) & ~marks & (a >= least)
        np.maximum.at(best, node[often], a[often])
        apart = np.full(len(flow), key[2].as_py())
        apart[node[marks]] = True
        words = w1.dictionary_encode()
        from_word = np.zeros(len(words.dictionary), np.int64)
        np.add.at(from_word, words.indices.to_numpy(zero_copy_only=False), a)

        tables = []

        def add(kind: int, own, f=None, third=True):
            own = pa.array(np.flatnonzero(own))
            texts = [x.take(own).cast(pa.large_string()).cast(pa.string()) for x in (w1, w2, w3)]
            if not third:
                texts[2] = pa.nulls(len(own), pa.string())
            count, f = (a, flow[node]) if f is None else f
            tables.append(pa.table([pa.array(np.full(len(own), kind, np.int32)), pa.array([key[0].as_py()] * len(own), pa.string()), *texts,
                                    *[pa.array(x).take(own) for x in (count, f, chunk, place)]], schema=PART))

        add(EDGE, often & ~apart[node])
        add(SINGLE, ~marks & apart[node])
        one = np.zeros(len(node), bool)
        one[np.unique(node, return_index=True)[1]] = True
        second = blank[:, 1] - blank[:, 0] > 1
        add(NODE, one & second & ~apart[node] & (flow[node] >= least), (flow[node], best[node]), third=False)
        n = len(from_word)
        tables.append(pa.table([pa.array(np.full(n, WORD, np.int32)), pa.array([key[0].as_py()] * n, pa.string()),
                                words.dictionary.cast(pa.large_string()).cast(pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
                                pa.array(from_word), *[pa.nulls(n, pa.int64())] * 3], schema=PART))
        return pa.concat_tables(tables)

    return merge


class Graph:
    """Counts of all words and of the pairs and triples that stand ``least`` times or more.

    ``edges``: lang, w1, w2, w3, a, f (count of the pair w1 w2), tail (of the pair w2 w3), chunk, place, joined (the
    triple is followed by the next one of its path every time). ``nodes``: lang, w1, w2, a, best (largest count of an
    edge that begins with it). ``words``: lang, w1, a, of all words.
    """

    def __init__(self, docs: DataFrame, text: str, lang: str, least: int, hot: int | None = None):
        total = text_bytes(docs, text)
        rows = docs.select(F.col(text).cast("string").alias("_c_text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_c_lang"))
        # A partition is a chunk at least, however little text it has.
        self.hot = max(4, NODE_EDGES // max(pieces(total, CHUNK), rows.rdd.getNumPartitions())) if hot is None else hot
        sent = rows.mapInArrow(sender(pieces(total, BUCKET_BYTES), self.hot), MESSAGE)
        fields = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'int' if f.type == pa.int32() else 'long'}" for f in PART)
        parts = stored(sent.groupBy("lang", "bucket", "single").applyInArrow(merger(least), fields), "collocations")

        single = parts.filter(F.col("kind") == SINGLE).groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a"), F.min(F.struct("chunk", "place")).alias("at"))
        often = (F.col("w3") != "") & (F.col("a") >= least)
        own = single.groupBy("lang", "w1", "w2").agg(F.sum("a").alias("f"), F.max(F.when(often, F.col("a"))).alias("best"))
        self.words = parts.filter(F.col("kind") == WORD).groupBy("lang", "w1").agg(F.sum("a").alias("a"))
        self.nodes = (parts.filter(F.col("kind") == NODE).select("lang", "w1", "w2", "a", F.col("f").alias("best"))
                      .unionByName(own.filter((F.col("w2") != "") & (F.col("f") >= least)).select("lang", "w1", "w2", F.col("f").alias("a"), F.coalesce("best", F.lit(0).cast("long")).alias("best"))))
        edges = (parts.filter(F.col("kind") == EDGE).select("lang", "w1", "w2", "w3", "a", "f", "chunk", "place")
                 .unionByName(single.filter(often).join(own, ["lang", "w1", "w2"])
                              .select("lang", "w1", "w2", "w3", "a", "f", "at.chunk", "at.place")))
        self.edges = self.compacted(edges)

    def compacted(self, edges: DataFrame) -> DataFrame:
        """Marks the triples that go on to the next one of an unary path, and gives each its tail.

        A node is inner to a path if all its flow comes by one edge and leaves by one. Then the two edges stand
        next to each other at every place, so also at their first ones, and the count of the node is theirs. So
        paths are runs of first places, and only the tails of other edges are looked up among the nodes.
        """
        def following(name: str) -> Column:
            return F.lead(name).over(Window.partitionBy("chunk").orderBy("place"))  # a chunk is bounded

        joined = ((following("place") == F.col("place") + 1) & (following("lang") == F.col("lang")) & (following("w1") == F.col("w2"))
                  & (following("w2") == F.col("w3")) & (following("a") == F.col("a")) & (following("f") == F.col("a")))
        marked = stored(edges.withColumn("joined", F.coalesce(joined, F.lit(False))), "collocation-edges")
        nodes = self.nodes.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail"))
        return (marked.filter("joined").withColumn("tail", F.col("a"))
                .unionByName(marked.filter("NOT joined").join(nodes, ["lang", "w2", "w3"]).select(*marked.columns, "tail")))

    def paths(self) -> DataFrame:
        """lang, phrase, n_words, a: the maximal unary paths, each as one phrase with its count."""
        order = Window.partitionBy("chunk").orderBy("place")
        begins = ~F.coalesce(F.lag("joined").over(order) & (F.lag("place").over(order) == F.col("place") - 1), F.lit(False))
        runs = self.edges.withColumn("_begin", begins).withColumn("_run", F.sum(F.col("_begin").cast("long")).over(order))
        steps = F.sort_array(F.collect_list(F.struct("place", "w3")))["w3"]
        return (runs.groupBy("chunk", "_run").agg(F.min_by(F.struct("lang", "w1", "w2"), "place").alias("h"), steps.alias("s"), F.min("a").alias("a"))
                .select("h.lang", F.concat_ws(" ", "h.w1", "h.w2", F.concat_ws(" ", "s")).alias("phrase"), (F.size("s") + 2).cast("long").alias("n_words"), "a"))


def scaled_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) of the named columns, exact for counts up to 1e16."""
    a, left, right = (f"CAST({c} AS DECIMAL(16,0))" for c in (a, left, right))
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({a} * {a})) div ({left} * {right})")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000,
                 hot: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and
    tabs. A phrase is a run of words inside a piece that stands ``least`` times or more in its language (null: und).
    Cut after its first k words it has the score floor(1000000 * a * a / (l * r)), with the counts a of the phrase, l and r of its parts; its
    lowest-scoring cut counts, the first of equal ones. A pair inside a triple that stands half as often as the pair
    or more is left out. Null, empty and blank texts have no words; rows count as often as they stand; an empty table
    gives no rows. Other columns of ``docs`` are not read, whatever their names.

    Each task builds the graph of a chunk of texts: nodes are pairs of words, edges triples, with how often they stand
    there; a piece ends in edges without a third word (and a second one), the corrections that make a node's outgoing
    flow its count. Edges meet in the bucket of their first node, which gives the counts of triples and pairs without
    counting pairs; words add up the flow of their nodes. The edges of a node that may bring more than NODE_EDGES of them
    are dealt singly, and added up by a second shuffle (``hot``: its edges in one chunk). Unary paths are compacted (``Graph.compacted``).
    """
    graph = Graph(docs, text, lang, least, hot)
    edges, nodes, words = graph.edges, graph.nodes, stored(graph.words, "collocation-words")
    inner = edges.filter("NOT joined").groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("before"))
    inside = edges.filter("joined").select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))  # nodes inside a path
    pairs = (nodes.filter("100 * best < 50 * a").join(inside, ["lang", "w1", "w2"], "left_anti").join(inner, ["lang", "w1", "w2"], "left")
             .filter("before IS NULL OR 100 * before < 50 * a"))
    nothing = F.lit(None).cast("long")
    phrases = (pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "w1", F.col("w2").alias("last"), nothing.alias("head"), nothing.alias("tail"))
               .unionByName(edges.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "w1", F.col("w3").alias("last"), F.col("f").alias("head"), "tail")))
    often = words.filter(F.col("a") >= least)
    scored = (phrases.join(often.select("lang", "w1", F.col("a").alias("f_first")), ["lang", "w1"])
              .join(often.select("lang", F.col("w1").alias("last"), F.col("a").alias("f_last")), ["lang", "last"])
              .withColumn("tail", F.coalesce("tail", "f_last"))
              .withColumn("s1", scaled_score("a", "f_first", "tail")).withColumn("s2", scaled_score("a", "head", "f_last")))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    best = scored.select(
        "lang", "phrase", "a", F.when(second, F.col("head")).otherwise(F.col("f_first")).alias("l"),
        F.when(second, F.col("f_last")).otherwise(F.col("tail")).alias("r"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # cut to ``top`` in each task before the shuffle
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
