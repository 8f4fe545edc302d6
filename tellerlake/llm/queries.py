"""The registered queries of the operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_repair, collocations, decontamination, hard_negatives, jaccard_join, licences, mixing, quality_embeddings, quality_rules, sharding,
               substrings, token_counts, url_filter)
from .common import table

SHARDS = 24
TOKEN_LIMIT = 4096
PREDICT_AT = 0.7
#: Fixed rules of the url query: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_mixture(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mixture(table(spark, folder, "documents"))
    times = [F.floor(F.try_element_at("positions", F.lit(i)) * 1000000).alias(f"at_{i}") for i in range(1, mixing.MAX_REPEATS + 1)]
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", *times)


def op2_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_embeddings.train(docs, table(spark, folder, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = quality_embeddings.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op3_repaired_chats(spark: SparkSession, folder: str) -> DataFrame:
    return chat_repair.repair(table(spark, folder, "conversations"))


def op4_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, folder, "documents"), SHARDS, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_rules.train(docs, table(spark, folder, "labels"))
    return quality_rules.judge(docs, model, ["doc_id"]).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op6_token_counts(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: path of the model, piece_bpe_32k.model of the public tokenizers if none is given."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("piece_bpe_32k.model")
    out = token_counts.count_tokens(table(spark, folder, "documents"), ["doc_id"], tokenizer, TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op7_contaminated_documents(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])


def op8_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, folder, "documents"))


def op9_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, folder, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op10_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES, ["page_id"])


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"), ["doc_id"]).drop("places")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixture, op2_quality_scores, op3_repaired_chats, op4_byte_shards, op5_quality_rules, op6_token_counts, op7_contaminated_documents, op8_jaccard_components, op9_repeated_windows, op10_url_rules,
                                op11_collocations, op12_licences, op13_hard_negatives)}

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"



def training_time_sql(share: str) -> str:
    """The time at which a source's schedule has spent ``share`` of its area."""
    cases = []
    for j, knots in enumerate(mixing.SCHEDULES):
        spent, parts = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            need = f"({share} * {mixing.area(knots)}::DOUBLE - {spent}::DOUBLE)"
            root = f"sqrt(greatest(0.0::DOUBLE, {w0 * w0}::DOUBLE + ({2 * (w1 - w0) / (t1 - t0)})::DOUBLE * {need}))"
            spent += (t1 - t0) * (w0 + w1) / 2
            parts.append(f"WHEN {share} * {mixing.area(knots)}::DOUBLE <= {spent}::DOUBLE THEN least({t1}::DOUBLE, {t0}::DOUBLE + 2 * {need} / ({w0}::DOUBLE + {root}))")
        cases.append(f"WHEN {j} THEN CASE {' '.join(parts)} ELSE 1.0::DOUBLE END")
    return f"CASE nth % {len(mixing.SCHEDULES)} {' '.join(cases)} END"


_TIMES = ", ".join(f"CASE WHEN copies > {i} THEN CAST(floor({training_time_sql(f'least(1.0::DOUBLE, ({i} * source_size + unit_middle) / greatest(target, 1.0::DOUBLE))')} * 1000000) AS BIGINT) END AS at_{i + 1}"
                   for i in range(mixing.MAX_REPEATS))
OP1_SQL = rf"""
WITH docs AS (SELECT doc_id, source, text, {WORDS_SQL} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM docs GROUP BY source),
weighted AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3 * source_size AS cap FROM sources),
ordered AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
  coalesce(sum(cap) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS spent
  FROM weighted WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT max((total - capped)::DOUBLE / (weights - spent)) AS level FROM ordered WHERE (total - capped)::DOUBLE / (weights - spent) * weight <= cap),
plan AS (SELECT source, source_size, nth, least(level * weight, cap::DOUBLE) AS target FROM weighted, levels),
placed AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.nth, d.source, d.text, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.text ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS begins,
  CAST(floor(p.target / greatest(p.source_size, 1)) AS BIGINT) AS whole FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
counted AS (SELECT *, whole + CASE WHEN begins + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END AS copies,
  min(begins) OVER same + CAST(sum(size) OVER same AS BIGINT) / 2.0::DOUBLE AS unit_middle FROM placed WINDOW same AS (PARTITION BY source, doc_id, text))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies, {_TIMES} FROM counted
"""

OP7_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(len(w), 5) AS n FROM b WHERE len(w) > 0),
dg AS (SELECT DISTINCT r, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)),
bg AS (SELECT DISTINCT q, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT q, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT q, count(*) AS n_item FROM bg GROUP BY q),
common AS (SELECT r, q, count(*) AS n_shared FROM dg JOIN bg USING (n, g) GROUP BY r, q)
SELECT d.doc_id, b.item_id, c.n_shared, s.n_item, c.n_shared::DOUBLE / s.n_item AS containment
FROM common c JOIN sizes s USING (q) JOIN d USING (r) JOIN b USING (q) WHERE 100 * c.n_shared >= 80 * s.n_item
"""

OP8_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
grams AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM starts),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
pairs AS (SELECT a.r AS r, b.r AS s, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT p.r, p.s FROM pairs p JOIN sizes x ON p.r = x.r JOIN sizes y ON p.s = y.r WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(r, s) AS (SELECT r, r FROM sizes UNION SELECT reach.r, links.s FROM reach JOIN links ON reach.s = links.r),
named AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.s GROUP BY reach.r)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, CASE WHEN sizes.n IS NULL THEN d.doc_id ELSE named.component_id END AS component_id
FROM d LEFT JOIN sizes ON d.r = sizes.r LEFT JOIN named ON d.r = named.r
"""

OP9_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS sequence FROM starts),
repeated AS (SELECT sequence FROM windows GROUP BY sequence HAVING count(*) > 1),
hits AS (SELECT r, i FROM windows JOIN repeated USING (sequence)),
covered AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM hits)),
spread AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT s.r, count(*) AS n, string_agg(s.word, ' ' ORDER BY s.p) AS kept FROM spread s ANTI JOIN covered c ON s.r = c.r AND s.p = c.p GROUP BY s.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.r = k.r
"""

OP10_SQL = r"""
WITH parts AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS raw,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
hosts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT h.*, r.rule_host || r.rule_path AS rule, r.verdict,
  row_number() OVER (PARTITION BY h.page_id, h.host, h.path ORDER BY length(r.rule_host) + length(r.rule_path) DESC, length(r.rule_host) DESC) AS nth
  FROM hosts h LEFT JOIN rules r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE nth = 1
"""

OP11_SQL = r"""
WITH pieces AS MATERIALIZED (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS MATERIALIZED (SELECT lang, w[i:i + k - 1] AS g, k, count(*) AS f FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM grams WHERE k > 1 AND f >= 10),
inside AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM candidates WHERE k = 3 UNION ALL SELECT lang, g[2:3], f FROM candidates WHERE k = 3) GROUP BY lang, g),
open AS (SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.g = i.g WHERE i.f IS NULL OR 100 * i.f < 50 * c.f),
cuts AS (SELECT o.lang, o.g, o.f AS a, x.f AS l, y.f AS r, x.k AS cut, CAST((1000000::HUGEINT * o.f * o.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM open o JOIN grams x ON x.lang = o.lang AND x.k < o.k AND x.g = o.g[1:x.k] JOIN grams y ON y.lang = o.lang AND y.k = o.k - x.k AND y.g = o.g[x.k + 1:o.k]),
lowest AS (SELECT *, array_to_string(g, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest JOIN totals USING (lang) QUALIFY rank <= 2000
"""

OP13_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (SELECT anchor, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS nth FROM scored WHERE same QUALIFY nth <= 5)
SELECT s.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.other) AS INTEGER) AS rank, s.other AS negative_id,
  p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op1_mixture": OP1_SQL, "op7_contaminated_documents": OP7_SQL, "op8_jaccard_components": OP8_SQL, "op9_repeated_windows": OP9_SQL, "op10_url_rules": OP10_SQL,
                           "op11_collocations": OP11_SQL, "op12_licences": licences.scan_sql(), "op13_hard_negatives": OP13_SQL}
