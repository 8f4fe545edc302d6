"""Vector records, schema catalogue, search contexts and logged statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.neighbours import nearest
from ..plans import catalogue as G
from ..plans import statements as ST
from ..sources import schemas as SC
from .base import Context, query
from .oracle_tables import hu

# Query batch: the mean vector of every label.
_CENTRES_SQL = """SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, CAST(sum(CAST(floor(CAST(x AS DOUBLE)*1e6+0.5) AS BIGINT)) AS DOUBLE)/count(*)/1e6 AS m
 FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label"""


def _hits_sql(k: int, where: str = "true") -> str:
    distance = "list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), q.c), lambda p: (p[1]-p[2])*(p[1]-p[2])))"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM (
 SELECT q.label AS query_id, v.vec_id AS neighbour_id, {hu(distance, 9)} AS distance FROM embeddings v CROSS JOIN ({_CENTRES_SQL}) q WHERE {where})) WHERE rank<={k}"""


def _centres(c: Context) -> DataFrame:
    return G.label_centres(c.raw("embeddings"))


@query("vector_top_k", "query_id b, neighbour_id b, distance d, rank b", _hits_sql(5))
def _(c: Context):
    return G.search(c.raw("embeddings"), _centres(c), 5)


@query("filtered_vector_top_k", "query_id b, neighbour_id b, distance d, relevance d, rank b",
       f"SELECT *, 1.0-distance AS relevance FROM ({_hits_sql(10, 'v.label>=5')})")
def _(c: Context):
    return G.search(c.raw("embeddings"), _centres(c), 10, F.col("label") >= 5)


@query("embedding_knn", "query_id b, neighbour_id b, distance d, rank b", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM (
 SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {hu('list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1]-p[2])*(p[1]-p[2])))', 9)} AS distance
 FROM embeddings a CROSS JOIN embeddings b)) WHERE rank<=5""")
def _(c: Context):
    return nearest(c.raw("embeddings"), 5, id_column="vec_id", vector="embedding", metric="l2")


@query("embedding_knn_cosine", "query_id b, neighbour_id b, distance d, rank b", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM (
 SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {hu('1.0-list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))', 9)} AS distance
 FROM embeddings a CROSS JOIN embeddings b)) WHERE rank<=10""")
def _(c: Context):
    return nearest(c.raw("embeddings"), 10, id_column="vec_id", vector="embedding")


@query("vector_upsert", "collection s, id s, first d, source s, label s", """
SELECT 'tables' AS collection, CAST(vec_id AS VARCHAR) AS id, CASE WHEN label=3 OR label=4 THEN -embedding[1] ELSE embedding[1] END AS first,
 CASE WHEN label=3 THEN 'api' WHEN label=4 THEN 'reload' ELSE 'seed' END AS source, CAST(label AS VARCHAR) AS label FROM embeddings
UNION ALL SELECT 'notes', CAST(vec_id AS VARCHAR), -embedding[1], 'api', CAST(label AS VARCHAR) FROM embeddings WHERE label=3""")
def _(c: Context):
    """The stored records, then labels 3 and 4 embedded again; label 3 also goes to another collection."""
    rows = c.raw("embeddings").withColumns({"id": F.col("vec_id").cast("string"), "collection": F.lit("tables")})
    label = F.col("label").cast("string")
    stored = rows.withColumn("metadata", F.create_map(F.lit("label"), label, F.lit("source"), F.lit("seed")))
    again = rows.withColumn("embedding", F.transform("embedding", lambda x: -x))
    third = again.filter("label = 3").withColumn("metadata", F.create_map(F.lit("label"), label))
    fourth = again.filter("label = 4").withColumn("metadata", F.create_map(F.lit("label"), label, F.lit("source"), F.lit("reload")))
    new = third.unionByName(fourth).unionByName(third.withColumn("collection", F.lit("notes")))
    out = G.vector_upsert(stored, new)
    return out.select("collection", "id", F.get("embedding", F.lit(0)).alias("first"),
                      F.col("metadata")["source"].alias("source"), F.col("metadata")["label"].alias("label"))


# Schema catalogue: the six source tables with their present row counts.
_KEYS = {"members": "member_id", "credit_cards": "card_id", "payment_history": "payment_id", "financial_health_metrics": "metric_id",
         "financial_products": "product_id", "product_recommendations": "recommendation_id"}
_LINKS = {(t, k): f"{p}.{pk}" for t, k, p, pk in SC.SOURCE_FOREIGN_KEYS}


def _columns(c: Context) -> DataFrame:
    return G.column_rows({t: c.src.table(t) for t in _KEYS}, "bank", "oltp", _KEYS, SC.SOURCE_FOREIGN_KEYS)


def _catalogue_rows() -> str:
    rows = []
    for table, schema in SC.SOURCE_SCHEMAS.items():
        for i, f in enumerate(schema.fields):
            link = _LINKS.get((table, f.name))
            rows.append(f"('{table}',{i + 1},'{f.name}','{f.dataType.simpleString()}',{str(_KEYS[table] == f.name).lower()},{repr(link) if link else 'NULL'})")
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _KEYS)
    return (f"SELECT c.*, n.row_count FROM (VALUES {', '.join(rows)}) c(table_name, position, column_name, column_type, is_primary_key, refers_to) "
            f"JOIN ({counts}) n USING (table_name)")


_CATALOGUE_SQL = _catalogue_rows()
_NOTES_SQL = f"""SELECT table_name, array_to_string(list_filter([
 CASE WHEN table_name LIKE '%member%' THEN 'Customer/member information' WHEN table_name LIKE '%payment%' THEN 'Payment transactions and history'
  WHEN table_name LIKE '%card%' THEN 'Credit card details and management' WHEN table_name LIKE '%health%' THEN 'Financial health metrics and scoring'
  WHEN table_name LIKE '%product%' THEN 'Financial products and offerings' WHEN table_name LIKE '%recommendation%' THEN 'Product recommendations and suggestions' END,
 CASE WHEN bool_or(column_name LIKE '%income%') THEN 'Income-related data' END, CASE WHEN bool_or(column_name LIKE '%score%') THEN 'Scoring and rating metrics' END,
 CASE WHEN bool_or(column_name LIKE '%balance%') THEN 'Account balances and amounts' END,
 CASE WHEN bool_or(column_name LIKE '%date%' OR column_name LIKE '%time%') THEN 'Time-series data' END], lambda x: x IS NOT NULL), '; ') AS business_context
 FROM ({_CATALOGUE_SQL}) GROUP BY table_name"""
_DOCUMENTS_SQL = f"""SELECT 'bank_'||table_name AS id, table_name, max(row_count) AS row_count, count(*) AS column_count,
 'Database: bank (OLTP)'||chr(10)||'Table: '||table_name||chr(10)||'Business Context: '||any_value(business_context)||chr(10)||'Columns:'||chr(10)
 ||string_agg('  - '||column_name||' ('||column_type||')', chr(10) ORDER BY position) FILTER (position<=10)
 ||CASE WHEN count(*)>10 THEN chr(10)||'  ... and '||(count(*)-10)||' more columns' ELSE '' END
 ||chr(10)||'Primary Keys: '||string_agg(column_name, ', ' ORDER BY position) FILTER (is_primary_key)
 ||coalesce(chr(10)||'Foreign Keys: '||string_agg(column_name||' -> '||refers_to, '; ' ORDER BY position) FILTER (refers_to IS NOT NULL), '')
 ||chr(10)||'Approximate Rows: '||format('{{:,}}', max(row_count)) AS document
FROM ({_CATALOGUE_SQL}) JOIN ({_NOTES_SQL}) USING (table_name) GROUP BY table_name"""


@query("catalogue_extract", "table_name s, position b, column_name s, column_type s, is_primary_key o, refers_to s, row_count b", _CATALOGUE_SQL)
def _(c: Context):
    return _columns(c)


@query("business_context", "table_name s, business_context s", _NOTES_SQL)
def _(c: Context):
    return G.business_context(_columns(c))


@query("schema_documents", "id s, table_name s, row_count b, column_count b, document s", _DOCUMENTS_SQL)
def _(c: Context):
    return G.schema_documents(_columns(c))


@query("catalogue_reload", "id s, database_type s, row_count b", f"""
SELECT id, 'oltp' AS database_type, row_count FROM ({_DOCUMENTS_SQL})
UNION ALL SELECT 'event_'||event_id, CASE event_type WHEN 'view' THEN 'dw' WHEN 'click' THEN NULL ELSE 'log' END, event_id FROM events WHERE event_type<>'error'""")
def _(c: Context):
    """A store of event records, in which the errors were the old source catalogue."""
    kind = F.when(F.col("event_type") == "view", "dw").when(F.col("event_type") == "error", "oltp").when(F.col("event_type") != "click", "log")
    store = c.raw("events").select(F.concat(F.lit("event_"), F.col("event_id")).alias("id"), kind.alias("database_type"),
                                   F.col("event_id").alias("row_count"))
    fresh = G.schema_documents(_columns(c)).select("id", "database_type", "row_count")
    return G.reload(store, fresh, "oltp")


@query("relationships", "id s, table_name s, relationship s", f"""
SELECT 'bank_'||table_name AS id, table_name, string_agg(column_name||' -> '||refers_to, '; ' ORDER BY position) AS relationship
FROM ({_CATALOGUE_SQL}) WHERE refers_to IS NOT NULL GROUP BY table_name""")
def _(c: Context):
    return G.relationships(G.schema_documents(_columns(c)))


_MARK = G.SECTION_MARK


@query("section_split", "doc_id b, section_number b, table_name s, document s", f"""
SELECT doc_id, i AS section_number, name AS table_name, 'Business Schema Definition - '||name||chr(10)||chr(10)||trim(part, ' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)) AS document FROM (
 SELECT doc_id, i, part, CASE i WHEN 1 THEN lang||'_'||doc_id ELSE 'unknown' END AS name FROM (
  SELECT doc_id, lang, unnest(['CREATE TABLE '||lang||'_'||doc_id||' ('||chr(10)||replace(text,'CREATE','Create')||chr(10)||');', '   '||chr(10), replace(text,'CREATE','Create')]) AS part, unnest([1,2,3]) AS i
  FROM documents) WHERE i<>2) WHERE trim(part, ' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11))<>''""")
def _(c: Context):
    """Schema texts made of each document: a table definition, a blank section, and the text alone."""
    body = F.replace(F.col("text"), F.lit("CREATE"), F.lit("Create"))
    mark = F.lit("\n" + _MARK + "\n")
    text = F.concat(F.lit("intro"), mark, F.lit("CREATE TABLE "), F.col("lang"), F.lit("_"), F.col("doc_id"), F.lit(" (\n"), body,
                    F.lit("\n);"), mark, F.lit("   \n"), mark, body)
    return G.sections(c.raw("documents").select("doc_id", text.alias("schema_text")), "doc_id", "schema_text")


# Search hits with the metadata of catalogue records.

def _records(vectors: DataFrame) -> DataFrame:
    n, label = F.col("vec_id"), F.col("label")
    return vectors.select(
        n.alias("neighbour_id"), F.when(n % 3 == 0, "dw").otherwise("oltp").alias("database_type"), F.lit("bank").alias("database_name"),
        F.concat(F.lit("table_"), n).alias("table_name"), (n * 1000).alias("row_count"), (label + 3).alias("column_count"),
        F.concat(F.lit("Table: table_"), n, F.when(n % 2 == 0, F.concat(F.lit("\nForeign Keys: label -> labels_"), label, F.lit(".id"))).otherwise("")).alias("document"))


def _context_hits(c: Context) -> DataFrame:
    hits = G.search(c.raw("embeddings"), _centres(c), 5)
    return hits.join(_records(c.raw("embeddings")), "neighbour_id")


_CONTEXT_SQL = f"""SELECT h.query_id, h.rank, 1.0-h.distance AS relevance, CASE WHEN vec_id%3=0 THEN 'dw' ELSE 'oltp' END AS database_type, 'table_'||vec_id AS table_name,
 vec_id*1000 AS row_count, label+3 AS column_count, CASE WHEN vec_id%2=0 THEN 'label -> labels_'||label||'.id' END AS link, 'Table: table_'||vec_id AS head
FROM ({_hits_sql(5)}) h JOIN embeddings e ON e.vec_id=h.neighbour_id"""


@query("context_summary", "query_id b, total_tables b, oltp_tables b, dw_tables b, primary_database_type s, table_names s, total_approximate_rows b", f"""
SELECT query_id, count(*) AS total_tables, count(*) FILTER (database_type='oltp') AS oltp_tables, count(*) FILTER (database_type='dw') AS dw_tables,
 CASE WHEN count(*) FILTER (database_type='dw')>count(*) FILTER (database_type='oltp') THEN 'dw' ELSE 'oltp' END AS primary_database_type,
 string_agg(table_name, ',' ORDER BY rank) AS table_names, sum(row_count) AS total_approximate_rows FROM ({_CONTEXT_SQL}) GROUP BY query_id""")
def _(c: Context):
    return G.context_summary(_context_hits(c))


_GUIDE = "'## Hints'||chr(10)||'- Follow the links listed above when tables are combined.'||chr(10)||'- Name computed columns, and bound the rows that are asked for.'"


@query("context_prompt", "query_id b, prompt s", f"""
SELECT query_id, '# SQL Query Generation Task'||chr(10)||'Generate a SQL query for: **records of label '||query_id||'**'||chr(10)||chr(10)||'**Primary Database Type:** '
 ||CASE WHEN count(*) FILTER (database_type='dw')>count(*) FILTER (database_type<>'dw') THEN 'Data Warehouse (Analytics)' ELSE 'OLTP (Transactional)' END||chr(10)||chr(10)
 ||'## Available Tables and Schema Information:'||chr(10)||chr(10)
 ||string_agg('### '||rank||'. bank.'||table_name||' ('||upper(database_type)||') - Relevance: '||printf('%.1f%%', floor(relevance*100*10+0.5)/10)||chr(10)
  ||'**Rows:** '||format('{{:,}}',row_count)||' | **Columns:** '||column_count||chr(10)||chr(10)||'```sql'||chr(10)||head||coalesce(chr(10)||'Foreign Keys: '||link,'')||chr(10)||'```'||chr(10), chr(10) ORDER BY rank)||chr(10)
 ||coalesce('## Table Relationships:'||chr(10)||chr(10)||string_agg('- **'||table_name||'**: '||link, chr(10) ORDER BY rank) FILTER (link IS NOT NULL)||chr(10)||chr(10),'')
 ||{_GUIDE} AS prompt FROM ({_CONTEXT_SQL}) GROUP BY query_id""")
def _(c: Context):
    return G.context_prompt(_context_hits(c), F.concat(F.lit("records of label "), F.col("query_id").cast("string")))


# Logged statements: every conversation turn and document carries one, wrapped in different ways.

def _statements(c: Context) -> DataFrame:
    body = F.concat(F.lit("SELECT * FROM bank_oltp.members WHERE note = '"), F.col("text"), F.lit("'"))
    n = F.col("doc_id") % 5
    wrapped = (
        F.when(n == 0, F.concat(F.lit("```sql\n"), body, F.lit(";\n```")))
        .when(n == 1, F.concat(F.lit(" ```\n"), body, F.lit("\n``` ")))
        .when(n == 2, F.concat(F.lit("sql "), body, F.lit(" ; ")))
        .when(n == 3, F.concat(F.lit("select m.created_at from bank_oltp.members m join bank_dw.dim_member d where d.note = '"), F.col("text"), F.lit("'")))
        .otherwise(F.col("text")))
    return c.raw("documents").select("doc_id", "source", wrapped.alias("statement"))


_BODY_SQL = "'SELECT * FROM bank_oltp.members WHERE note = '''||text||''''"
_STATEMENT_SQL = f"""SELECT doc_id, source, text, CASE doc_id%5 WHEN 0 THEN '```sql'||chr(10)||{_BODY_SQL}||';'||chr(10)||'```' WHEN 1 THEN ' ```'||chr(10)||{_BODY_SQL}||chr(10)||'``` '
 WHEN 2 THEN 'sql '||{_BODY_SQL}||' ; ' WHEN 3 THEN 'select m.created_at from bank_oltp.members m join bank_dw.dim_member d where d.note = '''||text||'''' ELSE text END AS statement FROM documents"""
_WS = "' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
_CLEAN_SQL = f"""SELECT doc_id, source, CASE WHEN ends_with(bare,';') THEN trim(left(bare, length(bare)-1), {_WS}) ELSE bare END AS cleaned FROM (
 SELECT doc_id, source, trim(CASE WHEN starts_with(s,'```sql') THEN replace(replace(s,'```sql',''),'```','') WHEN starts_with(s,'```') THEN replace(s,'```','')
  WHEN lower(left(s,3))='sql' THEN s[4:] ELSE s END, {_WS}) AS bare FROM (SELECT doc_id, source, trim(statement, {_WS}) AS s FROM ({_STATEMENT_SQL})))"""


@query("clean_sql_text", "doc_id b, cleaned s", _CLEAN_SQL)
def _(c: Context):
    return _statements(c).select("doc_id", X.clean_statement(F.col("statement")).alias("cleaned"))


@query("expand_select_star", "doc_id b, expanded s", f"""
SELECT doc_id, CASE WHEN star>0 AND strpos(substr(lower(cleaned),star),'from')>0 THEN 'SELECT member_id AS customer_id, first_name, last_name, email, phone, date_of_birth '
 ||substr(cleaned, star+strpos(substr(lower(cleaned),star),'from')-1) ELSE cleaned END AS expanded FROM (SELECT *, strpos(lower(cleaned),'select *') AS star FROM ({_CLEAN_SQL}))""")
def _(c: Context):
    cleaned = _statements(c).withColumn("cleaned", X.clean_statement(F.col("statement")))
    return cleaned.select("doc_id", X.expand_star(F.col("cleaned")).alias("expanded"))


@query("ensure_product_id", "doc_id b, patched s", f"""
SELECT doc_id, CASE WHEN starts_with(ltrim(lower(cleaned)),'select') AND NOT contains(lower(cleaned),'product_id') THEN
 regexp_replace(regexp_replace(cleaned,'SELECT','SELECT product_id,'),'select','select product_id,') ELSE cleaned END AS patched FROM ({_CLEAN_SQL})""")
def _(c: Context):
    cleaned = _statements(c).withColumn("cleaned", X.clean_statement(F.col("statement")))
    return cleaned.select("doc_id", X.ensure_column(F.col("cleaned")).alias("patched"))


_LINEAGE_SQL = """CASE WHEN contains(lower({0}),'bank_oltp.') AND contains(lower({0}),'bank_dw.') THEN 'Both' WHEN contains(lower({0}),'bank_oltp.') THEN 'OLTP'
 WHEN contains(lower({0}),'bank_dw.') THEN 'DW' ELSE 'Unknown' END"""
_WORDS = "delete|update|insert|drop|alter|truncate|create"


@query("lineage", "doc_id b, lineage s", f"SELECT doc_id, {_LINEAGE_SQL.format('cleaned')} AS lineage FROM ({_CLEAN_SQL})")
def _(c: Context):
    return ST.analysed(_statements(c))


@query("destructive_guard", "doc_id b, is_destructive o, is_destructive_word o",
       f"SELECT doc_id, regexp_matches(lower(cleaned),'{_WORDS}') AS is_destructive, regexp_matches(lower(cleaned),'\\b({_WORDS})\\b') AS is_destructive_word FROM ({_CLEAN_SQL})")
def _(c: Context):
    return ST.analysed(_statements(c))


@query("lineage_volume", "date s, lineage s, statements b", """
SELECT CAST(ts AS DATE) AS date, CASE event_type WHEN 'view' THEN 'OLTP' WHEN 'click' THEN 'DW' WHEN 'purchase' THEN 'Both' ELSE 'Unknown' END AS lineage, count(*) AS statements
FROM events GROUP BY ALL""")
def _(c: Context):
    """One logged statement per event, written from its type."""
    event = F.col("event_type")
    sql = F.when(event == "view", F.concat(F.lit("SELECT 1 FROM BANK_OLTP.members WHERE member_id = "), F.col("user_id"))).when(
        event == "click", "select 1 from bank_dw.fact_payment").when(
        event == "purchase", "select 1 from bank_dw.dim_member d join bank_oltp.members m on true").otherwise(F.col("props"))
    log = c.raw("events").withColumn("lineage", X.lineage(sql))
    return ST.lineage_volume(log, F.to_date("ts"))


@query("conversation_statements", "conv_id b, turn b, cleaned s, is_destructive o", f"""
SELECT conv_id, turn, CASE WHEN ends_with(s,';') THEN trim(left(s,length(s)-1),{_WS}) ELSE s END AS cleaned,
 regexp_matches(lower(CASE WHEN ends_with(s,';') THEN trim(left(s,length(s)-1),{_WS}) ELSE s END),'{_WORDS}') AS is_destructive
FROM (SELECT conv_id, turn, trim('SELECT '''||text||''' AS said;',{_WS}) AS s FROM conversations)""")
def _(c: Context):
    said = F.concat(F.lit("SELECT '"), F.col("text"), F.lit("' AS said;"))
    return ST.analysed(c.raw("conversations").select("conv_id", "turn", said.alias("statement")))
