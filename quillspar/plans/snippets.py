"""Queries over places in texts: words of documents, and routes, schemas and types whose SQL needs the ids only."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspar.operators import parsing
from quillspar.plans.base import query
from quillspar.sources.adapters import quoted, read, snippets

_WORD = r"\b([A-Z][a-z]+ing|[a-z]+ing)\b"


@query(f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
hits AS (SELECT doc_id, k, unnest(regexp_extract_all(line, {quoted(_WORD)})) AS hit, generate_subscripts(regexp_extract_all(line, {quoted(_WORD)}), 1) AS i FROM lines)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS INT) AS n, hit, CAST(k AS INT) AS line FROM hits""")
def word_places(spark, sf_dir):
    """Each word of a pattern with its number in its document and its line."""
    return parsing.matches(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", _WORD)


@query("""SELECT 'src/s' || doc_id || '.js' AS path, '/r' || (doc_id % 7) AS route, 'GET,POST' AS methods FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT 'src/s' || doc_id || '.js', '/i' || (doc_id % 5), 'GET,DELETE' FROM documents WHERE doc_id % 4 = 0""")
def server_routes(spark, sf_dir):
    return parsing.express_routes(snippets(spark, sf_dir).filter("path LIKE '%.js'"))


@query("""SELECT 'src/s' || doc_id || '.tsx' AS path, '/h' || (doc_id % 9) AS route, 0::BIGINT AS n FROM documents WHERE doc_id % 4 = 1""")
def element_routes(spark, sf_dir):
    return parsing.jsx_routes(snippets(spark, sf_dir).filter("path LIKE '%.tsx'"))


@query("""SELECT 'src/s' || doc_id || '.tsx' AS path, '/o' || (doc_id % 4) AS route, 4 AS line FROM documents WHERE doc_id % 4 = 1""")
def property_routes(spark, sf_dir):
    return parsing.object_routes(snippets(spark, sf_dir).filter("path LIKE '%.tsx'"))


@query("""WITH s AS (SELECT doc_id AS d, 'src/s' || doc_id || '.graphql' AS path FROM documents WHERE doc_id % 4 = 2)
SELECT path, 'type' AS kind, 'T' || d AS name, 'id,f' || (d % 3) AS members FROM s UNION ALL SELECT path, 'enum', 'E' || d, 'A,B' FROM s UNION ALL SELECT path, 'union', 'U' || d, 'T' || d || ',Other' FROM s""")
def declared_members(spark, sf_dir):
    return parsing.schema_members(snippets(spark, sf_dir).filter("path LIKE '%.graphql'"))


@query("""WITH s AS (SELECT doc_id AS d, 'src/s' || doc_id || '.graphql' AS path FROM documents WHERE doc_id % 4 = 2)
SELECT path, 'type' AS kind, 'T' || d AS name, 'id' AS field, 'ID!' AS type FROM s UNION ALL SELECT path, 'type', 'T' || d, 'f' || (d % 3), 'Int' FROM s""")
def declared_fields(spark, sf_dir):
    return parsing.schema_fields(snippets(spark, sf_dir).filter("path LIKE '%.graphql'"))


@query("""WITH s AS (SELECT doc_id AS d FROM documents WHERE doc_id % 4 = 3)
SELECT 'A' || d AS src, 'B' || d AS dst, 'extends' AS relation FROM s UNION ALL SELECT 'C' || d, 'A' || d, 'references' FROM s
UNION ALL SELECT 'C' || d, 'B' || d, 'references' FROM s UNION ALL SELECT 'K' || d, 'A' || d, 'implements' FROM s""")
def declared_relations(spark, sf_dir):
    return parsing.type_edges(snippets(spark, sf_dir))[1]


@query("""WITH s AS (SELECT doc_id AS d FROM documents WHERE doc_id % 4 = 3)
SELECT kind, count(*) AS names FROM (SELECT 'interface' AS kind FROM s UNION ALL SELECT 'interface' FROM s UNION ALL SELECT 'alias' FROM s UNION ALL SELECT 'class' FROM s) GROUP BY kind""")
def declared_kinds(spark, sf_dir):
    return parsing.type_edges(snippets(spark, sf_dir))[0].groupBy("kind").agg(F.count("*").alias("names"))


@query("SELECT CASE doc_id % 4 WHEN 0 THEN 'src/s' || doc_id || '.js' WHEN 1 THEN 'src/s' || doc_id || '.tsx' WHEN 2 THEN 'src/s' || doc_id || '.graphql' ELSE 'src/s' || doc_id || '.ts' END AS path, doc_id % 4 = 0 AS server, doc_id % 4 = 1 AS react, false AS vue FROM documents")
def routers_of_files(spark, sf_dir):
    """Which frameworks' routes each file shows."""
    c = F.col("content")
    return snippets(spark, sf_dir).select("path", parsing.express_files(c).alias("server"), parsing.react_files(c).alias("react"), parsing.vue_files(c).alias("vue"))
