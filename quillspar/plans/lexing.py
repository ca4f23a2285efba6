"""Queries over comments, literals and tagged templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspar.operators import lexing, parsing
from quillspar.plans.base import query
from quillspar.sources.adapters import quoted, read, snippets

_SPANS = r"""(?s)//[^\n]*|/\*.*?\*/|/\*.*|"(?:[^"\\\n]|\\.)*(?:"|\\\z)?|'(?:[^'\\\n]|\\.)*(?:'|\\\z)?|`(?:[^`\\]|\\.)*(?:`|\\\z)?"""



def _sql(table: str, key: str, text: str) -> str:
    """Every span of a column, from its matches and the parts between them."""
    breaks = lambda x: f"length({x}) - length(replace({x}, chr(10), ''))"
    return f"""WITH cut AS (SELECT {key}, regexp_extract_all({text}, {quoted(_SPANS)}) AS hits, string_split_regex({text}, {quoted(_SPANS)}) AS parts FROM {table}),
each AS (SELECT {key}, unnest(hits) AS text, unnest(parts[: len(hits)]) AS part, generate_subscripts(hits, 1) AS i FROM cut),
placed AS (SELECT *, sum(length(part) + length(text)) OVER w AS finish, sum({breaks("part")} + {breaks("text")}) OVER w AS breaks FROM each WINDOW w AS (PARTITION BY {key} ORDER BY i))
SELECT {key}, CAST(finish - length(text) AS BIGINT) AS start, CAST(finish AS BIGINT) AS finish, CASE text[1] WHEN '/' THEN 'comment' WHEN '`' THEN 'template' ELSE 'string' END AS kind,
  CAST(1 + breaks - ({breaks("text")}) AS BIGINT) AS line, CASE WHEN text[1] = '`' THEN regexp_extract(right(part, {lexing.TAG}), '([0-9A-Za-z_]*)\\s*$', 1) ELSE '' END AS tag, text FROM placed"""


def _literals(spark, sf_dir, table, key, text):
    files = read(spark, sf_dir, table).select(F.col(key).cast("string").alias("path"), F.col(text).alias("content"))
    return lexing.spans(files).select(F.col("path").cast("long").alias(key), "start", "finish", "kind", "line", "tag", "text")


@query(_sql("documents", "doc_id", "text"))
def literals_in_documents(spark, sf_dir):
    """Each comment, string and template of the documents, read as source text."""
    return _literals(spark, sf_dir, "documents", "doc_id", "text")


@query(_sql("pages", "page_id", "html"))
def literals_in_pages(spark, sf_dir):
    """Each comment, string and template of the pages, read as source text."""
    return _literals(spark, sf_dir, "pages", "page_id", "html")


def _tagged(spark, sf_dir):
    """Schemas of documents in tagged templates, between texts that only look like them."""
    files = snippets(spark, sf_dir).filter("path LIKE '%.graphql'")
    schema, rest = F.regexp_extract("content", r"(?s)^(.*?\n)/\*", 1), F.regexp_extract("content", r"(?s)(/\*.*)$", 1)
    content = F.concat(F.lit("// gql`type No { id: ID }`\nconst a = \"gql`type Nor { id: ID }`\";\nexport const b = gql `\n"), schema, F.lit("`;\nconst c = css`type Not { id: ID }`;\n"), rest)
    return files.select("ord", F.regexp_replace("path", "graphql$", "ts").alias("path"), content.alias("content"))


@query("""WITH s AS (SELECT doc_id AS d, 'src/s' || doc_id || '.ts' AS path FROM documents WHERE doc_id % 4 = 2)
SELECT path, 'type' AS kind, 'T' || d AS name, 'id,f' || (d % 3) AS members FROM s UNION ALL SELECT path, 'enum', 'E' || d, 'A,B' FROM s UNION ALL SELECT path, 'union', 'U' || d, 'T' || d || ',Other' FROM s""")
def tagged_members(spark, sf_dir):
    return parsing.schema_members(lexing.tagged_schemas(_tagged(spark, sf_dir)))
