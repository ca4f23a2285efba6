"""Markdown: inline segments, blocks and storage markup; facts rendered as lines of documents; sinks."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspar.functions import rules

MOST_BLOCKS, MOST_CODE, TABLE_ROWS = 100, 2000, 99


def without_relative_links(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"\[([^\]]+)\]\(\.{1,2}/[^)]+\)", "$1")


def inline_segments(text: str) -> list[tuple[str, str]]:
    """(style, content) of bold, code and italic spans and the text between; what has no end stays plain."""
    out: list[tuple[str, str]] = []
    while text:
        m = re.search(r"\*\*|`|\*", text)
        if not m:
            out.append(("text", text))
            break
        if m.start():
            out.append(("text", text[: m.start()]))
        mark, rest = m[0], text[m.end() :]
        style = {"**": "bold", "`": "code", "*": "italic"}[mark]
        stop = rest.find(mark)
        if stop < 0 and style == "italic":
            out.append(("text", mark))
            text = rest
        elif stop < 0:
            out.append(("text", text[m.start() :]))
            break
        else:
            out.append((style, rest[:stop]))
            text = rest[stop + len(mark) :]
    return out


def blocks(markdown: str) -> list[tuple[str, str]]:
    """(kind, content) of up to MOST_BLOCKS blocks; code is cut, long tables are split with their header repeated."""
    lines, out, i = re.sub(r"\[([^\]]+)\]\(\.{1,2}/[^)]+\)", r"\1", markdown or "").split("\n"), [], 0
    while i < len(lines) and len(out) < MOST_BLOCKS:
        line = lines[i].strip()
        i += 1
        if not line:
            continue
        if line.startswith("```"):
            begin = i
            while i < len(lines) and not lines[i].strip().startswith("```"):
                i += 1
            code = "\n".join(lines[begin:i])
            i += 1
            if code.strip():
                out.append((f"code:{line[3:].strip() or 'plain text'}", code[:MOST_CODE]))
        elif line.startswith("|"):
            rows = [line]
            while i < len(lines) and lines[i].strip().startswith("|"):
                rows.append(lines[i].strip())
                i += 1
            cells = [[c.strip() for c in r.strip("|").split("|")] for r in rows if not re.fullmatch(r"[|\s:-]+", r)]
            width = max(map(len, cells), default=0)
            cells = [c + [""] * (width - len(c)) for c in cells]
            for a in range(0, max(1, len(cells) - 1), TABLE_ROWS):
                out.append(("table", "\n".join("|".join(c) for c in [cells[0], *cells[1:][a : a + TABLE_ROWS]]) if cells else ""))
        elif m := re.match(r"(#{1,3})\s+(.*)", line):
            out.append((f"heading_{len(m[1])}", m[2]))
        elif line in ("---", "***", "___"):
            out.append(("divider", ""))
        elif m := re.match(r"[-*]\s+(.*)", line):
            out.append(("bulleted", m[1]))
        elif m := re.match(r"\d+\.\s+(.*)", line):
            out.append(("numbered", m[1]))
        elif line.startswith(">"):
            out.append(("quote", line[1:].strip()))
        else:
            out.append(("paragraph", line))
    return out[:MOST_BLOCKS]


def storage(markdown: str) -> str:
    """Wiki storage markup: text escaped, code in CDATA sections that its own content can't close."""
    if not (markdown or "").strip():
        return "<p><em>No content available.</em></p>"
    out = []
    for kind, content in blocks(markdown):
        if kind.startswith("code:"):
            safe = content.replace("]]>", "]]]]><![CDATA[>")
            out.append(f'<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">{html.escape(kind[5:])}</ac:parameter><ac:plain-text-body><![CDATA[{safe}]]></ac:plain-text-body></ac:structured-macro>')
        elif kind == "table":
            rows = ["".join(f"<td>{_styled(c)}</td>" for c in r.split("|")) for r in content.split("\n")]
            out.append("<table><tbody>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</tbody></table>")
        elif kind == "divider":
            out.append("<hr/>")
        else:
            tag = {"heading_1": "h1", "heading_2": "h2", "heading_3": "h3", "quote": "blockquote"}.get(kind, "li" if kind in ("bulleted", "numbered") else "p")
            out.append(f"<{tag}>{_styled(content)}</{tag}>")
    return "".join(out)


def _styled(text: str) -> str:
    tags = {"bold": "strong", "code": "code", "italic": "em"}
    return "".join(html.escape(c) if s == "text" else f"<{tags[s]}>{html.escape(c)}</{tags[s]}>" for s, c in inline_segments(text))


def _listed(docs: DataFrame, function: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *x) for k, t in zip(pdf["key"], pdf["text"], strict=True) for i, x in enumerate(function(t or ""))]
            yield pd.DataFrame(rows, columns=["key", "n", "kind", "content"])

    kind = dict(docs.dtypes)["key"]
    return docs.select("key", "text").mapInPandas(run, f"key {kind}, n long, kind string, content string")


def segments_of(docs: DataFrame) -> DataFrame:
    return _listed(docs, inline_segments)


def blocks_of(docs: DataFrame) -> DataFrame:
    return _listed(docs, blocks)


def stored(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def markup(text: pd.Series) -> pd.Series:
        return text.map(storage)

    return docs.select("key", markup("text").alias("markup"))


def lines(facts: DataFrame, key: str, order: str, title: str, line: Column, most: int = 100) -> DataFrame:
    """A document as rows (doc_key, line_no, text): its title, and a line for each of the first facts in order."""
    body = facts.orderBy(order).limit(most).select(F.lit(key).alias("doc_key"), F.row_number().over(_by(order)).alias("line_no"), line.alias("text"))
    head = facts.sparkSession.createDataFrame([(key, 0, f"# {title}")], "doc_key string, line_no int, text string")
    return head.union(body)


def _by(order: str):
    from pyspark.sql import Window

    return Window.orderBy(order)  # at most `most` rows


def collapsed(document: DataFrame) -> DataFrame:
    """(doc_key, content): a document's lines in order, by section where there are sections."""
    order = ["section", "line_no"] if "section" in document.columns else ["line_no"]
    held = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return document.groupBy("doc_key").agg(F.array_join(F.transform(held, lambda x: x["text"]), "\n").alias("content"))


def write_documents(document: DataFrame, path: str) -> None:
    """One folder per document under `path`."""
    collapsed(document).select("doc_key", F.col("content").alias("value")).write.mode("overwrite").partitionBy("doc_key").text(path)


def write_set(document: DataFrame, artifacts: dict[str, DataFrame], path: str) -> None:
    """A document set: its documents, and a folder of JSON for each named artifact, to be read back by the next run."""
    write_documents(document, f"{path.rstrip('/')}/documents")
    for name, rows in artifacts.items():
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/artifacts/{name}")


def read_artifact(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """An artifact of the last document set; empty if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/artifacts/{name}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(at.toString())


def publish_markdown(document: DataFrame, path: str) -> None:
    """Documents under their fixed file names; those of no known name are left out."""
    names = F.create_map(*[F.lit(x) for pair in rules.MARKDOWN_FILES for x in pair])
    named = collapsed(document).withColumn("file", names[F.col("doc_key")]).filter("file IS NOT NULL")
    named.select("file", F.col("content").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def page_versions(current: DataFrame, pages: DataFrame) -> DataFrame:
    """What a versioned page store is to be told: documents (key, title, content) against pages (title, version, content).

    A page of the title is updated to the next version if its content differs, and created as version 1 if there is none.
    """
    held = pages.select(F.col("title").alias("_t"), F.col("version").alias("_v"), F.col("content").alias("_c"))
    joined = current.join(held, current["title"] == held["_t"], "left")
    action = F.when(F.col("_t").isNull(), "create").when(F.col("_c").eqNullSafe(F.col("content")), "keep").otherwise("update")
    return joined.select("key", "title", action.alias("action"), F.when(F.col("_t").isNull(), 1).when(action == "update", F.col("_v") + 1).otherwise(F.col("_v")).alias("version"))


def append_metrics(spark: SparkSession, now: DataFrame, path: str, keep: int = 90) -> DataFrame:
    """Append one row (ts, coverage, health, files, modules) to a history, and return its last `keep` rows."""
    now.write.mode("append").json(path)
    return spark.read.schema(now.schema).json(path).orderBy(F.desc("ts")).limit(keep)


def counted(df: DataFrame, observation: Observation, **counts: Column) -> DataFrame:
    """df, with named counts gathered while its rows flow by: nothing is sent anywhere."""
    return df.observe(observation, *[c.alias(n) for n, c in counts.items()])


def notification(facts: DataFrame) -> DataFrame:
    """JSON of a chat notification: colour by how much coverage changed (20 or more, 5 or more, less)."""
    change = F.abs("change")
    colour = F.when(change >= 20, "red").when(change >= 5, "yellow").otherwise("green")
    return facts.select(F.to_json(F.struct(F.col("project").alias("title"), colour.alias("colour"), F.col("change"))).alias("embed"))


def send(rows: DataFrame, client: Callable[[], object], size: int = 50) -> None:
    """Append rows (key, n, kind, content) to pages in chunks, through a client made on each executor."""

    def run(part: Iterator) -> None:
        target, held, key = client(), [], None
        for r in part:
            if held and (r.key != key or len(held) == size):
                target.append(key, held)
                held = []
            key = r.key
            held.append((r.kind, r.content))
        if held:
            target.append(key, held)

    rows.repartition("key").sortWithinPartitions("key", "n").foreachPartition(run)
