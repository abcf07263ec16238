"""Readers: JSONL and CSV with fixed schemas, manifests, dumps, Markdown blocks, DOCX blocks, YAML and PDF where their libraries are."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from importlib import import_module
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import retrieval
from ..plans.session import ship

CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "doc", "manual_id", "block_type", "text", "display_text", "source")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("heading_path", "product", "numbers", "unit_numbers")]
    + [T.StructField("n_chars", T.IntegerType()), T.StructField("table_rows", T.ArrayType(T.ArrayType(T.StringType())))]
)
MANIFEST = "version int, n_chunks int, manuals map<string,string>, chunks array<struct<chunk_id:string,sha256:string,manual_id:string,clause:string,n_chars:int,dup_group:string,excluded_from_retrieval:boolean>>"
DUMP = "question_id string, question string, chunks array<struct<chunk_id:string,manual_id:string,fused_score:double,display_text:string>>"
BLOCK = "path string, seq int, kind string, level int, text string, cells array<array<string>>"


def jsonl(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Rows of all files with the file each came from; blank lines are skipped, a bad line or a missing file is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn("_file", F.input_file_name())


def csv_strings(spark: SparkSession, path: str, columns: list[str], comment: str | None = None) -> DataFrame:
    """Columns by name as strings, blank where missing; a byte-order mark is no part of the first name."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    raw = (r.option("comment", comment) if comment else r).csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*((F.coalesce(F.col(f"`{names[c]}`"), F.lit("")) if c in names else F.lit("")).alias(c) for c in columns))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe terms with their defaults: at least once, category domain; lines that begin with # are remarks."""
    p = csv_strings(spark, path, ["term", "min_count", "category"], comment="#")
    return p.select("term", F.coalesce(F.expr("try_cast(min_count as int)"), F.lit(1)).alias("min_count"), F.when(F.col("category") == "", "domain").otherwise(F.col("category")).alias("category"))


def yaml_rows(spark: SparkSession, texts: list[str], key: str, schema) -> DataFrame:
    """Rows under ``key`` of YAML documents; booleans come back as the words they stood for. Needs PyYAML."""
    try:
        load = import_module("yaml").safe_load
    except ModuleNotFoundError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    names = [f.name for f in (schema.fields if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fields)]
    said = lambda v: "yes" if v is True else "no" if v is False else v
    return spark.createDataFrame([tuple(said(row.get(n)) for n in names) for t in texts for row in (load(t) or {}).get(key, [])], schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of a manifest."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.inline("chunks"))


def retrieval_dump(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, rnk, chunk_id, fused_score) of a dump, in the dump's order."""
    d = spark.read.schema(DUMP).option("mode", "FAILFAST").json(path)
    return d.select("question_id", F.posexplode("chunks").alias("p", "c")).select("question_id", (F.col("p") + 1).alias("rnk"), "c.chunk_id", "c.fused_score")


def lookup(chunks: DataFrame, key: str, ids: list[str], most: int = 5) -> DataFrame:
    """Chunks by id; an id that isn't there comes with up to five that contain it. The ids are a stated set and go out in blocks."""
    want = chunks.sparkSession.createDataFrame([(i,) for i in ids], "want string")
    c = chunks.withColumn("_k", F.col(key).cast("string"))
    hit = c.where(F.col("_k").isin(ids)).select(F.col("_k").alias("want"), F.col("_k").alias("id"), F.lit(True).alias("found"))
    missing = want.join(hit.select("want").distinct(), "want", "left_anti")
    near = retrieval.against(c.select("_k"), missing, F.col("_k").contains(F.col("want"))).groupBy("want").agg(F.slice(F.array_sort(F.collect_set("_k")), 1, most).alias("ids"))
    return hit.unionByName(near.select("want", F.explode("ids").alias("id"), F.lit(False).alias("found")))


def markdown_blocks(files: DataFrame) -> DataFrame:
    """(path, seq, page, level, text) of Markdown files (path, text): page markers set the page, comments go, # sets the level."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "(?s)<!--(?!\\s*page).*?-->", ""), "\n")).alias("seq", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.regexp_extract("line", "<!--\\s*page\\s+([0-9]+)\\s*-->", 1)
    level = F.length(F.regexp_extract("line", "^(#{1,6})\\s", 1))
    p = lines.withColumn("page", F.coalesce(F.last(F.when(mark != "", mark.cast("int")), True).over(w), F.lit(1)))
    return p.where((mark == "") & (F.trim("line") != "")).select("path", "seq", "page", F.when(level > 0, level).alias("level"), F.trim(F.regexp_replace("line", "^#{1,6}\\s+", "")).alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> Iterator[tuple[str, int | None, str, list[list[str]] | None]]:
    """(kind, level, text, cells) in the body's order: headings by style, paragraphs, text boxes, and tables with merged cells spread out."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")

    def words(e) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else " " for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).strip()

    def grid(tbl) -> list[list[str]]:
        rows = []
        for tr in tbl.findall(f"{_W}tr"):
            row = []
            for tc in tr.findall(f"{_W}tc"):
                pr = tc.find(f"{_W}tcPr")
                span = pr.find(f"{_W}gridSpan") if pr is not None else None
                merge = pr.find(f"{_W}vMerge") if pr is not None else None
                goes_on = merge is not None and merge.get(f"{_W}val") != "restart"
                row += ["" if goes_on else " ".join(filter(None, map(words, tc.findall(f"{_W}p"))))] + [""] * (int(span.get(f"{_W}val")) - 1 if span is not None else 0)
            rows.append(row)
        return rows

    for e in body:
        if e.tag == f"{_W}tbl":
            yield "table", None, "", grid(e)
        elif e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val") if style is not None else ""
            level = int(name[-1]) if name.lower().startswith("heading") and name[-1:].isdigit() else None
            boxed = {id(t) for box in e.iter(f"{_W}txbxContent") for t in box.iter(f"{_W}t")}
            own = "".join(t.text or "" for t in e.iter(f"{_W}t") if id(t) not in boxed).strip()
            if own:
                yield ("head" if level else "prose"), level, own, None
            for box in e.iter(f"{_W}txbxContent"):
                if text := words(box):
                    yield "textbox", None, text, None


def docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of DOCX files (see docx_blocks), one task per file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for f in part.itertuples():
                yield pd.DataFrame([(f.path, n, *b) for n, b in enumerate(docx_blocks(bytes(f.content)))], columns=["path", "seq", "kind", "level", "text", "cells"]).astype({"level": "Int32"})

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, BLOCK)


def pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of PDF files. Needs pypdf on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            reader = import_module("pypdf").PdfReader
        except ModuleNotFoundError as e:
            raise RuntimeError("reading PDF needs pypdf") from e
        for part in parts:
            for f in part.itertuples():
                yield pd.DataFrame([(f.path, n, p.extract_text() or "") for n, p in enumerate(reader(io.BytesIO(bytes(f.content))).pages, 1)], columns=["path", "page", "text"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, seq, tag, text): headings, paragraphs and list items of pages in order, tags and references in them undone."""
    items = F.regexp_extract_all("html", F.lit("(?s)<(h[1-6]|p|li)>(.*?)(?=<(?:h[1-6]|p|li|/p|/li|/h[1-6]|/article|footer)\\b)"), F.lit(0))
    e = pages.select("page_id", F.posexplode(items).alias("seq", "raw"))
    text = F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", ""), "\\s+", " ")
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(ch))
    return e.select("page_id", "seq", F.regexp_extract("raw", "^<(\\w+)>", 1).alias("tag"), X.strip(text).alias("text"))


def routes(**frames: DataFrame) -> DataFrame:
    """Outputs of several extractors in one table, each with its route's name."""
    out = None
    for name, df in frames.items():
        d = df.withColumn("route", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
