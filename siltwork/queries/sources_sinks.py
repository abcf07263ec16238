"""Readers and writers by round trips through the shared folder, and streams held against batches."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from ..plans.session import shared_path
from ..sources import files, sinks
from ..streaming import ledger
from .base import Registry, table, values

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.add("src01_jsonl", "SELECT doc_id, md5(text) AS h, n_chars FROM documents")
def _(spark, sf):
    d, path = table(spark, sf, "documents"), shared_path(spark, "jsonl")
    sinks.write_jsonl(d.withColumn("_private", F.lit(1)), path)
    return files.jsonl(spark, [path], d.schema).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "n_chars")


@R.add("src02_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, '' AS missing FROM part")
def _(spark, sf):
    path = shared_path(spark, "csv")
    sinks.write_report(table(spark, sf, "part"), path, ["p_partkey"])
    return files.csv_strings(spark, path, ["p_partkey", "p_name", "missing"])


def _file(spark, name: str, content: bytes) -> str:
    path = shared_path(spark, "file") + f"/{name}"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()
    return path


@R.add("src03_probes", "SELECT * FROM (VALUES ('loan', 3, 'term'), ('fee', 1, 'domain')) t(term, min_count, category)")
def _(spark, sf):
    return files.probes(spark, _file(spark, "probes.csv", "﻿term,min_count,category\n# a remark\nloan,3,term\nfee,,\n".encode()))


@R.add("src05_manifest", "SELECT doc_id AS id, sha256(text) AS sha256, length(text) AS n_chars FROM documents")
def _(spark, sf):
    path = shared_path(spark, "manifest")
    sinks.manifest(table(spark, sf, "documents"), "doc_id", "text").write.json(path)
    return spark.read.schema("id long, sha256 string, n_chars long").json(path)


@R.add("src05_manifest_scan", "SELECT * FROM (VALUES ('c1', 's1'), ('c2', 's2')) t(chunk_id, sha256)")
def _(spark, sf):
    body = b'{"version": 1, "n_chunks": 2, "manuals": {"m": "Manual"}, "chunks": [{"chunk_id": "c1", "sha256": "s1"},\n {"chunk_id": "c2", "sha256": "s2"}]}'
    return files.manifest(spark, _file(spark, "manifest.json", body)).select("chunk_id", "sha256")


_DOCX = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Loans</w:t></w:r></w:p><w:p><w:r><w:t>Terms </w:t></w:r><w:r><w:t>apply</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"""


@R.add("src06_docx", "SELECT * FROM (VALUES (0, 'head', 'Loans', ''), (1, 'prose', 'Terms apply', ''), (2, 'table', '', 'Head,/a,')) t(seq, kind, text, cells)")
def _(spark, sf):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", _DOCX)
    b = files.docx(spark, _file(spark, "a.docx", buf.getvalue()))
    return b.select("seq", "kind", "text", F.coalesce(F.array_join(F.transform("cells", lambda r: F.array_join(r, ",")), "/"), F.lit("")).alias("cells"))


@R.add("src06_html_blocks", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h[1-6]|p|li)>')) AS t FROM pages) GROUP BY page_id")
def _(spark, sf):
    return files.html_blocks(table(spark, sf, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))


@R.add("src09_markdown", "SELECT * FROM (VALUES (1, 1, 'Title'), (1, NULL, 'first line'), (2, 2, 'Part'), (2, NULL, 'second')) t(page, level, text)")
def _(spark, sf):
    md = spark.sql(values("path text", ("m", "# Title\nfirst line\n<!-- a remark -->\n<!-- page 2 -->\n## Part\nsecond")))
    return files.markdown_blocks(md).select("page", "level", "text")


@R.add("src10_routes", "SELECT 'a' AS route, count(*) AS n FROM documents UNION ALL SELECT 'b', count(*) FROM pages")
def _(spark, sf):
    return files.routes(a=table(spark, sf, "documents").select("doc_id"), b=table(spark, sf, "pages").select("page_id")).groupBy("route").agg(F.count("*").alias("n"))


@R.add("src11_engine_outputs", "SELECT lang AS engine, count(*) AS pages, count(*) FILTER (WHERE text = '') AS blank FROM documents GROUP BY lang")
def _(spark, sf):
    """Recognition runs outside; its outputs are a table of (engine, page, text)."""
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("engine")).agg(F.count("*").alias("pages"), F.count_if(F.col("text") == "").alias("blank"))


@R.add("src12_gate", "SELECT 'ids;texts' AS passed, 'toxic' AS stopped")
def _(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    ok = [("ids", lambda: d.groupBy("doc_id").count().where("count > 1")), ("texts", lambda: d.where("text is null"))]
    passed, stopped = sinks.gate(ok), ""
    try:
        sinks.gate([*ok, ("toxic", lambda: lab.where("toxic = 1"))])
    except sinks.GateFailed as e:
        stopped = str(e).split(":")[0]
    return spark.createDataFrame([(";".join(passed), stopped)], "passed string, stopped string")


@R.add("src13_retrieval_dump", "SELECT CAST(conv_id AS VARCHAR) AS question_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS rnk, CAST(turn AS VARCHAR) AS chunk_id FROM conversations")
def _(spark, sf):
    path = shared_path(spark, "dump")
    c = F.struct("turn", F.struct(F.col("turn").cast("string").alias("chunk_id"), F.lit("m").alias("manual_id"), F.lit(0.5).alias("fused_score"), F.lit("").alias("display_text")).alias("c"))
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["c"]).alias("chunks"))
    sinks.write_jsonl(rows.withColumn("question", F.lit("q")), path)
    return files.retrieval_dump(spark, path).select("question_id", "rnk", "chunk_id")


@R.add("src14_lookup", "SELECT * FROM (VALUES ('7', '7', true)) t(want, id, found) UNION ALL SELECT 'x9', NULL, NULL WHERE false")
def _(spark, sf):
    return files.lookup(table(spark, sf, "documents"), "doc_id", ["7", "x9"])


@R.add("snk01_private_columns", "SELECT 'doc_id,source' AS columns, count(*) AS n FROM documents")
def _(spark, sf):
    path = shared_path(spark, "public")
    sinks.write_jsonl(table(spark, sf, "documents").select("doc_id", "source", F.lit(1).alias("_body")), path)
    back = spark.read.json(path)
    return back.agg(F.lit(",".join(sorted(back.columns))).alias("columns"), F.count("*").alias("n"))


@R.add("snk03_manifest", "SELECT doc_id AS id, sha256(text) AS sha256, length(text) AS n_chars FROM documents")
def _(spark, sf):
    return sinks.manifest(table(spark, sf, "documents"), "doc_id", "text")


@R.add("snk04_report", "SELECT -1 AS n, chr(65279) || '# roles, checked' AS line UNION ALL SELECT 0, 'r_name,role' UNION ALL SELECT n, CASE WHEN contains(r, ',') THEN '\"' || r || '\"' ELSE r END || ',' || role FROM (SELECT row_number() OVER (ORDER BY r_regionkey) AS n, r_name || CASE WHEN r_regionkey % 2 = 0 THEN ', even' ELSE '' END AS r, 'x' || r_regionkey AS role FROM region)")
def _(spark, sf):
    """A report as it is written: BOM and comment, header, quoted fields."""
    path = shared_path(spark, "report")
    name = F.concat("r_name", F.when(F.col("r_regionkey") % 2 == 0, ", even").otherwise(""))
    rows = table(spark, sf, "region").select(name.alias("r_name"), F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("role"))
    sinks.write_report(rows, path, ["role"], "roles, checked")
    got = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("n", "line"))
    return got.select((F.col("n") - 1).cast("long").alias("n"), "line")


@R.add("snk07_worklist", "SELECT '<!DOCTYPE html><meta charset=utf-8><title>nations</title><table><tr><th>n_nationkey</th><th>n_name</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || ' &amp; &lt;co&gt;</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation")
def _(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(" & <co>")).alias("n_name"))
    return sinks.worklist_html(rows, ["n_nationkey"], "nations")


@R.add("snk02_enrich_idempotent", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    d, notes = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality")
    path = shared_path(spark, "enriched")
    sinks.replace_table(spark, sinks.enrich(d, notes, "doc_id"), path)
    once = spark.read.parquet(path)
    return sinks.enrich(once, notes, "doc_id").select("doc_id", "quality")


@R.add("snk05_append_log", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    path, e = shared_path(spark, "log"), table(spark, sf, "events").select("event_id", "event_type")
    sinks.append_log(e, path)
    sinks.append_log(e, path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("snk06_index_write", "SELECT vec_id AS id, label, len(embedding) AS dim FROM embeddings")
def _(spark, sf):
    e, path = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), shared_path(spark, "index")
    sinks.write_index(e.select("id", "embedding"), e.select("id", "label"), {"model": "given", "dim": "64"}, path)
    return spark.read.parquet(f"{path}/index").select("id", "label", F.size("embedding").cast("long").alias("dim"))


@R.add("stm01_streaming_ledger", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    e, path = table(spark, sf, "events"), shared_path(spark, "events")
    e.select("ts", "event_type", "value").write.parquet(path)
    name = "ledger_" + path[-12:]
    return ledger.batch_ledger(spark, path, "ts timestamp, event_type string, value double", name, "ts", "event_type", "value", shared_path(spark, "stream"))


@R.add("stm02_streaming_log", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    e, path, out = table(spark, sf, "events"), shared_path(spark, "events"), shared_path(spark, "out")
    e.select("event_id", "event_type").write.parquet(path)
    ledger.run_available(spark.readStream.schema("event_id long, event_type string").parquet(path), out, shared_path(spark, "stream"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("stm03_incremental_refresh", "SELECT version, count(*) AS n FROM (SELECT 0 AS version FROM documents UNION ALL SELECT 1 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY version")
def _(spark, sf):
    """The corpus, and then the corpus again with toxic texts emptied: only these are written a second time."""
    d, path, index = table(spark, sf, "documents"), shared_path(spark, "batches"), shared_path(spark, "index")
    rows = d.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("sha"))
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("").alias("gone"))
    check, schema = shared_path(spark, "stream"), "id long, sha string"
    for k, batch in enumerate((rows, rows.join(toxic, "id", "left").select("id", F.coalesce("gone", "sha").alias("sha")))):
        batch.write.mode("append").parquet(f"{path}/b{k}")
        ledger.refresh(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path), index, check)
    return spark.read.parquet(index).groupBy("version").agg(F.count("*").alias("n"))


@R.add("src04_yaml", "SELECT * FROM (VALUES ('Q1', 'yes', 'topic'), ('Q2', 'no', NULL)) t(id, answerable, type)")
def _(spark, sf):
    text = "questions:\n  - id: Q1\n    answerable: yes\n    type: topic\n  - id: Q2\n    answerable: no\n"
    return files.yaml_rows(spark, [text], "questions", "id string, answerable string, type string")
