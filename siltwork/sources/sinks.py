"""Writers: JSONL without private columns, staged enrichment, manifests, reports, logs, index tables; and the gate that runs stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def public(df: DataFrame) -> DataFrame:
    """Columns whose names begin with _ stay inside."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    public(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def enrich(chunks: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Chunks with the notes' columns, which replace those of the same name: running it again changes nothing."""
    new = [c for c in notes.columns if c != key]
    return chunks.drop(*new).join(notes, key, "left")


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Staged write: the new table is whole before it takes the old one's place, and the old one goes last.

    After a failure between the two renames the old table is at ``path`` + .old; the next call puts it back first.
    """
    staged, old = f"{path}.staged", f"{path}.old"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(a: str, b: str) -> None:
        if not fs.rename(hadoop(a), hadoop(b)):
            raise OSError(f"{a} could not become {b}")

    if fs.exists(hadoop(old)):
        if fs.exists(hadoop(path)):
            fs.delete(hadoop(old), True)
        else:
            move(old, path)
    df.write.mode("overwrite").parquet(staged)
    if fs.exists(hadoop(path)):
        move(path, old)
    move(staged, path)
    fs.delete(hadoop(old), True)


def manifest(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(id, sha256, n_chars) by id: digests of the stored text, no text."""
    return chunks.select(F.col(key).alias("id"), F.sha2(F.col(text), 256).alias("sha256"), F.length(text).alias("n_chars")).orderBy("id")


#: What marks a text file as UTF-8 for spreadsheets.
BOM = "\ufeff"


def report_lines(df: DataFrame, order: list[str], comment: str | None = None) -> DataFrame:
    """(n, line) of a report: BOM and comment line, then the header, then a CSV line for each row in order."""
    names = df.columns
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    body = F.concat_ws(",", *(quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names))
    head = ([f"# {comment}"] if comment else []) + [",".join(names)]
    head[0] = BOM + head[0]
    top = df.sparkSession.createDataFrame([(i - len(head) + 1, h) for i, h in enumerate(head)], "n long, line string")
    w = Window.orderBy(*order)
    return top.unionByName(df.select(F.row_number().over(w).cast("long").alias("n"), body.alias("line")))


def write_report(df: DataFrame, path: str, order: list[str], comment: str | None = None) -> None:
    """One file for a reader: a report is a small table, so one task sorts and writes it."""
    report_lines(df, order, comment).orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(path)


def worklist_html(df: DataFrame, order: list[str], title: str) -> DataFrame:
    """One row (html): a page with a table of the rows in order, their text escaped. A worklist is a small table."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(*(F.concat(F.lit("<td>"), safe(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns))
    rows = F.array_sort(F.collect_list(F.struct(*order, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("tr"))))
    head = "".join(f"<th>{c}</th>" for c in df.columns)
    page = F.concat(F.lit(f"<!DOCTYPE html><meta charset=utf-8><title>{title}</title><table><tr>{head}</tr>"), F.array_join(F.transform(rows, lambda x: x["tr"]), ""), F.lit("</table>"))
    return df.agg(page.alias("html"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_index(vectors: DataFrame, meta: DataFrame, config: dict[str, str], path: str) -> None:
    """Vectors and their metadata in one table, settings in another of one row."""
    vectors.join(meta, "id").write.mode("overwrite").parquet(f"{path}/index")
    vectors.sparkSession.createDataFrame([(config,)], "config map<string,string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


class GateFailed(RuntimeError):
    pass


def gate(stages: list[tuple[str, Callable[[], DataFrame]]]) -> list[str]:
    """Runs checks one after another; each must give no rows. The first that does stops all."""
    done = []
    for name, check in stages:
        if bad := check().take(1):
            raise GateFailed(f"{name}: {bad[0]}")
        done.append(name)
    return done
