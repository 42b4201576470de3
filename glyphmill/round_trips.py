"""Registered queries of sources and sinks: rows written to a shared folder and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .operators import corpus as C, signals as G
from .plans.report import report
from .session import shared_dir, ship
from .sources import files, sinks

CALIBRATIONS = ({"lang": "es", "model_id": "bigram", "slope": -12.0, "intercept": 11.0, "threshold_low_fpr": 0.9}, {"lang": "en", "model_id": "other", "slope": -9.0, "intercept": 8.0, "threshold_low_fpr": 0.8})


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def digest(parts) -> F.Column:
    return F.md5(F.array_join(parts, "|").cast("binary"))


def report_files(docs: DataFrame, lexicons) -> DataFrame:
    """Reports as nested JSON, and their judgements, reasons and warnings read back."""
    path = folder(docs.sparkSession)
    sinks.write_reports(report(docs, lexicons=lexicons), path)
    back = docs.sparkSession.read.schema("doc_id long, p double, verdict string, reasons array<string>, warnings array<string>").json(path)
    return back.select("doc_id", "p", "verdict", digest("reasons").alias("reasons"), digest("warnings").alias("warnings"))


def corpus_files(docs: DataFrame) -> DataFrame:
    """A corpus appended to JSON lines in two runs, the second of which has all jobs and does what is missing."""
    path = folder(docs.sparkSession)
    jobs = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), "text", (F.col("doc_id") % 2).cast("int").alias("label"), F.col("lang").alias("domain"), F.lit("m").alias("model"), F.lit("t").alias("task"), T.count_blank_words(F.col("text")).alias("words"))
    for part in (jobs.where("label = 1"), jobs):
        sinks.append_missing(part, path, ["id"], lambda rows: rows, files.CORPUS)
    return files.read_jsonl(docs.sparkSession, sinks.committed(docs.sparkSession, path)).select("id", "source_id", "label", "domain", "words", F.md5(F.col("text").cast("binary")).alias("digest"))


def split_files(docs: DataFrame) -> DataFrame:
    """A split written by part and read back."""
    path = folder(docs.sparkSession)
    sinks.write_split(C.group_split(docs, "source"), path)
    return docs.sparkSession.read.parquet(path).groupBy("split", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def score_files(scored: DataFrame) -> DataFrame:
    """Scores as CSV without texts, and read back."""
    path = folder(scored.sparkSession)
    sinks.write_scores(scored.select(F.col("doc_id").alias("id"), F.lit("a, text").alias("text"), F.col("p").alias("score"), "lang"), path)
    return files.read_scores(scored.sparkSession, path)


def reject_files(docs: DataFrame) -> DataFrame:
    """Rejected texts with their reasons, and read back."""
    path = folder(docs.sparkSession)
    _, rejected = C.split_rejects(docs.select("doc_id", "text"), "text")
    sinks.write_rejects(rejected, path)
    return docs.sparkSession.read.schema("doc_id long, reason string").json(path)


def artefact_files(docs: DataFrame) -> DataFrame:
    """Calibrations as JSON documents, loaded and applied by language."""
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    for value in CALIBRATIONS:
        sinks.write_artefact(spark, value, f"{path}/{value['lang']}")
    found = files.load_artefacts(spark, [f"{path}/{v['lang']}" for v in CALIBRATIONS], "lang string, model_id string, slope double, intercept double, threshold_low_fpr double")
    return G.calibrations(docs.select("doc_id", "lang"), found, "bigram")


def table_files(docs: DataFrame) -> DataFrame:
    """Labelled texts as tab-separated values, quoted, and read back."""
    path = folder(docs.sparkSession)
    label = F.when(F.col("doc_id") % 3 == 0, "generated").otherwise("human")
    docs.select(F.col("doc_id").alias("id"), "text", label.alias("label"), F.col("lang").alias("domain")).write.csv(path, sep="\t", header=True, quoteAll=True, escape='"')
    return files.read_labelled_tsv(docs.sparkSession, path).select("id", "label", "domain", F.md5(F.col("text").cast("binary")).alias("digest"))


def text_files(docs: DataFrame) -> DataFrame:
    """A text file for each source and one of a kind that is not read, all read back."""
    path = folder(docs.sparkSession)
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(f"{path}/texts")
    docs.select("doc_id").coalesce(1).write.csv(f"{path}/tables")
    back = files.read_files(docs.sparkSession, path, max_bytes=1 << 30)
    return back.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"), "error")


W_NS = files.W_NS[1:-1]


def _docx(paragraphs: list[str]) -> bytes:
    """A document of paragraphs, a table that no one reads, a bibliography entry, and a citation in a content control."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    own = "".join(f"<w:p>{run(t[: len(t) // 2])}{run(t[len(t) // 2 :])}</w:p>" for t in paragraphs)
    rest = f"<w:tbl><w:tr><w:tc><w:p>{run('celda')}</w:p></w:tc></w:tr></w:tbl><w:p>{run('Ruiz, A. B. (2020). Título.')}</w:p><w:p>{run('Cita')}<w:sdt><w:sdtContent>{run(' (Ruiz)')}</w:sdtContent></w:sdt></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W_NS}"><w:body>{own}{rest}</w:body></w:document>')
    return out.getvalue()


def _written(rows: DataFrame, path: str, pack) -> int:
    """How many files pack(frame), pairs of name and bytes one by one, made of the rows in each batch; they go to the folder from the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for frame in frames:
            n = 0
            for name, raw in pack(frame):
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(raw)
                n += 1
            yield pd.DataFrame({"n": [n]})

    ship(rows.sparkSession)
    return rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def docx_files(docs: DataFrame) -> DataFrame:
    """A word processor's file for each document, read back: paragraphs without tables and bibliography entries."""
    path = folder(docs.sparkSession)
    _written(docs.select("doc_id", "text"), path, lambda frame: ((f"{i}.docx", _docx(t.split("\n\n"))) for i, t in zip(frame["doc_id"], frame["text"], strict=True)))
    back = files.read_files(docs.sparkSession, path)
    return back.select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("doc_id"), F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"), "error")


def _zipped(frame: pd.DataFrame) -> list[tuple[str, bytes]]:
    """One archive of rows: a table of texts in two members, and a member elsewhere."""
    out, half = io.BytesIO(), len(frame) // 2
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("data/csv/a.csv", frame[:half]), ("data/csv/b.csv", frame[half:].drop(columns="lang")), ("data/other.csv", frame)):
            z.writestr(name, part.to_csv(index=False))
    return [(f"{uuid.uuid4().hex}.zip", out.getvalue())]


def _archives(frame: pd.DataFrame, most: int = 4 << 20) -> Iterator[tuple[str, bytes]]:
    """Archives of about `most` characters of text each, one by one."""
    part = frame["essay"].str.len().fillna(0).cumsum() // most
    for _, own in frame.groupby(part.astype(int), sort=True):
        yield from _zipped(own)


def zip_files(docs: DataFrame) -> DataFrame:
    """Archives of tables, some without a column, read back; rows without a text go."""
    path = folder(docs.sparkSession)
    _written(docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("essay"), "lang"), path, _archives)
    back = files.zipped_csv(docs.sparkSession, path, ["id", "essay", "lang", "home"], required="essay")
    return back.select(F.col("id").cast("long").alias("doc_id"), F.md5(F.col("essay").cast("binary")).alias("digest"), "home")


def works(docs: DataFrame) -> DataFrame:
    """Documents as works with an inverted index of their words, as a search service gives them, turned into sources."""
    abstract = F.concat(F.lit("Resumen: Un &lt;b&gt; <i>texto</i> Abstract "), "text", F.lit(" Keywords a, b"))
    index = T.index_words(abstract)
    rows = docs.select(F.concat(F.lit("id:"), "doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doi:"), "doc_id")).alias("doi"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("title"), F.when(F.length("text") > 0, index).alias("abstract_inverted_index"))
    return files.indexed_works(rows).select("url", "title", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))
