"""DOCX files as paragraphs and as segments."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.sources.stores import binary_files

_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Top-level headings that organise a file of notes and name no source.
ORGANIZERS = ("Notizen", "Übertrag von Zeitschriften")


def paragraphs_of(content: bytes) -> list[tuple[str, str]]:
    """Style and text of each paragraph of a DOCX file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_NS}p"):
        style = p.find(f"{_NS}pPr/{_NS}pStyle")
        out.append(("" if style is None else style.get(f"{_NS}val", ""), "".join(t.text or "" for t in p.iter(f"{_NS}t"))))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of all DOCX files below ``path``: ``doc_id`` (file name), ``pos``, ``style``, ``text`` (trimmed, not empty)."""
    return parse_docx(binary_files(spark, path, "*.docx"))


def parse_docx(files: DataFrame) -> DataFrame:
    """Paragraphs of DOCX files (``path``, ``content``): ``doc_id`` (file name), ``pos``, ``style``, ``text`` (trimmed, not empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ps = [(i, s, t.strip()) for i, (s, t) in enumerate(paragraphs_of(content.as_py())) if t.strip()]
                yield pa.RecordBatch.from_pylist([{"doc_id": name, "pos": i, "style": s, "text": t} for i, s, t in ps], pa.schema([("doc_id", pa.string()), ("pos", pa.int64()), ("style", pa.string()), ("text", pa.string())]))

    name = F.regexp_extract("path", r"([^/]+)\.docx$", 1)
    return files.select(name.alias("doc_id"), "content").mapInArrow(run, "doc_id string, pos long, style string, text string")


def notes_segments(paragraphs: DataFrame) -> DataFrame:
    """Segments of reading notes from paragraphs (``doc_id``, ``pos``, ``style``, ``text``).

    A top-level heading that organises becomes a ``meta`` row of level 1 and opens a list of literature, whose lines are
    ``bibliography`` of level 2; any other heading of level 1 or 2 names the source of what follows, ``content`` of level 3
    with its page cut off (or ``bibliography`` where a line looks like it). Headings that name a source give no row.
    """
    c = F.col
    level = F.when(c("style").rlike("(?i)^(heading|berschrift|überschrift) ?1$"), 1).when(c("style").rlike("(?i)^(heading|berschrift|überschrift) ?2$"), 2)
    rows = paragraphs.withColumn("_h", level)
    organizes = (c("_h") == 1) & c("text").isin(*ORGANIZERS)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(c("_h").isNotNull(), F.struct(F.coalesce(organizes, F.lit(False)).alias("list"), F.when(~F.coalesce(organizes, F.lit(False)), c("text")).alias("source"))), ignorenulls=True).over(w)
    rows = rows.withColumn("_s", state).filter(c("_h").isNull() | F.coalesce(organizes, F.lit(False)))
    meta, listed = c("_h").isNotNull(), F.coalesce(c("_s.list"), F.lit(False))
    kind = F.when(meta, "meta").when(listed | T.is_bibliography(c("text")), "bibliography").otherwise("content")
    out = rows.select(
        "doc_id", "pos", F.when(meta, 1).when(listed, 2).otherwise(3).alias("level"), kind.alias("type"), c("_s.source").alias("source"),
        F.when(~meta, T.page_number(c("text"))).alias("page"), F.when(meta, c("text")).otherwise(T.without_page(c("text"))).alias("text"),
    )
    return out.withColumn("segment_id", T.segment_id(F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))))


def press_segments(paragraphs: DataFrame, ascii_bounds: bool = False) -> DataFrame:
    """Segments of a press chronicle: short runs of digits are ``heading``, all else ``content`` with its citations (for ``ascii_bounds`` see there)."""
    c = F.col
    head = T.is_year_heading(c("text"))
    out = paragraphs.select(
        "doc_id", "pos", F.when(head, "heading").otherwise("content").alias("type"), "text", F.when(~head, T.citation_names(c("text"), ascii_bounds)).alias("source"),
        F.when(~head, T.citation_dates(c("text"), ascii_bounds)).alias("source_date"), F.when(~head, T.is_quote(c("text"))).alias("is_quote"), F.lit("docx").alias("ingest_source"),
    )
    return out.withColumn("segment_id", T.segment_id(F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))))


def year_frame(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with the year of the last heading and their number within it."""
    head = T.is_year_heading(F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    year = F.last(F.when(head, F.trim("text").cast("int")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = paragraphs.withColumn("year", year).filter(~head)
    return rows.withColumn("section", F.row_number().over(Window.partitionBy("doc_id", "year").orderBy("pos")))
