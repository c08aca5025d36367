"""Markdown articles with front matter, reference manager items, JSON stages and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from annalist.functions import text as T
from annalist.functions.pages import main_page_text

#: Full schema of segments; readers fill in what a source lacks.
SEGMENT = (
    "segment_id string, doc_id string, pos long, level int, type string, source string, text string, page int, doc_type string, source_date string, is_quote boolean, ingest_source string, "
    "date string, url string, author string, abstract string, obsidian_path string, zotero_key string, item_type string"
)


def full_segments(df: DataFrame) -> DataFrame:
    """``df`` with all columns of :data:`SEGMENT`, null where it lacks one, others dropped."""
    fields = [f.strip().rsplit(" ", 1) for f in SEGMENT.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def read_vault(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """All Markdown files below ``path``, each whole: ``path``, ``text``."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pack_vault(files: DataFrame, path: str) -> None:
    """Add articles (``path``, ``text``) to a packed vault below ``path``: Parquet files that hold many articles each.

    A file of its own for each article costs its opening and listing many times over, and as many files as articles are more than a
    shared folder takes.
    """
    files.select("path", "text").write.mode("append").parquet(path)


def read_packed_vault(spark: SparkSession, path: str) -> DataFrame:
    """All articles of a packed vault: ``path``, ``text``."""
    return spark.read.schema("path string, text string").parquet(path, recursiveFileLookup=True)


def frontmatter(text: Column) -> Column:
    """Header lines between two ``---``, without them; null if there are none."""
    return T.empty_as_null(F.regexp_extract(text, r"(?s)^---(.*?)\n---", 1))


def body(text: Column) -> Column:
    """What follows the header."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)^---.*?\n---", ""), r"^\s+", "")


def header_field(header: Column, name: str) -> Column:
    """A flat field of the header, quotes stripped; the items of a one-level list joined by commas; null if absent or empty."""
    value = F.trim(F.regexp_extract(header, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    items = F.regexp_extract(F.concat(header, F.lit("\n")), rf"(?m)^{name}:[ \t]*\n((?:[ \t]*- .*\n)+)", 1)
    joined = F.array_join(F.transform(F.regexp_extract_all(items, F.lit(r"- +(.*)"), F.lit(1)), lambda x: F.regexp_replace(x, r'^["\']|["\']$', "")), ", ")
    return T.empty_as_null(F.coalesce(T.empty_as_null(F.regexp_replace(value, r'^["\']|["\']$', "")), joined))


def article_segments(files: DataFrame, doc_type: str = "presseartikel") -> DataFrame:
    """One ``content`` segment per article (``path``, ``text``): title or file name as source, url, date, author, abstract."""
    h = files.withColumn("_h", F.coalesce(frontmatter(F.col("text")), F.lit("")))
    f = lambda n: header_field(F.col("_h"), n)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    return h.select(
        "path", F.lit("content").alias("type"), F.coalesce(f("title"), stem).alias("source"), F.trim(body(F.col("text"))).alias("text"), F.lit(doc_type).alias("doc_type"),
        T.frontmatter_date(f("published"), f("created")).alias("date"), F.coalesce(f("source"), F.lit("")).alias("url"), F.coalesce(T.clean_links(f("author")), F.lit("")).alias("author"),
        F.coalesce(f("description"), F.lit("")).alias("abstract"), F.lit("obsidian").alias("ingest_source"),
    )


def snapshot_texts(items: DataFrame) -> DataFrame:
    """Reference manager items with ``html_text``, the main text of their stored page (``html``) without tables and comments."""
    return items.withColumn("html_text", main_page_text(F.col("html"))).drop("html")


def reference_segments(items: DataFrame) -> DataFrame:
    """Segments of reference manager items; attachments and notes are no items.

    The text is that of the stored page, else of the url, else the abstract; an item without any is left out.
    """
    c = F.col
    text = F.coalesce(*[T.empty_as_null(F.trim(c(n))) for n in ("html_text", "url_text", "abstract")])
    kept = items.filter(~c("item_type").isin("attachment", "note")).withColumn("text", text).filter("text IS NOT NULL")
    return kept.select("key", "item_type", c("title").alias("source"), "text", T.csl_date(c("issued_year"), c("date")).alias("date"), F.coalesce("url", F.lit("")).alias("url"), F.lit("content").alias("type"), F.lit("zotero").alias("ingest_source"))


def read_json_stage(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """A JSON array file of a stage under an explicit schema; what cannot be read is null, a missing folder is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """A stage as JSON lines. The committer renames finished files, so readers never see half of one."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, key: str | None = None) -> None:
    """A stage as Parquet; with ``key``, files are dealt out by it."""
    (df.repartition(key) if key else df).write.mode("overwrite").parquet(path)


def missing_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts without a cached vector, by a hash of the text and not by row number."""
    keyed = texts.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def new_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose base name is not among the done ones, so that moved files are not read again."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    return files.join(done.select(base("path").alias("_b")).distinct(), base(files["path"]) == F.col("_b"), "left_anti")
