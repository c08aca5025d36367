"""Inputs of the registered queries, derived from the driver's tables.

The expressions below are read by Spark and by DuckDB alike. Documents are cut into lines; as none of them holds dates,
citations or pages, such phrases are added by arithmetic on ``doc_id`` and ``pos``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.plans.tables import dealt_out, table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    """Queries of a section and their SQL."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register a query function under its name."""

        def put(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return put


SEGMENT_COLUMNS = {
    "type": "CASE WHEN pos % 7 = 0 THEN 'heading' ELSE 'content' END",
    "text": """CASE
        WHEN pos % 7 = 0 AND (doc_id + pos) % 3 > 0 THEN CAST(1900 + (doc_id * 7 + pos) % 120 AS STRING)
        WHEN pos % 7 = 0 THEN 'Kapitel ' || CAST(pos AS STRING)
        WHEN (doc_id * 31 + pos) % 13 = 0 THEN line || ' Im Jahr ' || CAST(1800 + (doc_id * 3 + pos) % 220 AS STRING) || ' begann es.'
        WHEN (doc_id * 31 + pos) % 13 = 1 THEN line || ' Von 1850 bis ' || CAST(1860 + pos % 90 AS STRING) || ' (1820–1880) (d1827) (1700-1899)'
        WHEN (doc_id * 31 + pos) % 13 = 2 THEN line || ' Im frühen 19. Jahrhundert und die 1890er Jahre'
        WHEN (doc_id * 31 + pos) % 13 = 3 THEN line || ' Die Jungtürkenrevolution und der Balkankrieg'
        WHEN (doc_id * 31 + pos) % 13 = 4 THEN line || ' BZ, 01.02.' || CAST(1980 + pos % 30 AS STRING) || ' und Taz, 3.12.89)'
        WHEN (doc_id * 31 + pos) % 13 = 5 THEN '„' || line || '” ' || CAST(pos % 400 AS STRING)
        WHEN (doc_id * 31 + pos) % 13 = 6 THEN line || ' ' || CAST(1 + pos % 300 AS STRING)
        WHEN (doc_id * 31 + pos) % 13 = 7 THEN 'Meyer : Ein Titel (1984) gelesen'
        WHEN (doc_id * 31 + pos) % 13 = 8 THEN line || ' [[Name ' || CAST(pos AS STRING) || '|Alias]] und [[Solo]]'
        ELSE line END""",
    "date": """CASE (doc_id + pos) % 6 WHEN 0 THEN '2005-03-' || CAST(10 + pos % 18 AS STRING) WHEN 1 THEN '1999' WHEN 2 THEN '2024-11' WHEN 3 THEN '' WHEN 4 THEN 'Frühjahr' ELSE NULL END""",
    "category": "CASE WHEN (doc_id + pos) % 17 = 0 THEN NULL WHEN (doc_id + pos) % 5 = 0 THEN 'Politik' WHEN (doc_id + pos) % 5 = 1 THEN 'Außenpolitik-Entscheidung' WHEN (doc_id + pos) % 5 = 2 THEN 'kultur' WHEN (doc_id + pos) % 5 = 3 THEN 'Anderes' ELSE 'Wirtschaft' END",
    "confidence": "CASE (doc_id * 3 + pos) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE NULL END",
}
CATEGORIES = ("Politik", "Außenpolitik", "Kultur", "Wirtschaft", "Anderes")

LINES_SQL = "SELECT doc_id, lang, source, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)"
SEGMENTS_SQL = f"SELECT doc_id, lang, source, pos, line, {', '.join(f'{e} AS {n}' for n, e in SEGMENT_COLUMNS.items())} FROM ({LINES_SQL})"


def with_segments(body: str) -> str:
    """SQL over the relation ``seg``."""
    return f"WITH seg AS ({SEGMENTS_SQL}) {body}"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as dated, classified segments: one row per line, in document order by ``pos``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = docs.withColumn("pos", F.col("pos").cast("long"))
    return lines.select("doc_id", "lang", "source", "pos", "line", *[F.expr(e).alias(n) for n, e in SEGMENT_COLUMNS.items()])


#: Years of segments: a little under half are dated.
DATED_COLUMNS = {
    "time_from": "CASE WHEN (doc_id * 5 + pos) % 3 = 0 THEN 1900 + (doc_id * 7 + pos * 3) % 100 END",
    "time_to": "CASE WHEN (doc_id * 5 + pos) % 6 = 0 THEN 1900 + (doc_id * 7 + pos * 3) % 100 + pos % 9 END",
    "precision": "CASE WHEN (doc_id * 5 + pos) % 3 = 0 THEN (CASE (doc_id + pos) % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'heading' WHEN 2 THEN 'event' WHEN 3 THEN 'decade' ELSE 'interpolated' END) END",
}
DATED_SQL = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in DATED_COLUMNS.items())} FROM ({SEGMENTS_SQL})"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with ``time_from``, ``time_to`` and ``precision``."""
    s = segments(spark, sf_dir)
    return s.select("*", *[F.expr(e).cast("string" if n == "precision" else "int").alias(n) for n, e in DATED_COLUMNS.items()])


def with_dated(body: str) -> str:
    """SQL over the relation ``dat``."""
    return f"WITH dat AS ({DATED_SQL}) {body}"


#: Actors of an order are its parts: entries with several actors, at the scale of lineitem.
ENTRIES_SQL = """SELECT l_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS event_type, 'p' || CAST(l_partkey % 400 AS STRING) AS actor, l_linenumber AS i
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def actor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry and actor, with the actor's place ``i``."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("l_partkey") % 400).cast("string")).alias("actor"), F.col("l_linenumber").alias("i"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("event_type"))
    n = li.count()  # entries' and actors' rows meet, and are grouped by entry, in parts of the same size at any size of the tables
    return dealt_out(li, "id", n=n).join(dealt_out(o, "id", n=n), "id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("label"))


VECTORS_SQL = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
