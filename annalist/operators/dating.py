"""Dating of segments: anchors, headings, overrides and interpolation.

Segments are rows with a document ``doc_id`` and an order ``pos``; windows never leave a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.plans.scan import known_around


def _so_far():
    """A document's rows up to the current one."""
    return Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def heading_year(text: Column) -> Column:
    """Year that is all of a heading, else null."""
    return T.empty_as_null(F.regexp_extract(text, T.YEAR_ONLY, 1)).cast("int")


def detect_anchors(text: Column) -> Column:
    """All anchors: years left after life dates and the like are cut, then decades, then named events."""
    kind = "struct<type:string,value:int,span:string>"
    exact = F.transform(T.exact_years(text), lambda y: F.struct(F.lit("exact").alias("type"), y.alias("value"), y.cast("string").alias("span")).cast(kind))
    decade = F.transform(T.decade_spans(text), lambda s: F.struct(F.lit("decade").alias("type"), F.lit(None).cast("int").alias("value"), s.alias("span")).cast(kind))
    event = F.transform(T.event_anchors(text), lambda e: F.struct(F.lit("event").alias("type"), e["year"].alias("value"), e["label"].alias("span")).cast(kind))
    return F.concat(exact, decade, event)


def date_press(segments: DataFrame) -> DataFrame:
    """Press articles: the last year heading dates what follows, else the row's own date does; headings are dropped.

    Other headings change nothing, years in the body are ignored. Adds ``time_from``, ``time_to``, ``precision``.
    """
    head = F.last(F.when(F.col("type") == "heading", heading_year(F.col("text"))), ignorenulls=True).over(_so_far())
    own = T.date_field_year(F.col("date"))
    year = F.coalesce("_head", own)
    dated = segments.withColumn("_head", head).withColumn("time_from", year).withColumn("time_to", year)
    precision = F.when(F.col("_head").isNotNull(), "heading").when(own.isNotNull(), "exact")
    return dated.withColumn("precision", precision).filter("type <> 'heading'").drop("_head")


def date_notes(segments: DataFrame) -> DataFrame:
    """Reading notes: years in the text, else events, else a decade without a year, else the last heading's year.

    A heading without a year ends the reach of the one before; headings are dropped. Adds ``anchors``, ``time_from``,
    ``time_to``, ``precision`` (``exact`` for an inherited heading).
    """
    heading = F.col("type") == "heading"
    found = segments.withColumn("anchors", F.when(~heading, detect_anchors(F.col("text"))))  # before rows are shuffled, which texts then need not be
    head = F.last(F.when(heading, F.struct(heading_year(F.col("text")).alias("y"))), ignorenulls=True).over(_so_far())
    rows = found.withColumn("_head", head["y"]).filter(~heading)
    of = lambda kind: F.transform(F.filter("anchors", lambda a: a["type"] == kind), lambda a: a["value"])
    exact, event, decade = of("exact"), of("event"), F.exists("anchors", lambda a: a["type"] == "decade")
    has_exact, has_event, inherits = F.size(exact) > 0, F.size(event) > 0, F.col("_head").isNotNull()
    bound = lambda f: F.when(has_exact, f(exact)).when(has_event, f(event)).when(~decade & inherits, F.col("_head"))
    precision = F.when(has_exact, "exact").when(has_event, "event").when(decade, "decade").when(inherits, "exact")
    return rows.withColumns({"time_from": bound(F.array_min), "time_to": bound(F.array_max), "precision": precision}).drop("_head")


def apply_overrides(segments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual corrections by ``segment_id``: ``set_anchor`` sets times (and text if given), ``undatable`` clears them.

    Of several overrides for a segment the one with the largest ``ord`` counts. Adds ``undatable``.
    """
    last = overrides.groupBy("segment_id").agg(F.max_by(F.struct("action", F.col("time_from").alias("tf"), F.col("time_to").alias("tt"), F.col("text").alias("tx")), "ord").alias("o"))
    s = segments.join(last, "segment_id", "left")
    is_set, is_out = F.coalesce(F.col("o.action") == "set_anchor", F.lit(False)), F.coalesce(F.col("o.action") == "undatable", F.lit(False))
    new = lambda old, field: F.when(is_set, F.col(f"o.{field}")).when(~is_out, F.col(old))
    return s.withColumns(
        {
            "time_from": new("time_from", "tf"), "time_to": new("time_to", "tt"), "precision": F.when(is_set, "manual").when(~is_out, F.col("precision")),
            "text": F.when(is_set, F.coalesce(F.col("o.tx"), F.col("text"))).otherwise(F.col("text")), "undatable": is_out,
        }
    ).drop("o")


def interpolate(segments: DataFrame, source: str = "source", spread: bool = False) -> DataFrame:
    """Date undated rows from dated neighbours of the same source and document.

    Between two dated rows the span from the earlier to the later one's year, after the last one its year, before the first
    nothing. Rows dated by a decade only have no year and give none. Rows flagged ``undatable`` (if there is such a column)
    neither receive nor provide; the flag is removed. ``spread`` is for documents that a task can't sort: their rows are dealt out by
    ranges, at the price of a written table.
    """
    rows = segments if "undatable" in segments.columns else segments.withColumn("undatable", F.lit(False))
    year = F.when(~F.col("undatable"), T.representative_year(F.col("time_from"), F.col("time_to")))
    rows = rows.withColumn("_y", year).withColumn("_in", F.coalesce(F.col(source), F.lit("")))
    if spread:
        rows = known_around(rows, ["doc_id", "_in"], ["pos"], F.col("_y"), "_prev", "_next")
    else:
        w = Window.partitionBy("doc_id", "_in").orderBy("pos")
        rows = rows.withColumns(
            {
                "_prev": F.last("_y", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                "_next": F.first("_y", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
            }
        )
    fill = F.col("_y").isNull() & ~F.col("undatable") & F.col("_prev").isNotNull()
    return rows.withColumns(
        {
            "time_from": F.when(fill, F.col("_prev")).otherwise(F.col("time_from")),
            "time_to": F.when(fill, F.coalesce("_next", "_prev")).otherwise(F.col("time_to")),
            "precision": F.when(fill, "interpolated").otherwise(F.col("precision")),
        }
    ).drop("_y", "_in", "_prev", "_next", "undatable")


def interpolate_by_type(segments: DataFrame, doc_type: str = "doc_type") -> DataFrame:
    """Interpolate all but press articles, which keep what they have."""
    press = F.coalesce(F.col(doc_type) == "presseartikel", F.lit(False))
    cols = segments.columns
    return interpolate(segments.filter(~press)).select(*cols).unionByName(segments.filter(press))


def live_override(segments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Corrections laid over dated rows for display, without dating anything anew."""
    return apply_overrides(segments, overrides).drop("undatable")
