"""Scalar text and date functions as Column expressions.

All take and return Columns, stay inside generated JVM code, and give null for a null input unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns, word lists and tables whose content decides results. ---

PAGE = r"[\s)]+(\d{1,3})$"
BIBLIOGRAPHY = (
    r"^[A-Z][a-z].{0,40}\s:\s[A-Z]",
    r'^["\u201c\u201e\u201a„(]',
    r"\d:\s*[A-Za-z]{2}\s+\d+",
    r"\(\d{4}\)",
    r"(?i)\b(fernleihe|gelesen|nicht gefunden)\b",
)
YEAR_HEADING = r"^\d[\d\s]{0,8}$"
# A bound of words that knows ASCII letters only, and the same blanks, as in SQL's patterns.
ASCII_BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
CITATION = r"(?U)\b([A-Za-zÄÖÜäöüß/.-]{2,20}),\s*(\d{1,2}\.\d{1,2}\.\d{2,4})\)?"
QUOTES = ("”", "„", "‚", "“", "'", '"')
YEAR_ONLY = r"^\s*(1[6-9]\d{2}|20[0-2]\d)\s*$"
YEAR = r"(?<![0-9])(1[6-9][0-9]{2}|20[0-2][0-9])(?![0-9])"
DEATH_YEAR = r"\(\s*[dD]\.?\s*(1[7-9]\d{2})\s*\)"
YEAR_IN_PARENTHESES = r"\(\s*(?:1[6-9]\d{2}|20[0-2]\d)\s*\)"
LIFE_DATES = r"\(\s*(1[7-9]\d{2})\s*\??\s*[–—\-]+\s*(1[7-9]\d{2})\s*\??\s*\)"
LIFE_SPAN = 120
DECADES = (
    r"\b1[6-9]\d0er(?:\s+Jahre)?\b",
    r"(?i)\b(?:frühen?|Mitte|Ende|späten?)\s+1[6-9]\. Jahrhundert\b",
    r"(?i)\b(?:early|mid|late)\s+\d{2}(?:th|st|nd|rd)\s+century\b",
    r"(?i)\b(?:early|mid|late)\s+nineteenth\s+century\b",
    r"(?i)\b(?:frühen?|Mitte|Ende)\s+des\s+\d{2}\.\s*Jahrhunderts?\b",
    r"\bJahrhundert(?:wende)?\b",
    r"\b\d{2}\.\s*Jh\.\b",
)
EVENTS = (
    (r"\bTanzimat\b", "Tanzimat", 1839),
    (r"\bGülhane\b", "Hatt-ı Şerif von Gülhane", 1839),
    (r"\bJungtürk", "Jungtürkenrevolution", 1908),
    (r"\bYoung Turk", "Young Turk Revolution", 1908),
    (r"\bRevolution 1908\b", "Revolution 1908", 1908),
    (r"\bGegenputsch\b", "Gegenputsch 1909", 1909),
    (r"\bKonterrev", "Konterrevolution 1909", 1909),
    (r"\bcounter.?rev", "Counter-Revolution 1909", 1909),
    (r"\bWK\s*1\b|\bWKI\b", "Erster Weltkrieg", 1914),
    (r"\bErster\s+Weltkrieg\b", "Erster Weltkrieg", 1914),
    (r"\bWorld War\s+I\b", "World War I", 1914),
    (r"\bpre.?World War\b", "pre-World War I", 1914),
    (r"\bBalkankrieg\b", "Balkankrieg", 1912),
    (r"\bBalkan War\b", "Balkan War", 1912),
    (r"\bLibyen(?:krieg)?\b", "Libyen/Tripolitanien", 1911),
    (r"\bTripolit", "Tripolit. Krieg", 1911),
)
# What a text with such a mention holds in lower case; and signs that patterns, but not lower case, take for others.
DECADE_PARTS = ("0er", "jahrhundert", "century", "jh.")
EVENT_PARTS = ("tanzimat", "gülhane", "jungtürk", "young turk", "revolution 1908", "gegenputsch", "konterrev", "counter", "wk", "erster", "world war", "balkan", "libyen", "tripolit")
ODD_CASE = ("ſ", "ı", "İ", "\u212a")
DATE_PRECISION = {"exact": "exact", "heading": "exact", "manual": "exact", "interpolated": "year", "decade": "year", "event": "year"}
CATEGORY_COLOURS = ("#3b82f6", "#f59e0b", "#10b981", "#8b5cf6", "#ef4444", "#06b6d4", "#f97316", "#6366f1", "#14b8a6", "#a855f7")
NODE_COLOURS = ("#60a5fa", "#fbbf24", "#34d399", "#c084fc", "#f87171", "#6ee7b7")
UNKNOWN_CATEGORY = "(unbekannt)"
UNDATED = "undatiert"
#: Stop words of questions, as the chat endpoint of the main server has them.
STOP_WORDS_CHAT = tuple(
    """aber alle allem allen aller alles also als am an auch auf aus bei beim bin bis bitte da damit dann dass dem den denn der des die dies
    dieser dieses doch dort durch ein eine einem einen einer eines er es etwa gibt haben hatte hier ihm ihn ihnen ihr ihre im immer ist kann kein
    keine mal man mehr mich mir mit nach nicht noch nun nur oder ohne sehr sein sich sie sind soll sowie über um und unter uns vom von vor war
    waren warum was weil wenn wer werden wie wird wir wann worden wurde wurden zu zum zur zwischen""".split()
)
#: The same for the separate question server and for the search box; they differ in a few words.
STOP_WORDS_SERVER = (*STOP_WORDS_CHAT, "dessen", "euch", "euer", "woher", "wohin", "womit", "worüber", "worum", "wobei", "wäre", "würde", "ziel")
STOP_WORDS_SEARCH = (*(w for w in STOP_WORDS_CHAT if w != "wann"), "dessen", "euch", "euer", "wäre", "würde", "ziel")


def _first(*found: Column) -> Column:
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def empty_as_null(c: Column) -> Column:
    """Null for the empty string: absent and empty are the same to most rules here."""
    return F.nullif(c, F.lit(""))


def page_number(text: Column) -> Column:
    """Page that ends the text: one to three digits after a blank or a closing parenthesis."""
    return empty_as_null(F.regexp_extract(text, PAGE, 1)).cast("int")


def without_page(text: Column) -> Column:
    """Text without that page."""
    return F.when(page_number(text).isNotNull(), F.regexp_replace(F.regexp_replace(text, PAGE, ""), r"\s+$", "")).otherwise(text)


def is_bibliography(text: Column) -> Column:
    """Whether any sign of a bibliographic entry is there."""
    return _first(*[text.rlike(p) for p in BIBLIOGRAPHY])


def is_year_heading(text: Column) -> Column:
    """Fewer than ten characters, digits and blanks only."""
    return (F.length(text) < 10) & text.rlike(YEAR_HEADING)


def _citations(text: Column, group: int, ascii_bounds: bool) -> Column:
    pattern = CITATION.replace("(?U)\\b", ASCII_BOUND).replace(r"\s", r"[\t\n\f\r ]") if ascii_bounds else CITATION
    return empty_as_null(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), ";"))


def citation_names(text: Column, ascii_bounds: bool = False) -> Column:
    """Names of all ``NAME, D.M.Y`` citations joined by semicolons; null if there is none.

    A name begins at a bound of words. With ``ascii_bounds`` letters beyond ASCII are no part of a word there, as in SQL's patterns.
    """
    return _citations(text, 1, ascii_bounds)


def citation_dates(text: Column, ascii_bounds: bool = False) -> Column:
    """Dates of these citations."""
    return _citations(text, 2, ascii_bounds)


def is_quote(text: Column) -> Column:
    """Whether the text begins with a quotation mark."""
    return F.substring(text, 1, 1).isin(*QUOTES)


def segment_id(n: Column) -> Column:
    """``s0001`` for 1."""
    return F.concat(F.lit("s"), F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))


def clean_links(text: Column) -> Column:
    """``[[Name|Alias]]`` and ``[[Name]]`` become ``Name``."""
    return F.regexp_replace(text, r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1")


def frontmatter_date(published: Column, created: Column) -> Column:
    """The first of two fields that is a date (cut to the day) or a bare year."""

    def one(c: Column) -> Column:
        t = F.trim(c)
        return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(t, 1, 10)).when(t.rlike(r"^[0-9]{4}$"), t)

    return F.coalesce(one(published), one(created))


def csl_date(issued_year: Column, date: Column) -> Column:
    """Year of ``issued``, else the trimmed ``date``."""
    return F.coalesce(issued_year.cast("string"), empty_as_null(F.trim(date)))


def strip_non_anchors(text: Column) -> Column:
    """Text without life dates (less than 120 years apart), years of death and lone years in parentheses."""
    first, second = F.regexp_extract_all(text, F.lit(LIFE_DATES), F.lit(1)), F.regexp_extract_all(text, F.lit(LIFE_DATES), F.lit(2))
    whole = F.regexp_extract_all(text, F.lit(LIFE_DATES), F.lit(0))
    lives = F.arrays_zip(whole.alias("w"), first.alias("a"), second.alias("b"))
    short = F.filter(lives, lambda x: F.abs(x["b"].cast("int") - x["a"].cast("int")) < LIFE_SPAN)
    text = F.aggregate(short, text, lambda t, x: F.replace(t, x["w"], F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, DEATH_YEAR, ""), YEAR_IN_PARENTHESES, "")


def years(text: Column) -> Column:
    """Years 1600 to 2029 that no digit touches, in text order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda x: x.cast("int"))


def exact_years(text: Column) -> Column:
    """Years left after life dates, years of death and lone years in parentheses are cut."""
    return years(F.when(F.contains(text, F.lit("(")), strip_non_anchors(text)).otherwise(text))


def _may_hold(text: Column, parts: Sequence[str]) -> Column:
    """Whether the text may hold one of the parts in any case. Patterns are slow, and few texts match one."""
    return F.exists(F.array(F.lower(text)), lambda low: _first(*[F.contains(low, F.lit(p)) for p in parts])) | _first(*[F.contains(text, F.lit(p)) for p in ODD_CASE])


def decade_spans(text: Column) -> Column:
    """Mentions of decades and centuries, by pattern."""
    spans = F.concat(*[F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)) for p in DECADES])
    return F.when(_may_hold(text, DECADE_PARTS), spans).when(text.isNotNull(), F.array().cast("array<string>"))


def event_anchors(text: Column) -> Column:
    """Named events in the text: label and year, each pattern once."""
    known = F.array(*[F.when(text.rlike("(?iU)" + p), F.struct(F.lit(label).alias("label"), F.lit(year).alias("year"))) for p, label, year in EVENTS])
    return F.when(_may_hold(text, EVENT_PARTS), F.filter(known, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<label:string,year:int>>"))


def date_field_year(date: Column) -> Column:
    """Year of ``YYYY-MM…`` or ``YYYY``, else null."""
    return F.when(date.rlike(r"^[0-9]{4}-[0-9]{2}") | date.rlike(r"^[0-9]{4}$"), F.substring(date, 1, 4).cast("int"))


def representative_year(time_from: Column, time_to: Column) -> Column:
    """Floor of the middle, or whichever bound there is."""
    return F.coalesce(F.floor((time_from + time_to) / 2), time_from, time_to).cast("int")


def date_raw(raw: Column, date: Column, time_from: Column) -> Column:
    """The first of these that is not empty."""
    return F.coalesce(empty_as_null(raw), empty_as_null(date), time_from.cast("string"))


def date_js(raw: Column, time_from: Column) -> Column:
    """ISO day: a full date as it is, a year or the first year as its first of January, else null."""
    return (
        F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw).when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-01-01")))
        .when(time_from.isNotNull(), F.concat(F.lpad(time_from.cast("string"), 4, "0"), F.lit("-01-01")))
    )


def date_precision(precision: Column) -> Column:
    """Precision as the fact table has it: exact, year or none."""
    out = F.when(precision.isNull(), F.lit("none"))
    for k, v in DATE_PRECISION.items():
        out = out.when(precision == k, F.lit(v))
    return out.otherwise(F.lit("none"))


def confidence_abbrev(c: Column) -> Column:
    """``medium`` as ``med``."""
    return F.when(c == "medium", F.lit("med")).otherwise(c)


def time_label(time_from: Column, time_to: Column) -> Column:
    """``undatiert``, one year, or two joined by an en dash."""
    return (
        F.when(time_from.isNull(), F.lit(UNDATED)).when(time_to.isNull() | (time_to == time_from), time_from.cast("string"))
        .otherwise(F.concat(time_from.cast("string"), F.lit("–"), time_to.cast("string")))
    )


def format_date(raw: Column, year: Column) -> Column:
    """Raw date, with the year if it has no four digits itself."""
    r, y = F.coalesce(raw, F.lit("")), F.coalesce(year.cast("string"), F.lit(""))
    return F.when(r == "", y).when(r.rlike(r"\d{4}"), r).when(y != "", F.concat(r, F.lit(" "), y)).otherwise(r)


def normalize_category(raw: Column, names: Sequence[str]) -> Column:
    """A valid name for a raw one: itself, else the longest valid name inside it (first on ties), else unknown. Null is unknown."""
    valid = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    inside = F.filter(valid, lambda n: F.contains(F.lower(raw), F.lower(n)))
    longest = F.aggregate(inside, F.lit(""), lambda best, n: F.when(F.length(n) > F.length(best), n).otherwise(best))
    return F.when(raw.isNull(), UNKNOWN_CATEGORY).when(F.array_contains(valid, raw), raw).when(F.size(inside) > 0, longest).otherwise(UNKNOWN_CATEGORY)


def keywords(text: Column, stop: Sequence[str] = STOP_WORDS_CHAT, least: int = 4, most: int = 6) -> Column:
    """First words of a question that are long enough and no stop words, lower-cased, repeats included."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-zÄÖÜäöüß]+)"), F.lit(1)), F.lower)
    return F.slice(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop)), 1, most)


def asks_model(text: Column) -> Column:
    """Whether a question goes to the model: a question mark, or more than four words."""
    return F.contains(text, F.lit("?")) | (F.size(F.split(F.trim(text), r"\s+")) > 4)


def slug(name: Column) -> Column:
    """Technical id of a project name."""
    s = F.regexp_replace(F.trim(F.lower(name)), r"[^\p{L}\p{N}_\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(empty_as_null(s), F.lit("projekt"))


def is_doc_id(s: Column) -> Column:
    """Eight hex digits or ``main``."""
    return s.rlike(r"^([0-9a-f]{8}|main)$")


def source_refs(answer: Column) -> Column:
    """Anchors cited in square brackets."""
    return F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9_-]+)\]"), F.lit(1))


def collapsed(text: Column, n: int = 1500) -> Column:
    """Shown and hidden part of a long text."""
    return F.struct(F.substring(text, 1, n).alias("short"), F.substring(text, F.lit(n + 1), F.length(text)).alias("rest"))


def is_noise_mention(name: Column) -> Column:
    """All lower case and under five characters."""
    return (F.lower(name) == name) & (F.length(name) < 5)


def capital_tokens(text: Column) -> Column:
    """Capitalised words of three letters or more."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]{2,})"), F.lit(1))


def tick_step(span: Column) -> Column:
    """Years between axis ticks for about six ticks."""
    raw = span / 6
    out = F.when(raw <= 1, 1)
    for n in (2, 5, 10, 20, 50):
        out = out.when(raw <= n, n)
    return out.otherwise(100)


def colour(i: Column, palette: Sequence[str] = CATEGORY_COLOURS) -> Column:
    """Colour of the ``i``-th name, from 0."""
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(i, F.lit(len(palette))) + 1).cast("int"))


def all_aliases(normalform: Column, aliases: Column) -> Column:
    """Lower-case names of an entity without empty ones."""
    names = F.concat(F.array(F.coalesce(normalform, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(F.lower(x))), lambda x: x != ""))


def names_of(normalform: Column, aliases: Column) -> Column:
    """Normal form and aliases, trimmed, without empty ones, each once, in order."""
    names = F.concat(F.array(F.coalesce(normalform, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))


def entity_pattern(names: Column) -> Column:
    """Pattern that finds any of the names as whole words, longest first, without regard to case."""
    quoted = F.transform(names, lambda n: F.regexp_replace(n, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1"))
    ordered = F.array_sort(quoted, lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
