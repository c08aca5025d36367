"""Parsers of model answers and text cutters.

Line formats are array expressions. Only where a scan depends on what it has cut before (nested JSON, overlapping
marks) a small Arrow-batched function does it, one text at a time.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers of entity lists and the types they stand for.
ENTITY_HEADERS = {
    "personen": "Person",
    "person": "Person",
    "organisationen": "Organisation",
    "organisation": "Organisation",
    "orte": "Ort",
    "ort": "Ort",
    "konzepte": "Konzept",
    "konzept": "Konzept",
}


def lines(text: Column) -> Column:
    """Trimmed lines."""
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))


def keyword_lines(text: Column) -> Column:
    """Comma-separated keywords of all lines, numbering and bullets stripped, longer than one character."""
    bare = F.transform(lines(text), lambda x: F.trim(F.regexp_replace(x, r"^[\d]+[.):\s]+", "")))
    words = F.flatten(F.transform(bare, lambda x: F.split(x, ",")))
    clean = F.transform(words, lambda w: F.trim(F.regexp_replace(F.trim(w), r"^[–•·-]+|[–•·-]+$", "")))
    return F.filter(clean, lambda w: F.length(w) > 1)


def group_lines(text: Column, most: int = 60) -> Column:
    """Lines that are names and not chatter: no header, no trailing colon, not too long."""
    return F.filter(lines(text), lambda x: (x != "") & ~x.startswith("#") & ~x.endswith(":") & (F.length(x) <= most))


def entity_lines(rows: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """``# Type`` headers followed by ``name, alias, …`` lines as rows ``ord``, ``typ``, ``normalform``, ``aliases``.

    Lines before a known header are dropped and an unknown header ends the last one's reach.
    """
    line = rows.select(*keys, F.posexplode(lines(F.col(col))).alias("ord", "line")).filter("line <> ''")
    header = F.lower(F.trim(F.regexp_replace("line", "^#+", "")))
    typ = F.coalesce(*[F.when(header == k, F.lit(v)) for k, v in ENTITY_HEADERS.items()])
    up_to_here = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    in_force = F.last(F.when(F.col("line").startswith("#"), F.struct(typ.alias("t"))), ignorenulls=True).over(up_to_here)
    named = line.withColumn("typ", in_force["t"]).filter(~F.col("line").startswith("#") & F.col("typ").isNotNull())
    parts = F.filter(F.transform(F.split("line", ","), lambda x: F.trim(x)), lambda x: x != "")
    return named.withColumn("p", parts).filter(F.size("p") > 0).select(*keys, "ord", "typ", F.col("p")[0].alias("normalform"), F.slice("p", 2, 10_000).alias("aliases"))


def category_block(taxonomy: DataFrame) -> DataFrame:
    """One row ``block``: a line per category in order, for a prompt. A taxonomy is a handful of rows."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), "description")
    ordered = F.array_sort(F.collect_list(F.struct("ord", line.alias("l"))))
    return taxonomy.agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("block"))


def _records(text: str) -> list[dict]:
    out: list[dict] = []
    open_ = None
    for line in filter(None, map(str.strip, (text or "").splitlines())):
        if line.startswith("##"):
            name = re.sub(r"\*+", "", re.sub(r"^\d+\.\s*", "", re.sub(r"^\**", "", line.lstrip("#").strip()))).strip()
            open_ = {"name": name, "description": "", "keywords": []} if name else None
            if open_:
                out.append(open_)
        elif open_ is not None and line.lower().startswith("keywords:"):
            open_["keywords"] = [k.strip() for k in line[9:].split(",") if k.strip()][:3]
            open_ = None
        elif open_ is not None and not open_["description"]:
            open_["description"] = line
    return out


def taxonomy_text(rows: DataFrame, col: str) -> DataFrame:
    """``## name``, description, ``Keywords: a, b`` blocks as rows ``ord``, ``name``, ``description``, ``keywords`` (three at most)."""

    @F.pandas_udf("array<struct<name:string,description:string,keywords:array<string>>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(_records)

    others = [c for c in rows.columns if c != col]
    return rows.select(*others, F.posexplode(parse(col)).alias("ord", "r")).select(*others, "ord", "r.name", "r.description", "r.keywords")


def _first_json(text: str | None) -> str | None:
    if text is None:
        return None
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def first_json(text: Column) -> Column:
    """The first valid JSON object or array in a text, written anew; null if there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_first_json)

    return run(text)


def group_blocks(rows: DataFrame, col: str, n: int) -> DataFrame:
    """Blocks ``## Gruppe i`` of an answer as rows ``n``, ``title``, ``body`` for each i up to ``n``; null where one is missing."""
    body = lambda i: F.regexp_extract(col, rf"(?is)(?:^|\n)#*\s*Gruppe\s+{i}\s*(?::\s*([^\n]*))?\n(.*?)(?=\n#*\s*Gruppe\s+\d+|\z)", 2)
    title = lambda i: F.regexp_extract(col, rf"(?is)(?:^|\n)#*\s*Gruppe\s+{i}\s*(?::\s*([^\n]*))?\n", 1)
    blocks = F.array(*[F.struct(F.lit(i).alias("n"), F.nullif(F.trim(title(i)), F.lit("")).alias("title"), F.nullif(F.trim(F.regexp_replace(body(i), r"^\s+|\s+$", "")), F.lit("")).alias("body")) for i in range(1, n + 1)])
    return rows.select(*[c for c in rows.columns if c != col], F.explode(blocks).alias("b")).select(*[c for c in rows.columns if c != col], "b.n", "b.title", "b.body")


#: What strings are stripped of.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
#: Signs of two UTF-16 units.
WIDE = r"[\x{10000}-\x{10ffff}]"


def _word_cut(text: str, most: int) -> int:
    """Where to cut without parting a word: at the last blank that fits, else beside a sign of no word, else behind the word that is too long."""
    word = lambda i: text[i].isalnum() or text[i] == "_"
    fits = range(most, 0, -1)
    cut = next((i for i in fits if text[i].isspace()), 0) or next((i for i in fits if not (word(i - 1) and word(i))), 0)
    m = None if cut else re.compile(r"\W").search(text, most)
    return cut or (m.start() if m else len(text))


def _chunks(text: str, most: int, whole: bool = False) -> list[str]:
    """Pieces cut behind the last full stop that fits, else hard, or with ``whole`` words at a bound of words."""
    out, at = [], text
    while len(at) > most:
        cut = at.rfind(". ", 0, most) + 1 or (_word_cut(at, most) if whole else most)
        out.append(at[:cut].strip())
        at = at[cut:].strip()
    return [c for c in [*out, at] if c]


def chunk_sentences(col: str, most: int, blanks: str = BLANKS, strip_short: bool = False) -> Column:
    """Pieces of at most ``most`` characters, cut behind the last full stop that fits, else hard; without ``blanks`` at their ends.

    The same as :func:`_chunks`, as one pattern: each match begins where the one before has ended, behind blanks. As in the original a
    text that fits is one piece as it is, unless ``strip_short``. Java steps back recursively over signs of unequal width, so where signs
    of two units occur the matches are found with a letter for each of them, and the text is cut to their lengths.
    """
    text, bare = F.coalesce(F.col(col), F.lit("")), lambda x: F.btrim(x, F.lit(blanks))
    blank = "".join(f"\\x{{{ord(c):x}}}" for c in blanks)
    cut = (rf".{{0,{most - 2}}}\.(?= )|" if most > 1 else "") + rf".{{{most}}}"
    rest = rf".{{0,{most - 1}}}[^{blank}](?=[{blank}]*+\z)"
    found = lambda t: F.regexp_extract_all(t, F.lit(rf"(?s)\A(?:{cut})|(?!\A)\G[{blank}]*+(?:{rest}|{cut})"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), text.alias("left"))
    taken = lambda s, m: F.struct(F.concat(s["out"], F.array(F.substring(s["left"], F.lit(1), F.length(m)))).alias("out"), F.substring(s["left"], F.length(m) + 1, F.length(s["left"])).alias("left"))
    wide = F.aggregate(found(F.regexp_replace(text, WIDE, "x")), start, taken, lambda s: s["out"])
    pieces = F.transform(F.when(text.rlike(WIDE), wide).otherwise(found(text)), bare)
    whole = F.array(bare(text) if strip_short else text)
    return F.filter(F.when(F.length(text) <= most, whole).otherwise(pieces), lambda x: x != "")


def highlight(aliases: Mapping[str, tuple[str, str]], keywords: Sequence[str], focus: str | None = None) -> Callable[[str], Column]:
    """Marks whole-word aliases (lower case → normal form, type) and keywords in escaped HTML; an alias beats a keyword."""
    terms = sorted({*aliases, *map(str.lower, keywords)}, key=lambda t: (-len(t), t))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, terms)) + r")(?!\w)", re.IGNORECASE) if terms else None

    def mark(m: re.Match) -> str:
        shown, known = html.escape(m[0]), aliases.get(m[0].lower())
        if known is None:
            return f"<mark>{shown}</mark>"
        kind = "entity-focus" if known[0] == focus else "entity"
        return f'<span class="{kind}" data-typ="{html.escape(known[1])}" data-norm="{html.escape(known[0])}">{shown}</span>'

    def one(text: str | None) -> str | None:
        if text is None or pattern is None:
            return text if text is None else html.escape(text)
        out, at = [], 0
        for m in pattern.finditer(text):
            out += [html.escape(text[at : m.start()]), mark(m)]
            at = m.end()
        return "".join([*out, html.escape(text[at:])])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return lambda col: run(col)


def candidate_line(normalform: Column, aliases: Column, most: int = 3) -> Column:
    """An entity as a prompt line: its name and the first few aliases."""
    kept = F.slice(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != "")), 1, most)
    return F.array_join(F.concat(F.array(normalform), kept), ", ")


def few_shot_block(entities: DataFrame, per_type: int = 3) -> DataFrame:
    """One row ``block``: up to ``per_type`` entities of each type under a header, in list order. A dictionary is small."""
    w = Window.partitionBy("typ").orderBy("ord")
    line = candidate_line(F.col("normalform"), F.col("aliases"))
    kept = entities.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_type).select("typ", "ord", line.alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "l"))), lambda x: x["l"]), "\n")
    groups = kept.groupBy("typ").agg(F.concat(F.lit("# "), F.col("typ"), F.lit("\n"), text).alias("b"))
    return groups.agg(F.array_join(F.array_sort(F.collect_list("b")), "\n").alias("block"))
