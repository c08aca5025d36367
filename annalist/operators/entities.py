"""Entities: dictionary matching, alias maps, merging, near-duplicates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from annalist.functions import text as T
from annalist.operators.components import connected_components
from annalist.plans.numbering import numbered
from annalist.plans.staging import discard, stage

#: Entities up to this many are patterns of one expression; a longer list is an automaton.
PATTERNS = 256
#: Estimated memory of a sign of a name and of a name besides, and the most that an automaton is to take, on the driver and in a task.
NODE_BYTES, NAME_BYTES, AUTOMATON_BYTES = 80, 400, 1 << 26
#: Signs of texts, as a power of two, that are a block with one list of words, which longer lists of names are joined with.
WORD_BITS = 22
# Priorities of sources in the merge, the smallest being the strongest; others come last.
SOURCE_PRIORITY = {
    "seed": 0,
    "llm_iter1": 1,
    "llm_task1": 1,
    "llm_task2": 1,
    "llm_task3": 1,
    "llm_uncovered": 1,
    "llm_full": 1,
    "llm_dedup": 1,
    "classifier": 2,
    "embedding": 2,
}


def alias_rows(entities: DataFrame) -> DataFrame:
    """One row per entity and distinct lower-case alias: ``ord``, ``normalform``, ``typ``, ``alias``."""
    return entities.select("ord", "normalform", "typ", F.explode(T.all_aliases(F.col("normalform"), F.col("aliases"))).alias("alias"))


def match_entities(rows: DataFrame, entities: DataFrame, text: str = "text") -> DataFrame:
    """Add ``actors``: normal forms of the entities that occur in the text as whole words, in the order of the list.

    Case does not count. Up to ``PATTERNS`` entities of the list (``ord``, ``normalform``, ``aliases``) are one pattern each in
    an expression, compiled once per task. A longer list is an automaton of all names (:class:`NameAutomaton`), sent to all tasks, if
    it keeps to ``AUTOMATON_BYTES``; these two shuffle no row. Beyond that names are joined with the words of the texts
    (:func:`_joined`), and neither the driver nor a task holds the list. All find the same.
    """
    named = entities.withColumn("_names", T.names_of(F.col("normalform"), F.col("aliases"))).filter(F.size("_names") > 0)
    pats = named.select("ord", "normalform", T.entity_pattern(F.col("_names")).alias("_p"))
    few = pats.limit(PATTERNS + 1).collect()
    none = F.array().cast("array<string>")
    if len(few) <= PATTERNS:
        hits = [F.when(F.rlike(F.col(text), F.lit(r["_p"])), F.lit(r["normalform"])) for r in sorted(few, key=lambda r: r["ord"])]
        return rows.withColumn("actors", F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else none)
    names = stage(named.select("ord", "normalform", F.explode("_names").alias("name")).withColumn("_bytes", F.length("name") * NODE_BYTES + NAME_BYTES), "names")
    if (names.agg(F.sum("_bytes")).first()[0] or 0) <= AUTOMATON_BYTES:
        return rows.withColumn("actors", _finder(rows, names)(F.col(text)))
    return _joined(rows, names, text)


def _name_key(name: str) -> tuple[str, str, bool, bool]:
    """A name with its case folded, the word that it is looked up by, and whether it is a word and nothing else, or holds none.

    The word is the longest in it, or its first sign if there is none. The iota subscript is no letter but folds to one, so a
    word also ends at an iota: such ends are the same in a name and in any text that holds it.
    """
    folded = name.translate(_Fold())
    words = _PART.findall(folded)
    key = max(words, key=len) if words else folded[0]
    return folded, key, bool(words) and key == folded, not words


def _words(text: str, fold: _Fold, signs: bool) -> dict[str, bool]:
    """Words of a text that names are looked up by, and whether they stand by themselves; with ``signs`` all other signs, too."""
    parts = dict.fromkeys(_PART.findall(text.translate(fold)), False)
    if signs:
        parts |= dict.fromkeys(_PART.sub("", text.translate(fold)), False)
    return parts | dict.fromkeys((w.translate(fold) for w in _WORD.findall(text)), True)


def _joined(rows: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``actors`` by a join of names and words.

    Rows are dealt into blocks of some 2 to the power of ``WORD_BITS`` signs of text. A block's words are listed once each and joined with the words that names
    are looked up by; the names that are found go to the block, are an automaton there, and all its texts pass that. So what is shuffled is the
    texts and the different words and names of each block, and no entry for each place of a word.
    """
    c, kept, most, words_of, automaton = F.col, [x for x in rows.columns if x != "actors"], 1 << WORD_BITS, _words, NameAutomaton

    @F.pandas_udf("struct<key:string,word:boolean,sign:boolean>")
    def keyed(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_name_key(n)[1:] for n in batch], columns=["key", "word", "sign"])

    listed = names.select("ord", "normalform", "name", keyed("name").alias("_k")).select("ord", "normalform", "name", "_k.*")
    signs = bool(listed.agg(F.max("sign")).first()[0])
    place = kept.index(text)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            size = pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype("int64")
            end = before + size.cumsum()
            before, block = int(end[-1]) if len(end) else before, first + (end - size) // most
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], [*kept, "_block"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, block, found = _Fold(), None, {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.bool_()), pa.array([block] * len(found), pa.int64())], ["key", "alone", "block"])

        for batch in batches:
            for t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != block:
                    if found:
                        yield done()
                    block, found = at, {}
                for key, alone in words_of(t, fold, signs).items():
                    found[key] = alone or found.get(key, False)
        if found:
            yield done()

    def match(texts: pa.Table, found: pa.Table) -> pa.Table:
        known = automaton(zip(*(found.column(x).to_pylist() for x in ("ord", "normalform", "name")), strict=True))
        actors = [[f for _, f in known.find(t)] for t in texts.column(text).to_pylist()]
        return texts.select(kept).append_column("actors", pa.array(actors, pa.list_(pa.string())))

    kind = StructType([*rows.select(*kept).schema.fields])
    data = stage(rows.select(*kept).mapInArrow(deal, StructType([*kind.fields, StructField("_block", LongType())])), "texts")
    entries = data.select(c(text).alias("_t"), "_block").filter("_t <> ''").mapInArrow(words, "key string, alone boolean, block long")
    found = entries.join(listed, "key").filter("alone OR NOT word").select("block", "ord", "normalform", "name")
    return data.groupBy("_block").cogroup(found.groupBy("block")).applyInArrow(match, StructType([*kind.fields, StructField("actors", ArrayType(StringType()))]))


def _name_parts(names: DataFrame) -> Iterator[DataFrame]:
    """Names in ranges of their first signs, each small enough for one automaton; one at a time is taken to the driver.

    Names with one sign in front that are too many are cut by their next signs.
    """
    depth, todo = 1, [names]
    while todo:
        heads = [t.groupBy(F.substring("name", 1, depth).alias("head")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")) for t in todo]
        later: list[DataFrame] = []
        for t, h in zip(todo, heads, strict=True):
            if (h.agg(F.sum("b")).first()[0] or 0) <= AUTOMATON_BYTES:
                yield t
                continue
            own, size = [], 0
            for r in h.orderBy("head").toLocalIterator():  # a row per head, read in order
                head = F.substring("name", 1, depth) == r["head"]
                if r["b"] > AUTOMATON_BYTES and r["n"] > 1 and len(r["head"]) == depth:
                    later.append(t.filter(head))
                    continue
                if own and size + r["b"] > AUTOMATON_BYTES:
                    yield t.filter(F.substring("name", 1, depth).isin(own))
                    own, size = [], 0
                own, size = [*own, r["head"]], size + r["b"]
            if own:
                yield t.filter(F.substring("name", 1, depth).isin(own))
        todo, depth = later, depth + 1


# Words, and words that end at signs which fold to an iota, too.
_WORD, _PART = re.compile(r"\w+"), re.compile(r"[^\W\u0345\u0399\u03b9\u1fbe]+")


class _Fold(dict):
    """Code point to the one that stands for it whatever the case, one for one, as in patterns that ignore case."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper() if len(c.upper()) == 1 else c
        low = up.lower() if len(up.lower()) == 1 else up
        self[code] = ord("i") if code == 0x130 else ord(low)
        return self[code]


class _InWord(dict):
    """Whether a sign is a letter, a digit or an underscore."""

    def __missing__(self, c: str) -> bool:
        self[c] = c == "_" or unicodedata.category(c)[0] in "LN"
        return self[c]


class NameAutomaton:
    """Finds many names in one pass over a text: an Aho-Corasick automaton with a check of word boundaries."""

    def __init__(self, names: Iterable[tuple[int, str, str]]):
        """``names``: order, normal form and name of entities."""
        self.fold, self.in_word, owners = _Fold(), _InWord(), {}
        for order, normalform, name in names:
            owners.setdefault(name.translate(self.fold), set()).add((order, normalform))
        self.automaton = ahocorasick.Automaton()
        for name, own in owners.items():
            self.automaton.add_word(name, (len(name), sorted(own)))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, str]]:
        """Order and normal form of the entities in ``text``."""
        if not text or not len(self.automaton):
            return []
        low, n, got = text.translate(self.fold), len(text), set()
        for end, (size, own) in self.automaton.iter(low):
            if not (end >= size and self.in_word[text[end - size]]) and not (end + 1 < n and self.in_word[text[end + 1]]):
                got.update(own)
        return sorted(got)


def _finder(rows: DataFrame, names: DataFrame) -> Callable[[Column], Column]:
    """A function that finds the entities of ``names`` in a text: their normal forms in order."""
    held = names.select("ord", "normalform", "name").toPandas()  # as many as one automaton holds
    sent = rows.sparkSession.sparkContext.broadcast(NameAutomaton(held.itertuples(index=False, name=None)))

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = sent.value
        for texts in batches:
            yield pd.Series([[f for _, f in automaton.find(t)] for t in texts], index=texts.index, dtype=object)

    return find


def drop_rejected(entities: DataFrame, rejected: DataFrame) -> DataFrame:
    """Entities whose normal form is not rejected; aliases of rejected ones don't count."""
    gone = rejected.select(F.lower(F.trim("normalform")).alias("_k")).distinct()
    return entities.join(gone, F.lower(F.trim(entities["normalform"])) == gone["_k"], "left_anti")


def normalise_mentions(mentions: DataFrame, entities: DataFrame, col: str = "mention") -> DataFrame:
    """Add ``normalform``: that of the last entity that has the mention among its names, else the mention itself."""
    last = alias_rows(entities).groupBy("alias").agg(F.max_by("normalform", "ord").alias("normalform"))
    return mentions.join(last, F.lower(F.trim(mentions[col])) == last["alias"], "left").drop("alias").withColumn("normalform", F.coalesce("normalform", F.col(col)))


def overlapping(proposals: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a proposal and a known entity that share a name: ``p_ord``, ``k_ord``, ``shared`` names."""
    p, k = alias_rows(proposals).select(F.col("ord").alias("p_ord"), "alias"), alias_rows(known).select(F.col("ord").alias("k_ord"), "alias")
    return p.join(k, "alias").groupBy("p_ord", "k_ord").agg(F.count("*").alias("shared"))


def dedup_names(entities: DataFrame) -> DataFrame:
    """One row per lower-case normal form: the first one's spelling and type, the best score, all aliases in first-seen order."""
    key = F.lower(F.trim("normalform"))
    rows = entities.withColumn("_k", key).filter("_k <> ''")
    aliases = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "aliases"))), lambda x: x["aliases"])))
    return rows.groupBy("_k").agg(F.min("ord").alias("ord"), F.min_by("normalform", "ord").alias("normalform"), F.min_by("typ", "ord").alias("typ"), F.max("score").alias("score"), aliases.alias("aliases")).drop("_k")


def _lower_names(normalform: Column, aliases: Column) -> Column:
    """Lower-case trimmed names: that of the normal form first, then the aliases', in place; blank where there is none."""
    low = lambda x: F.coalesce(F.lower(F.trim(x)), F.lit(""))
    return F.concat(F.array(low(normalform)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), low))


def name_groups(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``_names`` (lower-case names in place) and ``_group``: rows that are linked by shared names, directly or
    not, inside equal values of ``within``, have one group.

    What a fold by shared names does to a row hangs on its group alone, so groups can be folded apart. Names meet by their
    hash; a collision would only make a group larger.
    """
    c = F.col
    data = stage(rows.withColumn("_names", _lower_names(c("normalform"), c("aliases"))).withColumn("_e", F.monotonically_increasing_id()), "entities")
    named = data.select("_e", *within, F.explode(F.array_distinct("_names")).alias("_n")).filter("_n <> ''").select("_e", F.xxhash64(*within, "_n").alias("_h"))
    links = named.join(named.groupBy("_h").agg(F.min("_e").alias("_m")), "_h").filter("_e <> _m").select(c("_e").alias("a"), c("_m").alias("b"))
    comps = connected_components(links).select(c("node").alias("_v"), c("component").alias("_c"))
    return data.join(comps, c("_e") == c("_v"), "left").withColumn("_group", F.coalesce("_c", "_e")).drop("_v", "_c", "_e")


def merge_entities(entities: DataFrame, project: str = "project") -> DataFrame:
    """Fold entity lists into one per project, in order: an entity joins the first one it shares a name with.

    Names are the normal form and the aliases. A stronger source takes over the normal form, and the old one is then no name
    any more unless it is an alias; the first type and the better score stay; new aliases are appended, a joined normal form
    is not. Entities without a normal form are left out. ``ord`` counts the entities of a project from 0. The outcome depends
    on the order, so it is a fold; but only of entities that are linked by names (:func:`name_groups`), each such group in
    one task.
    """
    rank = SOURCE_PRIORITY

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        owners: dict[str, set[int]] = {}
        for r in pdf.sort_values("ord").to_dict("records"):
            own, *others = list(r["_names"])
            if not own:
                continue
            aliases = [a for a in (r["aliases"] if r["aliases"] is not None else []) if a is not None]
            at = min((i for n in (own, *others) if n for i in owners.get(n, ())), default=None)
            if at is None:
                at = len(out)
                out.append({project: r[project], "first": r["ord"], "normalform": r["normalform"], "typ": r["typ"], "score": r["score"], "source": r["source"], "aliases": aliases})
                owners.setdefault(own, set()).add(at)
            else:
                e = out[at]
                if rank.get(r["source"], 99) < rank.get(e["source"], 99):
                    before = e["normalform"].strip().lower()
                    if before not in {a.strip().lower() for a in e["aliases"]}:
                        owners.get(before, set()).discard(at)
                    e.update(normalform=r["normalform"], source=r["source"])
                    owners.setdefault(own, set()).add(at)
                if (r["score"] or 0) > (e["score"] or 0):
                    e["score"] = r["score"]
                known = {a.lower() for a in e["aliases"]}
                for a in aliases:
                    if a and a.lower() not in known:
                        e["aliases"].append(a)
                        known.add(a.lower())
            for n in others:
                if n:
                    owners.setdefault(n, set()).add(at)
        return pd.DataFrame(out, columns=[project, "first", "normalform", "typ", "score", "source", "aliases"])

    kind = entities.schema[project].dataType.simpleString()
    folded = name_groups(entities, [project]).groupBy("_group").applyInPandas(fold, f"{project} {kind}, first long, normalform string, typ string, score double, source string, aliases array<string>")
    placed = stage(numbered(folded, [project, "first"], "_at"), "merged")
    low = placed.groupBy(F.col(project).alias("_p")).agg(F.min("_at").alias("_low"))
    out = placed.join(low, F.col(project).eqNullSafe(F.col("_p")))
    return out.select(project, (F.col("_at") - F.col("_low")).alias("ord"), "normalform", "typ", "score", "source", "aliases")


def merge_proposal(proposals: DataFrame, seed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Status of each proposed entity, in order: ``skipped`` if it shares a name with a rejected one, ``confirmed`` if with a
    seed or an earlier proposal (``into`` names its normal form; its aliases then count as names of that one), else ``new``.

    Rejected names are joined; a proposal's fate hangs on earlier ones that it is linked to by names, so each such group
    (:func:`name_groups`) is folded by itself. Columns ``ord``, ``normalform``, ``typ``, ``aliases``.
    """
    c, cols = F.col, ["ord", "normalform", "typ", "aliases"]
    refused = rejected.select(F.explode(_lower_names(c("normalform"), c("aliases"))).alias("_n")).filter("_n <> ''").distinct()
    asked = stage(proposals.select(*cols).withColumn("_i", F.monotonically_increasing_id()), "proposals")
    hit = asked.select("_i", F.explode(_lower_names(c("normalform"), c("aliases"))).alias("_n")).join(refused, "_n", "left_semi").select("_i").distinct()
    skipped = asked.join(hit, "_i", "left_semi").select("ord", "normalform", "typ", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("into"))
    rest = asked.join(hit, "_i", "left_anti").select(F.lit(2).alias("kind"), *cols)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, owner, named = [], {}, []
        for r in pdf.sort_values(["kind", "ord"]).to_dict("records"):
            names = [n for n in r["_names"] if n]
            at = min((owner[n] for n in names if n in owner), default=None)
            if r["kind"] == 2:
                out.append({"ord": r["ord"], "normalform": r["normalform"], "typ": r["typ"], "status": "new" if at is None else "confirmed", "into": None if at is None else named[at]})
            new = r["kind"] == 1 or at is None
            if new:
                at = len(named)
                named.append(r["normalform"])
            for n in names if new else [n for n in list(r["_names"])[1:] if n]:
                owner[n] = min(at, owner.get(n, at))
        return pd.DataFrame(out, columns=["ord", "normalform", "typ", "status", "into"])

    every = name_groups(seed.select(F.lit(1).alias("kind"), *cols).unionByName(rest))
    return skipped.unionByName(every.groupBy("_group").applyInPandas(fold, "ord long, normalform string, typ string, status string, into string"))


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """A matching of near-duplicate pairs (``a``, ``b``, ``sim``): the most similar first, each entity once.

    Taking the best pair again and again is the same as taking, in each round, all pairs that are the best of both their
    ends. Ties go to the smaller ids. Rounds go on until no pair is left: of those that are, the best one is always taken.
    """
    left, chosen = stage(pairs.select("a", "b", "sim"), "pairs"), None
    while True:
        ends = left.select(F.col("a").alias("x"), "sim", "a", "b").unionByName(left.select(F.col("b").alias("x"), "sim", "a", "b"))
        order = F.struct(F.col("sim"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
        best = ends.groupBy("x").agg(F.max(order).alias("m")).select("x", (-F.col("m.na")).alias("a"), (-F.col("m.nb")).alias("b"))
        mutual = best.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")
        got = stage(left.join(mutual, ["a", "b"]), "matched")
        if got.isEmpty():
            break
        chosen = got if chosen is None else chosen.unionByName(got)
        used = got.select(F.col("a").alias("x")).unionByName(got.select(F.col("b").alias("x"))).distinct()
        before, left = left, stage(left.join(used, left["a"] == used["x"], "left_anti").join(used, F.col("b") == used["x"], "left_anti"), "pairs")
        discard(before)
    return chosen if chosen is not None else left.limit(0)


def alias_csv(entities: DataFrame) -> DataFrame:
    """Rows of the alias file: each name of each entity once, whatever its case, first spelling kept."""
    names = entities.withColumn("typ", F.coalesce("typ", F.lit("Org"))).select("ord", "normalform", "typ", F.posexplode(F.concat(F.array("normalform"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("i", "alias"))
    first = Window.partitionBy("ord", F.lower("alias")).orderBy("i")
    kept = names.withColumn("alias", F.trim("alias")).filter("alias <> ''").withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return kept.select("ord", "i", "alias", "normalform", "typ")


def parse_alias_line(line: Column) -> Column:
    """``alias,normal,form,typ``: the first and last fields, and all between as the normal form, commas included."""
    f = F.split(line, ",")
    return F.struct(F.trim(f[0]).alias("alias"), F.trim(F.array_join(F.slice(f, 2, F.greatest(F.size(f) - 2, F.lit(0))), ",")).alias("normalform"), F.trim(F.element_at(f, -1)).alias("typ"))
