"""Entities by a completion model in four stages: a sample, all texts, spelling variants, clean names.

Several rows go into a prompt. Answers are parsed by joins and expressions, and a batch whose answer fails or holds nothing keeps what
it was asked about, so a model's failure costs no entity that was known before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.parsers import candidate_line, chunk_sentences, entity_lines, group_lines
from annalist.operators.entities import dedup_names
from annalist.operators.providers import CompletionProvider
from annalist.plans.numbering import numbered
from annalist.plans.staging import stage

# Rows of the sample and of a batch of each stage, the type of a group none of whose names is known, and what stands
# between the texts of a prompt.
SAMPLE, SAMPLE_BATCH, FULL_BATCH, GROUP_BATCH, NAME_BATCH = 50, 5, 5, 30, 20
UNKNOWN_TYPE = "Konzept"
BETWEEN = "\n---\n"
ENTITY = ["ord", "normalform", "typ", "aliases"]


def ask_in_batches(rows: DataFrame, order: list[str], line: Column, size: int, prompt: str, provider: CompletionProvider, between: str, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their ``_batch``, and per ``_batch`` the ``_answer`` to the prompt above the lines of its rows (null if the model fails).

    Rows are numbered in ``order`` and go ``size`` at a time; ``count`` puts their place in the batch in front of the lines.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out = []
            for p in prompts:
                try:
                    out.append(provider.complete([p])[0])
                except Exception:  # noqa: BLE001  a model's failure on one batch must not lose the job
                    out.append(None)
            yield pd.Series(out, index=prompts.index, dtype=object)

    held = stage(numbered(rows, order, "_n").withColumn("_batch", F.floor((F.col("_n") - 1) / size)), "batches")
    own = F.concat((F.col("_n") - F.col("_batch") * size).cast("string"), F.lit(". "), line) if count else line
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", own.alias("l")))), lambda x: x["l"]), between)
    prompts = held.groupBy("_batch").agg(lines.alias("_lines"))
    return held, stage(prompts.select("_batch", ask(F.concat(F.lit(f"{prompt}\n"), F.col("_lines"))).alias("_answer")), "answers")


def extracted(rows: DataFrame, order: list[str], text: str, prompt: str, provider: CompletionProvider, batch: int, most: int = 8000) -> DataFrame:
    """Entities (``ord``, ``normalform``, ``typ``, ``aliases``) that a model lists for texts, cut into pieces of ``most`` signs, ``batch`` of them in a prompt; equal names are one."""
    pieces = rows.select(*order, F.posexplode(chunk_sentences(text, most)).alias("_i", "_c"))
    _, answers = ask_in_batches(pieces, [*order, "_i"], F.col("_c"), batch, prompt, provider, BETWEEN)
    found = entity_lines(answers.filter("_answer IS NOT NULL"), ["_batch"], "_answer")
    placed = numbered(found, ["_batch", "ord"], "_at").select(F.col("_at").alias("ord"), "normalform", "typ", "aliases", F.lit(0.0).alias("score"))
    return dedup_names(placed).select(*ENTITY)


def grouped(entities: DataFrame, prompt: str, provider: CompletionProvider, batch: int = GROUP_BATCH) -> DataFrame:
    """Spelling variants as one entity: each line of an answer is a name and its variants.

    Its type and first aliases are those of the first of its names that is known, the name itself before the variants; a
    name counts as that of the last entity that has it. A batch without an answer or without lines stays as it was.
    """
    c = F.col
    held, answers = ask_in_batches(entities.select(*ENTITY), ["ord"], c("normalform"), batch, prompt, provider, "\n")
    lines = answers.select("_batch", F.posexplode(group_lines(F.coalesce("_answer", F.lit("")))).alias("_i", "_line"))
    parts = F.filter(F.transform(F.split(lines["_line"], ","), lambda x: F.trim(x)), lambda x: x != "")
    named = stage(lines.select("_batch", "_i", parts.alias("_p")).filter(F.size("_p") > 0), "groups")
    names = entities.select("ord", "typ", "aliases", F.explode(F.concat(F.array("normalform"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"))
    known = names.groupBy(F.lower("_name").alias("_low")).agg(F.max_by(F.struct("typ", "aliases"), "ord").alias("_e"))
    tried = named.select("_batch", "_i", F.posexplode("_p").alias("_j", "_name")).join(known, F.lower("_name") == c("_low"))
    first = tried.groupBy("_batch", "_i").agg(F.min_by("_e", "_j").alias("_e"))
    both = named.join(first, ["_batch", "_i"], "left")
    every = F.concat(F.coalesce("_e.aliases", F.array().cast("array<string>")), F.slice("_p", 2, 10_000))
    own = F.lower(c("_p")[0])
    kept = F.aggregate(
        F.filter(every, lambda a: a.isNotNull() & (a != "")), F.array().cast("array<string>"),
        lambda s, a: F.when((F.lower(a) == own) | F.exists(s, lambda x: F.lower(x) == F.lower(a)), s).otherwise(F.concat(s, F.array(a))),
    )
    new = both.select("_batch", c("_i").alias("_at"), c("_p")[0].alias("normalform"), F.coalesce("_e.typ", F.lit(UNKNOWN_TYPE)).alias("typ"), kept.alias("aliases"))
    rest = held.join(named.select("_batch").distinct(), "_batch", "left_anti").select("_batch", c("_n").cast("int").alias("_at"), "normalform", "typ", "aliases")
    return numbered(new.unionByName(rest), ["_batch", "_at"], "_o").select((c("_o") - 1).alias("ord"), "normalform", "typ", "aliases")


def normalised_names(entities: DataFrame, prompt: str, provider: CompletionProvider, batch: int = NAME_BATCH) -> DataFrame:
    """Clean names and types for candidates; a batch without an answer or without an entity in it keeps its candidates."""
    c = F.col
    held, answers = ask_in_batches(entities.select(*ENTITY), ["ord"], candidate_line(c("normalform"), c("aliases")), batch, prompt, provider, "\n", count=True)
    found = stage(entity_lines(answers.filter("_answer IS NOT NULL"), ["_batch"], "_answer"), "named")
    new = found.select("_batch", c("ord").cast("long").alias("_at"), "normalform", "typ", "aliases")
    rest = held.join(found.select("_batch").distinct(), "_batch", "left_anti").select("_batch", c("_n").alias("_at"), "normalform", "typ", "aliases")
    return numbered(new.unionByName(rest), ["_batch", "_at"], "_o").select((c("_o") - 1).alias("ord"), "normalform", "typ", "aliases")


def entities_by_model(rows: DataFrame, order: list[str], text: str, provider: CompletionProvider, prompts: dict[str, str], seed: int = 42, full: bool = True) -> DataFrame:
    """All four stages: entities of a seeded sample of texts, of all texts (if ``full``), their variants grouped, their names cleaned.

    ``prompts`` has those of ``extract``, ``group`` and ``normalise``. Equal names are one entity, those of the sample first.
    """
    some = rows.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(SAMPLE)
    found = extracted(some, order, text, prompts["extract"], provider, SAMPLE_BATCH).withColumn("_s", F.lit(0))
    if full:
        found = found.unionByName(extracted(rows, order, text, prompts["extract"], provider, FULL_BATCH).withColumn("_s", F.lit(1)))
        found = numbered(found, ["_s", "ord"], "_at").drop("ord", "_s").withColumnRenamed("_at", "ord").withColumn("score", F.lit(0.0))
        found = dedup_names(found).select(*ENTITY)
    found = stage(found.select(*ENTITY), "found")
    return normalised_names(stage(grouped(found, prompts["group"], provider), "grouped"), prompts["normalise"], provider)
