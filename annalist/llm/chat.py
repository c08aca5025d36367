"""Chat formatting: one training text per participant of a dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.plans.numbering import numbered
from annalist.plans.staging import stage

# Marks of the chat format.
MARKS = ("<|im_start|>", "<|im_end|>")
#: Roles that set the scene and don't take part.
NARRATORS = ("system",)
NOBODY = "unknown"


def perspectives(conversations: DataFrame, part_turns: int | None = None, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """Render each conversation once for every participant, with that speaker as assistant and the others as named users.

    Input columns ``conv_id``, ``turn``, ``role`` (the speaker), ``text``. A turn becomes
    ``<|im_start|>assistant\\n…<|im_end|>\\n`` if the speaker's, ``<|im_start|>user name=<speaker>\\n…<|im_end|>\\n`` if
    another's, ``<|im_start|>system\\n…<|im_end|>\\n`` if a narrator's. Returns one row per conversation, ``part`` and
    participant: ``conv_id``, ``part``, ``speaker``, ``n_turns``, ``text`` and ``mask``, the ranges of code points (start
    included, end not) that a loss counts: the speaker's own words with their end mark.

    Turns are ordered by number, whatever the numbers are (null last), then role, then text; repeated rows are repeated
    turns. A null role speaks as "unknown", a null text is empty, a null conv_id is a conversation. Marks inside texts and
    roles get a blank after their first character, line breaks in roles become blanks, so neither can be taken for the
    format's own. Narrators alone give no row; an empty table gives an empty result; other columns are ignored.

    A dialogue is one text, whatever its length, so a row is as large as its dialogue. A caller may cut: one of more than
    ``part_turns`` turns then continues in further parts of that many turns each, all rendered for all its participants and with the
    narrators' turns of earlier parts repeated in front, which set the scene. The turns of such conversations
    are numbered by ranges of their order, so none of them is gathered in one task.
    """
    c = F.col

    def plain(text):
        for m in MARKS:
            text = F.replace(text, F.lit(m), F.lit(f"{m[0]} {m[1:]}"))
        return text

    role = plain(F.regexp_replace(F.coalesce(c("role"), F.lit(NOBODY)), r"[\r\n]+", " "))
    rows = conversations.select("conv_id", F.struct(c("turn").isNull().alias("none"), c("turn").alias("turn"), role.alias("role"), plain(F.coalesce(c("text"), F.lit(""))).alias("text")).alias("t"))
    speakers = rows.filter(~c("t.role").isin(*narrators)).select("conv_id", c("t.role").alias("speaker")).distinct()
    sized = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    long = stage(sized.filter(c("n") > part_turns).select(c("conv_id").alias("_long")), "longconvs") if part_turns else None
    if long is not None and not long.isEmpty():
        same = c("conv_id").eqNullSafe(c("_long"))
        placed = stage(numbered(rows.join(long, same, "left_semi").withColumn("_tie", F.monotonically_increasing_id()), ["conv_id", "t", "_tie"], "_at"), "longturns")
        firsts = placed.groupBy(c("conv_id").alias("_long")).agg(F.min("_at").alias("_first"))
        parts = placed.join(firsts, same).select("conv_id", "t", F.floor((c("_at") - c("_first")) / part_turns).cast("long").alias("part"))
        parts = stage(parts, "parts")
        last = parts.groupBy(c("conv_id").alias("_long")).agg(F.max("part").alias("_last"))
        scene = parts.filter(c("t.role").isin(*narrators)).join(last, same).filter("part < _last").select("conv_id", "t", F.explode(F.sequence(c("part") + 1, "_last")).alias("part"))
        rows = rows.join(long, same, "left_anti").unionByName(parts).unionByName(scene)
    turns = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    a, b = turns.alias("a"), speakers.alias("b")
    both = a.join(b, c("a.conv_id").eqNullSafe(c("b.conv_id"))).select("a.conv_id", "part", "speaker", "turns")

    def segment(t):
        own = t["role"] == c("speaker")
        head = F.when(own, F.lit("assistant")).when(t["role"].isin(*narrators), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.struct(F.concat(F.lit("<|im_start|>"), head, F.lit("\n")).alias("h"), F.concat(t["text"], F.lit("<|im_end|>\n")).alias("b"), own.alias("own"))

    segs = both.withColumn("_s", F.transform("turns", segment))
    # the end mark counts, the line feed after it does not
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("m"))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["h"]) + F.length(x["b"])).alias("at"),
        F.when(x["own"], F.concat(s["m"], F.array(F.struct((s["at"] + F.length(x["h"])).alias("start"), (s["at"] + F.length(x["h"]) + F.length(x["b"]) - 1).alias("end"))))).otherwise(s["m"]).alias("m"),
    )
    return segs.select(
        "conv_id", "part", "speaker", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("_s", lambda x: F.concat(x["h"], x["b"])), "").alias("text"),
        F.aggregate("_s", empty, step)["m"].alias("mask"),
    )
