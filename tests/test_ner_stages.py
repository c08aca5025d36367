"""The four stages of model-based entities with providers of fixed answers, one of which fails on a batch."""

import re
import sys

from pyspark import cloudpickle

from annalist.operators import ner_stages as N
from annalist.operators import providers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Scripted:
    """Answers by what the prompt starts with; fails where told to."""

    def __init__(self, fails=""):
        self.fails = fails

    def complete(self, prompts):
        p = prompts[0]
        head, _, body = p.partition("\n")
        if self.fails and self.fails in body:
            raise RuntimeError("no answer")
        if head == "extract":
            return ["# Orte\n" + "\n".join(re.findall(r"\b[A-Z]\w+", body))]
        if head == "group":
            names = body.split("\n")
            return ["Hier sind die Gruppen:\n" + "\n".join(f"{n}, {n}s" for n in names if not n.endswith("s"))]
        return ["# Personen\n" + "\n".join(re.sub(r"^\d+\. ", "", x).upper() for x in body.split("\n"))]


def entity_rows(spark, names):
    return spark.createDataFrame([(i, n, "Ort", a) for i, (n, a) in enumerate(names)], "ord long, normalform string, typ string, aliases array<string>")


def rows_of(df):
    return [(r["ord"], r["normalform"], r["typ"], r["aliases"]) for r in df.orderBy("ord").collect()]


def test_extraction_in_batches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Wien und Graz", "nichts", "Linz. Kiew", "wien Wien", None, "", "Bonn"])], "id long, text string").repartition(3)
    got = [r[1] for r in rows_of(N.extracted(df, ["id"], "text", "extract", Scripted(), 2))]
    assert got == ["Wien", "Graz", "Linz", "Kiew", "Bonn"]
    assert [r[1] for r in rows_of(N.extracted(df, ["id"], "text", "extract", Scripted("Linz"), 2))] == ["Wien", "Graz", "Bonn"]
    asked = N.ask_in_batches(df.select("id", "text").na.fill("leer"), ["id"], N.F.col("text"), 3, "p", Echo(), "\n---\n")[1]
    assert {r["_batch"]: r["_answer"] for r in asked.collect()}[0] == "p\nWien und Graz\n---\nnichts\n---\nLinz. Kiew"


class Echo:
    def complete(self, prompts):
        return list(prompts)


def test_grouping_keeps_a_batch_that_fails(spark):
    names = entity_rows(spark, [("Rat", ["Raete"]), ("Rats", []), ("Amt", None), ("Bund", ["bunds", "BUND"])])
    want = [(0, "Rat", "Ort", ["Raete", "Rats"]), (1, "Amt", "Ort", ["Amts"]), (2, "Bund", "Ort", ["bunds"])]
    assert rows_of(N.grouped(names, "group", Scripted(), 2)) == want
    assert rows_of(N.grouped(names, "group", Scripted("Amt"), 2)) == [want[0], (1, "Amt", "Ort", None), (2, "Bund", "Ort", ["bunds", "BUND"])]
    fresh = N.grouped(entity_rows(spark, [("Neu", [])]).limit(0), "group", Scripted())
    assert fresh.count() == 0


def test_names_keep_a_batch_that_fails(spark):
    names = entity_rows(spark, [("a", ["x"]), ("b", []), ("c", [])])
    assert rows_of(N.normalised_names(names, "normalise", Scripted(), 2)) == [(0, "A", "Person", ["X"]), (1, "B", "Person", []), (2, "C", "Person", [])]
    assert rows_of(N.normalised_names(names, "normalise", Scripted("a, x"), 2)) == [(0, "a", "Ort", ["x"]), (1, "b", "Ort", []), (2, "C", "Person", [])]


def test_all_stages(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Wien und Graz", "Linz"])], "id long, text string")
    got = rows_of(N.entities_by_model(df, ["id"], "text", Scripted(), {"extract": "extract", "group": "group", "normalise": "normalise"}))
    assert sorted(r[1] for r in got) == ["GRAZ", "LINZ", "WIEN"] and all(r[2] == "Person" and len(r[3]) == 1 for r in got)
    small = N.entities_by_model(df, ["id"], "text", providers.CapitalLister(), {"extract": "e", "group": "g", "normalise": "n"}, full=False)
    assert small.count() == 3 and N.entities_by_model(df.limit(0), ["id"], "text", Scripted(), {"extract": "e", "group": "g", "normalise": "n"}).count() == 0
