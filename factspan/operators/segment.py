"""Units by a dictionary (survey T2, 2.18): cheapest paths through the lattice of its words.

A dictionary is a table (unit, cost). Every distinct run of letters is cut once, however often it
stands in the texts: its substrings meet the dictionary in a join, so a dictionary of any size is
shuffled like any other table, and the lattice of a run is what the join gives back. A character
that begins no word on the path is a unit of its own at a fixed cost. Of equally cheap paths the
one with fewer units counts, then the one whose earlier units are longer."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.functions.text import LETTER
from factspan.operators.units import occurrences

UNKNOWN = 10_000
RUNS = f"{LETTER}+"

#: A tokeniser takes (sid, sent) and gives (sid, pos, unit).
Tokeniser = Callable[[DataFrame], DataFrame]


def cheapest(text: str, edges: list[tuple[int, int, int]], unknown: int = UNKNOWN) -> list[str]:
    """The units of the cheapest path; edges are (start, length, cost)."""
    from_: dict[int, list[tuple[int, int]]] = {}
    for start, length, cost in edges:
        from_.setdefault(start, []).append((length, cost))
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (len(text) + 1)  # cost, units, -length of the first unit
    for i in range(len(text) - 1, -1, -1):
        own = [(best[i + n][0] + c, best[i + n][1] + 1, -n) for n, c in from_.get(i, ())]
        own.append((best[i + 1][0] + unknown, best[i + 1][1] + 1, -1))
        best[i] = min(own)
    out, i = [], 0
    while i < len(text):
        out.append(text[i : i - best[i][2]])
        i -= best[i][2]
    return out


def lattice(runs: DataFrame, dictionary: DataFrame, longest: int) -> DataFrame:
    """(run, edges) for runs(run): the words of the dictionary that each holds."""
    d = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start"))
    d = d.withColumn("size", F.explode(F.expr(f"sequence(1, least({longest}, length(run) - start))")))
    d = d.withColumn("unit", F.expr("substring(run, start + 1, size)"))
    words = dictionary.groupBy("unit").agg(F.min(F.col("cost").cast("long")).alias("cost"))
    return d.join(words, "unit").groupBy("run").agg(F.collect_list(F.struct("start", "size", "cost")).alias("edges"))


def segmented(runs: DataFrame, dictionary: DataFrame, unknown: int = UNKNOWN) -> DataFrame:
    """(run, units) of distinct runs(run)."""
    longest = dictionary.agg(F.coalesce(F.max(F.length("unit")), F.lit(1))).first()[0]
    known = runs.join(lattice(runs, dictionary, longest), "run", "left").select("run", "edges")

    def step(batches):
        for b in batches:
            edges = ([(e["start"], e["size"], e["cost"]) for e in es or ()] for es in b.column(1).to_pylist())
            units = [cheapest(t, e, unknown) for t, e in zip(b.column(0).to_pylist(), edges)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.list_(pa.string()))], names=["run", "units"])

    return known.mapInArrow(step, T.StructType([T.StructField("run", T.StringType()), T.StructField("units", T.ArrayType(T.StringType()))]))


def by_letters(sentences: DataFrame) -> DataFrame:
    """The tokeniser that needs no dictionary."""
    return occurrences(sentences)


def by_dictionary(dictionary: DataFrame, unknown: int = UNKNOWN) -> Tokeniser:
    """A tokeniser of runs of letters by cheapest paths over dictionary(unit, cost)."""

    def tokenise(sentences: DataFrame) -> DataFrame:
        runs = sentences.select("sid", F.posexplode(F.regexp_extract_all("sent", F.lit(RUNS), F.lit(0))).alias("n", "run"))
        cut = segmented(runs.select("run").distinct(), dictionary, unknown)
        # a unit's place: the units of earlier runs of its sentence, then those before it in its run
        placed = runs.join(cut, "run").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("n", "units"))).alias("cut"))
        return placed.select("sid", F.posexplode(F.flatten(F.transform("cut", lambda c: c["units"]))).alias("pos", "unit"))

    return tokenise
