"""Postings in blocks with a skip key (survey O2, J1, X3).

The sentences of a unit are kept as offsets within blocks of WIDTH consecutive ids, two bytes each.
The block's number is the skip key: what an AND of units needs from each of them is only the blocks
that all of them have, so a frequent unit is read where its rarest partner is, and what is shuffled
are blocks, not occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 15


def blocks(once: DataFrame, width: int = WIDTH) -> DataFrame:
    """(unit, block, offsets) of once(unit, sid): sorted offsets, each sentence once."""
    d = once.select("unit", F.floor(F.col("sid") / width).alias("block"), F.pmod("sid", F.lit(width)).cast("smallint").alias("offset"))
    return d.groupBy("unit", "block").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))


def conjunctions(blocks_: DataFrame, asked: DataFrame, width: int = WIDTH) -> DataFrame:
    """(qid, sid) of the sentences that hold all units of asked(qid, unit).

    A block counts for a question once every unit has it; then the shortest list comes first and
    the others are only asked for what is still left."""
    wanted = asked.select("qid", "unit").distinct()
    need = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    # the skip keys alone decide first which blocks of which units are read at all
    keys = blocks_.select("unit", "block", F.size("offsets").alias("n")).join(wanted, "unit")
    full = keys.groupBy("qid", "block").agg(F.count(F.lit(1)).alias("have")).join(need, "qid").where("have = need").select("qid", "block")
    lists = full.join(wanted, "qid").join(blocks_, ["unit", "block"]).groupBy("qid", "block").agg(F.array_sort(F.collect_list(F.struct(F.size("offsets").alias("n"), "offsets"))).alias("lists"))
    left = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0))["offsets"], lambda kept, x: F.array_intersect(kept, x["offsets"]))
    return lists.select("qid", "block", F.explode(left).alias("offset")).select("qid", (F.col("block") * width + F.col("offset")).alias("sid"))
