"""Span joins and merges (survey J5-J7, J20, W4, W6, W14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def merge(spans_: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Maximal runs of overlapping or touching spans per group (gaps and islands)."""
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = spans_.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    d = d.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*by, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("parts"))


def contained(inner: DataFrame, outer: DataFrame, by: str) -> DataFrame:
    """Inner spans within an outer span of the same key."""
    i, o = inner.alias("i"), outer.alias("o")
    cond = (F.col(f"i.{by}") == F.col(f"o.{by}")) & (F.col("i.start") >= F.col("o.start")) & (F.col("i.end") <= F.col("o.end"))
    return i.join(o, cond).select(F.col(f"i.{by}").alias(by), F.col("o.start").alias("o_start"), F.col("o.end").alias("o_end"), F.col("i.start").alias("start"), F.col("i.end").alias("end"))


def tiled(within: DataFrame, by: str) -> DataFrame:
    """Outer spans that their inner spans cover without gap or overlap."""
    d = within.groupBy(by, "o_start", "o_end").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.sum(F.col("end") - F.col("start")).alias("covered"))
    return d.where("lo = o_start and hi = o_end and covered = o_end - o_start").select(by, "o_start", "o_end")


def islands(gaps_: DataFrame, breaks: str) -> DataFrame:
    """Units of a sentence numbered by clause: a gap that matches `breaks` ends one."""
    w = W.partitionBy("sid").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return gaps_.withColumn("clause", F.coalesce(F.sum(F.when(F.col("gap").rlike(breaks), 1).otherwise(0)).over(w), F.lit(0)))


def session_ranges(rows: DataFrame, session: str, order: str) -> DataFrame:
    """First and last row of every session."""
    return rows.groupBy(session).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
