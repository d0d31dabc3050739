"""What follows a unit: counts, modes with ties, adhesion (survey A9-A12, A23, A25, K4, X8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.operators.units import with_next

# The ladder of the seven particle ranks, Fibonacci numbers over 377.
LADDER = (233, 144, 89, 55, 34, 21, 13)
LADDER_DEN = 377


def attachments(spans_: DataFrame, particles: tuple[str, ...]) -> DataFrame:
    """Every unit occurrence with a label of what comes next: particle, other or end."""
    d = with_next(spans_)
    label = F.when(F.col("next").isNull(), "end").when(F.col("next").isin(*particles), "particle").otherwise("other")
    return d.select("sid", "pos", "unit", label.alias("label"), F.when(label == "particle", F.col("next")).alias("particle"))


def counts(attached: DataFrame) -> DataFrame:
    return attached.where("label = 'particle'").groupBy("unit", "particle").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("sid").alias("sids"))


def kinds(follower_counts: DataFrame) -> DataFrame:
    """A10: the most frequent particle of a unit, or the whole group of those that tie."""
    top = F.max("c").over(W.partitionBy("unit"))
    d = follower_counts.withColumn("top", top).where("c = top").groupBy("unit", F.col("top").alias("count"))
    d = d.agg(F.sort_array(F.collect_list("particle")).alias("p"))
    return d.select("unit", F.when(F.size("p") == 1, "particle").otherwise("tied").alias("label"), F.array_join("p", ",").alias("particles"), "count")


def weight(particle: Column, particles: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p, w in zip(particles, LADDER):
        out = F.when(particle == p, w).otherwise(out)
    return out


def adhesion(follower_counts: DataFrame, particles: tuple[str, ...]) -> DataFrame:
    """Distinct sentences per (unit, particle), weighted by the ladder numerator."""
    return follower_counts.select("unit", "particle", F.col("sids").alias("adj"), (F.col("sids") * weight(F.col("particle"), particles)).alias("num"))


def read_order(kinds_: DataFrame, particles: tuple[str, ...]) -> DataFrame:
    """K4: single particles by ladder weight, then tied groups; group sizes, no order within."""
    bucket = F.when(F.col("label") == "particle", 1).otherwise(2)
    key = F.when(F.col("label") == "particle", weight(F.col("particles"), particles)).otherwise(0)
    return kinds_.groupBy(bucket.alias("bucket"), "particles", key.alias("weight")).agg(F.count(F.lit(1)).alias("units"), F.min("unit").alias("least"))


def window_counts(attached: DataFrame, sids: DataFrame | None = None) -> DataFrame:
    """Particle counts over a set of sentences, or over all."""
    attached = attached if sids is None else attached.join(sids, "sid", "left_semi")
    return attached.where("label = 'particle'").groupBy("particle").agg(F.count(F.lit(1)).alias("c"))


def anchors(units_: DataFrame, adhesion_: DataFrame, least: int = 2) -> DataFrame:
    """The longest proper suffix, of at least two characters, that has evidence of its own."""
    cut = units_.where(F.length("unit") > least).select("unit", F.explode(F.expr(f"transform(sequence(2, length(unit) - {least} + 1), i -> substring(unit, i))")).alias("suffix"))
    known = adhesion_.select(F.col("unit").alias("suffix")).distinct()
    return cut.join(known, "suffix").groupBy("unit").agg(F.max_by("suffix", F.length("suffix")).alias("anchor"))


def arrangement(seats: DataFrame, adhesion_: DataFrame) -> DataFrame:
    """The adhesion of a seated cross, summed over seats (cross, particle, unit)."""
    a = adhesion_.select("unit", "particle", "num")
    return seats.join(a, ["unit", "particle"], "left").groupBy("cross").agg(F.coalesce(F.sum("num"), F.lit(0)).alias("a_num"), F.count(F.lit(1)).alias("seats"))
