"""Co-occurrence, order and exact energies (survey J1-J3, A4-A7, A26, K2).

Every ratio is a pair of integers. Co-occurrence starts from a given set of asked units: their
groups are found first and only those are joined, so the work is that of the asked units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_positions(occ: DataFrame) -> DataFrame:
    """One row per unit and group: where it stands first."""
    return occ.groupBy("sid", "unit").agg(F.min("pos").alias("pos"))


def cooccurrence(firsts: DataFrame, asked: DataFrame) -> DataFrame:
    """J1-J3 for asked(q): per (q, unit) in how many groups both stand, and in how many q stands
    first. q with itself counts its own groups."""
    q = firsts.join(asked, firsts["unit"] == asked["q"]).select("sid", "q", F.col("pos").alias("q_pos"))
    both = q.join(firsts, "sid")
    return both.groupBy("q", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("q_pos") < F.col("pos"), 1).otherwise(0)).alias("before"))


def energy(freq: DataFrame, pairs: DataFrame) -> DataFrame:
    """A4: numerators over the common denominator N of E_Q(u) = r0(u) + sum of shares with the
    query units; units apart from all of Q keep r0."""
    shared = pairs.groupBy("unit").agg(F.sum("n").alias("shared"))
    return freq.select("unit", "n").join(shared, "unit", "left").select("unit", (F.col("n") + F.coalesce("shared", F.lit(0))).alias("num"))


def unique_argmax(values: DataFrame, by: list[str], unit: str = "unit", value: str = "num") -> DataFrame:
    """A5: the unit with the one greatest, positive value of each group; a tie names none."""
    by = by or ["_all"]
    values = values if by != ["_all"] else values.withColumn("_all", F.lit(0))
    top = values.join(values.groupBy(*by).agg(F.max(value).alias("best")), by)
    top = top.where(F.col(value) == F.col("best")).groupBy(*by, "best").agg(F.count(F.lit(1)).alias("ties"), F.min(unit).alias("one"))
    return top.select(*by, F.when((F.col("ties") == 1) & (F.col("best") > 0), F.col("one")).alias("winner"), F.col("best").alias("value"), "ties").drop("_all")


def edge_flow(pairs: DataFrame, freq: DataFrame, energies: DataFrame) -> DataFrame:
    """A6 per (v, u): the exact summand E(u) * n(u, v) / n(u) as numerator and denominator; the
    common factor 1/N is left out."""
    e = energies.select(F.col("unit").alias("q"), F.col("num").alias("e"))
    n = freq.select(F.col("unit").alias("q"), F.col("n").alias("den"))
    return pairs.where("q <> unit").join(e, "q").join(n, "q").select(F.col("unit").alias("v"), F.col("q").alias("u"), (F.col("e") * F.col("n")).alias("num"), "den")


def binding(firsts: DataFrame) -> DataFrame:
    """Sum of n(u, v) over all neighbours u, with n(v) as denominator: every group gives each of
    its units one for each other unit, so no pairs are made."""
    size = firsts.groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    return firsts.join(size, "sid").groupBy("unit").agg(F.sum(F.col("c") - 1).alias("num"), F.count(F.lit(1)).alias("den"))


def share_groups(pairs: DataFrame) -> DataFrame:
    """K2, K3: units by their co-occurrence count with q, equal counts one group, ordered within
    by number; the members are kept as a count and the first of them."""
    d = pairs.where("q <> unit").groupBy("q", "n").agg(F.count(F.lit(1)).alias("members"), F.min("unit").alias("first_member"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("n"))))


def twins(firsts: DataFrame) -> DataFrame:
    """Classes of units that may change places. With w(u, z) the number of groups in which u
    stands before z, u and v are twins if both have the same w to and from every other unit, and
    w(u, v) = w(v, u).

    No pairs are made. A unit's weights are told by the sum over its groups of the hashes of what
    stands after it, and of what stands before it, for two hashes a unit. If twins stand b times
    before each other, the sums agree once each has b times its own hash put in, so a unit is
    compared under every b up to its number of groups that hold an earlier and a later unit."""
    h = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(1 << 60)).cast("decimal(38,0)")
    d = firsts.select("sid", "unit", "pos", h(1).alias("h1"), h(2).alias("h2"))
    by_pos = d.groupBy("sid", "pos").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    w = W.partitionBy("sid").orderBy("pos")
    to = [F.coalesce(F.sum(s).over(x), F.lit(0)) for x in (w.rowsBetween(1, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, -1)) for s in ("s1", "s2")]
    around = by_pos.select("sid", "pos", *(c.cast("decimal(38,0)").alias(n) for c, n in zip(to, ("a1", "a2", "b1", "b2"))))
    sums = d.join(around, ["sid", "pos"]).groupBy("unit", "h1", "h2").agg(*(F.sum(c).alias(c) for c in ("a1", "a2", "b1", "b2")), F.least(F.count_if(F.col("a1") != 0), F.count_if(F.col("b1") != 0)).alias("most"))
    sums = sums.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), "most")))
    key = [(F.col(c) + F.col("b") * F.col(k)).cast("decimal(38,0)").alias(f"k{c}") for c, k in (("a1", "h1"), ("a2", "h2"), ("b1", "h1"), ("b2", "h2"))]
    keyed = sums.where("a1 <> 0 or b1 <> 0").select("unit", "b", *key)
    found = keyed.groupBy("b", "ka1", "ka2", "kb1", "kb2").agg(F.count(F.lit(1)).alias("members"), F.min("unit").alias("least"), F.max("unit").alias("greatest"))
    return found.where("members > 1").select("members", "least", "greatest")
