"""Crosses: rotations, seats, alignment, placement (survey R1-R4, R6-R10, A8)."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ARMS = 6


def _perms() -> list[tuple[int, ...]]:
    """The proper rotations of a cube as arm permutations: opposite arms stay opposite, and the
    orientation of the three axes is kept."""
    found = []
    for p in itertools.permutations(range(ARMS)):
        if any(p[i ^ 1] != p[i] ^ 1 for i in range(ARMS)):
            continue
        axes = [p[2 * i] // 2 for i in range(3)]
        flips = sum(p[2 * i] % 2 for i in range(3))
        swaps = sum(axes[a] > axes[b] for a in range(3) for b in range(a + 1, 3))
        if (flips + swaps) % 2 == 0:
            found.append(p)
    return found


PERMS = _perms()


def rotations(spark: SparkSession) -> DataFrame:
    """(rotation, arm, image), 24 by 6."""
    return spark.createDataFrame([(r, a, p[a]) for r, p in enumerate(PERMS) for a in range(ARMS)], "rotation int, arm int, image int")


def compositions(rot: DataFrame) -> DataFrame:
    """G after h for all g and h, by its arms."""
    g, h = rot.alias("g"), rot.alias("h")
    d = h.join(g, F.col("h.image") == F.col("g.arm")).select(F.col("g.rotation").alias("g"), F.col("h.rotation").alias("h"), F.col("h.arm").alias("arm"), F.col("g.image").alias("image"))
    key = lambda df, by: df.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("arm", "image"))), lambda x: x["image"].cast("string")), "").alias("perm"))
    return key(d, ["g", "h"]).join(F.broadcast(key(rot, ["rotation"])), "perm").select("g", "h", "rotation")


def seats(spark: SparkSession, length: int) -> DataFrame:
    """R2: (seat, arm, k); seat 0 is the centre, k 0 the outer end."""
    arms = spark.range(ARMS).select(F.col("id").cast("int").alias("arm"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k"))
    return spark.sql("select 0 as seat, -1 as arm, 0 as k").union(arms.select(F.col("arm") * length + F.col("k") + 1, "arm", "k"))


def edges(seats_: DataFrame, length: int) -> DataFrame:
    """R2: neighbours along the arms and to the centre."""
    return seats_.where("arm >= 0").select("seat", F.when(F.col("k") == length - 1, 0).otherwise(F.col("seat") + 1).cast("int").alias("towards"))


def canonical(crosses: DataFrame, rot: DataFrame) -> DataFrame:
    """(cross, arm, content) to the least serialisation over all 24 rotations."""
    turned = crosses.join(F.broadcast(rot), "arm").groupBy("cross", "rotation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("image", "content"))), lambda x: x["content"]), "/").alias("key"))
    return turned.groupBy("cross").agg(F.min("key").alias("key"))


def align(counts: DataFrame, rot: DataFrame) -> DataFrame:
    """(id, arm, data_arm, c): every rotation's score, all of the best kept."""
    scored = counts.join(F.broadcast(rot), (counts["arm"] == rot["arm"]) & (counts["data_arm"] == rot["image"])).groupBy("id", "rotation").agg(F.sum("c").alias("score"))
    return scored.withColumn("_r", F.rank().over(W.partitionBy("id").orderBy(F.desc("score")))).where("_r = 1").drop("_r")


def visible(rot: DataFrame, window: int = 1) -> DataFrame:
    """The arms a world section sees: those whose image is within `window` on the ring of six."""
    d = rot.withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(ARMS - 1))))
    apart = F.pmod(F.col("image") - F.col("section"), F.lit(ARMS))
    return d.where((apart <= window) | (apart >= ARMS - window)).select("rotation", "section", "arm")


def place(weights: DataFrame, length: int, max_moves: int = 400_000) -> DataFrame:
    """Per seed, units of its pool are seated greedily, most shared first, each in the free
    seat that adds most weight to its neighbours; then the best improving swap is made until
    none improves or the budget is spent. weights is (seed, u, v, n) with u < v; pools are small.
    Returns (seed, seat, unit, score, stop)."""
    links = {s: set() for s in range(ARMS * length + 1)}
    for arm in range(ARMS):
        for k in range(length):
            a = arm * length + k + 1
            b = 0 if k == length - 1 else a + 1
            links[a].add(b)
            links[b].add(a)
    order = sorted(links, key=lambda s: (0 if s == 0 else length - (s - 1) % length, s))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = pdf["seed"].iloc[0]
        n = {}
        for u, v, c in zip(pdf["u"], pdf["v"], pdf["n"]):
            n[u, v] = n[v, u] = int(c)
        pool = sorted({x for uv in n for x in uv})
        total = {u: sum(n.get((u, v), 0) for v in pool) for u in pool}
        pool.sort(key=lambda u: (-total[u], u))
        at: dict[int, object] = {}
        add = lambda s, u, skip=None: sum(n.get((u, at[t]), 0) for t in links[s] if t in at and t != skip)
        for u in pool[: len(order)]:
            free = [s for s in order if s not in at]
            at[max(free, key=lambda s: (add(s, u), -order.index(s)))] = u
        moves, stop = 0, "stable"
        while True:
            best, pick = 0, None
            taken = sorted(at)
            for i, s in enumerate(taken):
                for t in taken[i + 1 :]:
                    moves += 1
                    gain = add(s, at[t], t) + add(t, at[s], s) - add(s, at[s], t) - add(t, at[t], s)
                    if gain > best:
                        best, pick = gain, (s, t)
            if pick is None:
                break
            if moves > max_moves:
                stop = "budget"
                break
            s, t = pick
            at[s], at[t] = at[t], at[s]
        score = sum(n.get((at[s], at[t]), 0) for s in at for t in links[s] if t in at and s < t)
        return pd.DataFrame({"seed": [seed] * len(at), "seat": list(at), "unit": list(at.values()), "score": [score] * len(at), "stop": [stop] * len(at)})

    kind = weights.schema["u"].dataType.simpleString()
    return weights.groupBy("seed").applyInPandas(run, f"seed {weights.schema['seed'].dataType.simpleString()}, seat int, unit {kind}, score long, stop string")


def improving_swaps(placed: DataFrame, weights: DataFrame, edges_: DataFrame) -> DataFrame:
    """An independent check of placements in joins: the greatest gain of any swap of two
    seated units per seed, which is at most 0 where the placement is stable."""
    both = edges_.union(edges_.select(F.col("towards"), F.col("seat"))).toDF("s", "t")
    n = weights.select("seed", "u", "v", "n").union(weights.select("seed", F.col("v"), F.col("u"), "n"))
    p = placed.select("seed", "seat", "unit")
    # weight of unit x on seat s, by the units on the seats next to it
    near = p.join(F.broadcast(both), p["seat"] == F.col("t")).select("seed", "s", F.col("t"), F.col("unit").alias("v"))
    gain = near.join(n, ["seed", "v"]).select("seed", "s", "t", F.col("u").alias("x"), "n")
    whole = gain.groupBy("seed", "s", "x").agg(F.sum("n").alias("w"))
    a, b = p.toDF("seed", "s1", "u1"), p.toDF("seed", "s2", "u2")
    pairs = a.join(b, "seed").where("s1 < s2")
    touch = F.broadcast(both.select(F.col("s").alias("s1"), F.col("t").alias("s2"), F.lit(1).alias("touch")))

    def with_weight(d: DataFrame, seat: str, unit: str, name: str) -> DataFrame:
        return d.join(whole.select("seed", F.col("s").alias(seat), F.col("x").alias(unit), F.col("w").alias(name)), ["seed", seat, unit], "left").fillna(0, [name])

    for seat, unit, name in (("s1", "u1", "w11"), ("s2", "u2", "w22"), ("s1", "u2", "w12"), ("s2", "u1", "w21")):
        pairs = with_weight(pairs, seat, unit, name)
    m = n.toDF("seed", "u1", "u2", "m")
    pairs = pairs.join(touch, ["s1", "s2"], "left").join(m, ["seed", "u1", "u2"], "left").fillna(0, ["touch", "m"])
    # side by side, the two keep their own link: it is counted in w11 and w22 but in neither w12 nor w21
    delta = F.col("w12") + F.col("w21") - F.col("w11") - F.col("w22") + 2 * F.col("touch") * F.col("m")
    return pairs.groupBy("seed").agg(F.max(delta).alias("best_gain"), F.count(F.lit(1)).alias("swaps"))


def equals(weights: DataFrame) -> DataFrame:
    """(seed, unit, label) of units that have a twin in their pool: a unit with the same weight to
    every third unit. The label is the least of a class. Pools are small, so is their square."""
    both = weights.select("seed", "u", "v", "n").union(weights.select("seed", F.col("v"), F.col("u"), "n"))
    own = both.where("n <> 0").groupBy("seed", "u").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("to"))
    pool = both.select("seed", "u").distinct().join(own, ["seed", "u"], "left").withColumn("to", F.coalesce("to", F.create_map().cast(own.schema["to"].dataType)))
    a, b = pool.toDF("seed", "u", "to_u"), pool.toDF("seed", "v", "to_v")
    pairs = a.join(b, "seed").where("u <> v")
    bare = lambda to, k: F.array_sort(F.map_entries(F.map_filter(to, lambda x, _: x != k)))
    twins = pairs.where(bare(F.col("to_u"), F.col("v")) == bare(F.col("to_v"), F.col("u")))
    return twins.groupBy("seed", F.col("u").alias("unit")).agg(F.least(F.min("v"), F.first("u")).alias("label"))


def expanded_count(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """How many arrangements a placement (seed, arm, place, unit) stands for when the units of a
    class may change seats: a factorial for each class, divided by one for each set of equal arms,
    since which arm is which is not told apart. Seats of no arm (the centre) have a null arm."""
    d = placed.join(labels.select("seed", "unit", "label"), ["seed", "unit"], "left").withColumn("label", F.coalesce("label", "unit").cast("string"))
    classes = d.groupBy("seed", "label").agg(F.count(F.lit(1)).alias("k"))
    arms = d.where("arm is not null").groupBy("seed", "arm").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("leg"))
    legs = arms.groupBy("seed", "leg").agg(F.count(F.lit(1)).alias("k"))
    product = lambda c: F.aggregate(F.collect_list(c), F.lit(1).cast("decimal(38,0)"), lambda p, k: (p * F.factorial(k).cast("decimal(20,0)")).cast("decimal(38,0)"))
    up = classes.groupBy("seed").agg(product(F.col("k").cast("int")).alias("up"))
    down = legs.groupBy("seed").agg(product(F.col("k").cast("int")).alias("down"))
    return up.join(down, "seed", "left").select("seed", (F.col("up") / F.coalesce("down", F.lit(1).cast("decimal(38,0)"))).cast("decimal(38,0)").cast("long").alias("arrangements"))
