"""Dictionary units, components, agreement and assembly against brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factspan.operators import assembly, blocks, components, geometry, segment, units
from factspan.plans.catalogue import QUERIES


def every_cut(run):
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        yield [run[a:b] for a, b in zip(cuts, cuts[1:])]


def plain_cut(run, costs):
    fits = [c for c in every_cut(run) if all(u in costs or len(u) == 1 for u in c)]
    return min(fits, key=lambda c: (sum(min(costs.get(u, segment.UNKNOWN), segment.UNKNOWN if len(u) == 1 else costs.get(u, 0)) for u in c), len(c), [-len(u) for u in c]))


def test_cheapest_paths_are_those_of_all_cuts(spark):
    rng = random.Random(2)
    costs = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.choice([5, 10, 10, 20, 30]) for _ in range(25)}
    runs = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 10))) for _ in range(150)}
    dictionary = spark.createDataFrame([*costs.items(), *((u, c + 3) for u, c in costs.items())], "unit string, cost int")
    got = {r.run: list(r.units) for r in segment.segmented(spark.createDataFrame([(r,) for r in runs], "run string"), dictionary).collect()}
    assert got == {r: plain_cut(r, costs) for r in runs}


def test_a_tokeniser_is_pluggable(spark):
    sents = spark.createDataFrame([(1, "今日は東京駅。東京"), (2, None), (3, "..."), (4, "x" * 3000)], "sid long, sent string")
    dictionary = spark.createDataFrame([("今日", 10), ("は", 5), ("東京", 10), ("東京駅", 15), ("駅", 10)], "unit string, cost int")
    rows = segment.by_dictionary(dictionary)(sents).orderBy("sid", "pos").collect()
    assert [(r.pos, r.unit) for r in rows if r.sid == 1] == [(0, "今日"), (1, "は"), (2, "東京駅"), (3, "東京")]
    assert sum(r.sid == 4 for r in rows) == 3000 and {r.sid for r in rows} == {1, 4}
    assert [r.unit for r in segment.by_letters(sents).where("sid = 1").orderBy("pos").collect()] == ["今日は東京駅", "東京"]
    none = spark.createDataFrame([], "unit string, cost int")
    assert segment.by_dictionary(none)(sents).where("sid = 1").count() == 8


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "none"])
def test_components(spark, shape):
    rng = random.Random(7)
    nodes = list(range(90))
    order = rng.sample(nodes, 90)
    links = {"random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "chain": list(zip(order, order[1:])), "none": []}[shape]
    got = components.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == roots(nodes, links)


def test_agreement_of_maximal_statements(spark):
    rows = [
        (1, 10, 0, 9, "the Red Gate"), (1, 10, 4, 9, "Red Gate"), (1, 11, 0, 5, "red gate!"), (1, 12, 3, 6, "Red, Gate"), (1, 13, 0, 2, "blue"),
        (1, 13, 4, 9, "Red Gate"), (1, 14, 0, 4, "Blue"), (1, 15, 0, 1, "..."), (2, 10, 0, 4, "blue"), (1, 16, 0, 4, "other"), (1, 16, 0, 4, "Other"),
    ]
    told = components.statements(spark.createDataFrame(rows, "qid long, sid long, start int, end int, text string"))
    assert Counter((r.qid, r.sid, r.form) for r in told.collect()) == Counter([(1, 10, "theredgate"), (1, 11, "redgate"), (1, 12, "redgate"), (1, 13, "blue"), (1, 13, "redgate"), (1, 14, "blue"), (2, 10, "blue"), (1, 16, "other")])
    got = {(r.qid, r.sid): r.group for r in components.agreement(told).collect()}
    assert got == {(1, 10): 10, (1, 11): 11, (1, 12): 11, (1, 13): 11, (1, 14): 11, (2, 10): 10, (1, 16): 16}


def test_assembly_names_the_tiers_that_tile(spark):
    text = "ab cde f"
    tiers = [("WORD", 0, 0, 2), ("WORD", 1, 3, 6), ("WORD", 2, 7, 8)] + [("CHAR", i, i, i + 1) for i in range(8) if text[i] != " "] + [("RUN", 0, 0, 2), ("RUN", 1, 3, 8)]
    rows = [(t, 1, i, text[a:b], a, b) for t, i, a, b in tiers]
    tier_units = spark.createDataFrame(rows, "tier string, sid long, idx long, unit string, start long, end long")
    entries = spark.createDataFrame([("q", "WORD", "ab", 1), ("q", "CHAR", "c", 1), ("r", "CHAR", "d", 1), ("r", "CHAR", "b", 1), ("q", "WORD", "zz", 1)], "entry string, tier string, unit string, sid long")
    got = assembly.assemble(tier_units, entries, spark.createDataFrame([(1, text)], "sid long, sent string")).orderBy("begin").collect()
    assert [(r.begin, r.until, r.text, r.parts, r.entries, r.aligned, r.coarsest) for r in got] == [(0, 2, "ab", 2, 2, "RUN,WORD,CHAR", "RUN"), (3, 5, "cd", 2, 2, "CHAR", "CHAR")]


def test_words_assemble_in_place_as_their_units_do(spark):
    texts = ["", "...", "ee e tee eel see-eye", "été ee", "the 𝒆𐐀e eé e\u0301e beet", "abc eee e", "x" * 50 + "e" * 30 + "xexxe", "a-b ebe 3e e3"]
    sents = spark.createDataFrame([(i * 7 + k, t) for i, t in enumerate(texts) for k in (0, 1)], "sid long, sent string")
    word = units.spans(sents).selectExpr("'WORD' tier", "sid", "bigint(pos) idx", "unit", "bigint(start) start", "bigint(end) end")
    char = word.selectExpr("'CHAR' tier", "sid", "start", "posexplode(split(unit, '')) (k, unit)").where("unit <> ''").selectExpr("tier", "sid", "start + k idx", "unit", "start + k start", "start + k + 1 end")
    tiers = word.union(char)
    asked = tiers.where("(tier = 'WORD' and length(unit) = 3 and sid % 7 = 0) or (tier = 'CHAR' and unit = 'e')").selectExpr("unit entry", "tier", "unit", "sid").distinct()
    want = assembly.assemble(tiers, asked, sents).drop("entries")
    got = assembly.assemble_words(units.spans(sents), F.expr("length(unit) = 3 and sid % 7 = 0"), "e")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 30


def test_assembly_query_shuffles_no_units(spark):
    plan = QUERIES["r14_assembly"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "Join" not in plan


def test_expanded_counts_are_those_of_enumeration(spark):
    rng = random.Random(9)
    placed, labels, want = [], [], {}
    for seed in range(25):
        seats = rng.sample([(a, p) for a in range(3) for p in range(2)], rng.randint(1, 6))
        label = {f"u{k}": rng.choice("xy") for k in range(len(seats))}
        placed += [(seed, a, p, f"u{k}") for k, (a, p) in enumerate(seats)] + [(seed, None, 0, "centre")]
        labels += [(seed, u, x) for u, x in label.items()]
        own = dict(zip(label, seats))
        seen = set()
        for order in itertools.permutations(label):
            if all(label[u] == label[v] for u, v in zip(label, order)):
                at = {own[u]: v for u, v in zip(label, order)}
                seen.add(tuple(sorted(tuple(at.get((a, p)) or "" for p in range(2)) for a in range(3))))
        want[seed] = len(seen)
    got = geometry.expanded_count(spark.createDataFrame(placed, "seed int, arm int, place int, unit string"), spark.createDataFrame(labels, "seed int, unit string, label string"))
    assert {r.seed: r.arrangements for r in got.collect()} == want


def test_equals_of_a_pool(spark):
    weights = [(1, "a", "b", 5), (1, "a", "c", 2), (1, "b", "c", 2), (1, "a", "d", 1), (1, "b", "d", 1), (1, "c", "d", 7), (2, "a", "b", 1), (3, "a", "c", 4), (3, "b", "c", 4), (3, "a", "d", 0), (3, "b", "d", 3)]
    got = geometry.equals(spark.createDataFrame(weights, "seed int, u string, v string, n int")).collect()
    assert {(r.seed, r.unit, r.label) for r in got} == {(1, "a", "a"), (1, "b", "a"), (2, "a", "a"), (2, "b", "a")}


def test_conjunctions_over_blocks(spark):
    rng = random.Random(3)
    once = [(u, s) for u, n in (("a", 200), ("b", 60), ("c", 9), ("d", 1)) for s in rng.choices(range(-50, 400), k=n)]
    asks = [(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["d"]), (4, ["a", "none"]), (5, ["c", "c", "a"])]
    held = {u: {s for x, s in once if x == u} for u in "abcd"}
    want = {(q, s) for q, us in asks for s in set.intersection(*(held.get(u, set()) for u in us))}
    d = spark.createDataFrame(once, "unit string, sid long")
    asked = spark.createDataFrame([(q, u) for q, us in asks for u in us], "qid int, unit string")
    for width in (8, blocks.WIDTH):
        got = blocks.conjunctions(blocks.blocks(d, width), asked, width).collect()
        assert {(r.qid, r.sid) for r in got} == want and len(got) == len(want)
