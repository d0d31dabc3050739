"""Matches, memberships and verdicts over small keyed sets (survey J10, J19, A8, A13, A20, K7-K9, X4, X6, R5, R11, R13, T15, T16, M10, M12, M13, L2, L15, G6)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def match_all(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events whose arms hold every arm asked for: events(event, arm, phrase), wanted(q, arm,
    phrase). A relational division: as many distinct matches as asked arms."""
    need = wanted.groupBy("q").agg(F.count_distinct("arm", "phrase").alias("need"))
    hit = events.join(wanted, ["arm", "phrase"]).groupBy("q", "event").agg(F.count_distinct("arm", "phrase").alias("got"))
    return hit.join(need, "q").where("got = need").select("q", "event")


def membership(clauses: DataFrame, nests: DataFrame) -> DataFrame:
    """Why a clause belongs to a nest: it names it as centre, else on its path, else it was
    written while the nest was open. clauses(clause, centre, path array<string>, open_nest)."""
    n = nests.select("nest", "head")
    by_centre = clauses.join(n, F.col("centre") == F.col("head")).select("clause", "nest", F.lit(1).alias("rank"))
    by_path = clauses.select("clause", F.explode("path").alias("head")).join(n, "head").select("clause", "nest", F.lit(2).alias("rank"))
    by_context = clauses.where("open_nest is not null").select("clause", F.col("open_nest").alias("nest"), F.lit(3).alias("rank"))
    best = by_centre.union(by_path).union(by_context).groupBy("clause", "nest").agg(F.min("rank").alias("rank"))
    return best.select("clause", "nest", F.element_at(F.array(F.lit("centre"), F.lit("path"), F.lit("context")), F.col("rank")).alias("why"))


def agreement(section: DataFrame, edge: DataFrame, placement: DataFrame, by: str) -> DataFrame:
    """Three winners per key agree, disagree, or one of them points nowhere."""
    d = section.select(by, F.col("winner").alias("a")).join(edge.select(by, F.col("winner").alias("b")), by).join(placement.select(by, F.col("winner").alias("c")), by)
    nowhere = F.col("a").isNull() | F.col("b").isNull() | F.col("c").isNull()
    status = F.when(nowhere, "points_nowhere").when((F.col("a") == F.col("b")) & (F.col("b") == F.col("c")), "agree").otherwise("ratio_disagreement")
    return d.select(by, status.alias("status"), F.when(status == "agree", F.col("a")).alias("unit"))


def seat_key(n: Column, before: Column, adhesion: Column) -> Column:
    """Keys compare by count, then order, then adhesion."""
    return F.struct(n.alias("n"), before.alias("p"), adhesion.alias("a"))


def top_candidates(scored: DataFrame, by: str, k: int = 5, least: int = 2) -> DataFrame:
    """K7: the k best of each key with at least `least` shared units, and whether the first place is tied."""
    w = W.partitionBy(by)
    d = scored.where(F.col("score") >= least).withColumn("best", F.max("score").over(w))
    d = d.withColumn("firsts", F.sum(F.when(F.col("score") == F.col("best"), 1).otherwise(0)).over(w))
    d = d.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "candidate"))).where(F.col("rank") <= k)
    return d.select(by, "candidate", "score", "rank", ((F.col("score") == F.col("best")) & (F.col("firsts") > 1)).alias("tied_with_best"))


def cited(array: str, most: int) -> tuple[Column, Column]:
    """K9: the first citations and how many there are."""
    return F.slice(array, 1, most), F.size(array)


def note_hits(notes: DataFrame, plants: DataFrame) -> DataFrame:
    """notes(kind, turn) against plants(kind, turn): firings, hits, false alarms, plants found."""
    hit = notes.join(plants.distinct(), ["kind", "turn"], "left_semi")
    by = lambda df, name: df.groupBy("kind").agg(F.count(F.lit(1)).alias(name))
    d = by(notes, "firings").join(by(hit, "hits"), "kind", "full_outer").join(by(plants.distinct().join(notes, ["kind", "turn"], "left_semi"), "found"), "kind", "full_outer").join(by(plants.distinct(), "plants"), "kind", "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0))
    return d.select("kind", z("firings").alias("firings"), z("hits").alias("hits"), (z("firings") - z("hits")).alias("false_alarms"), z("found").alias("found"), z("plants").alias("plants"))


def conflicts(contents: DataFrame) -> DataFrame:
    """(tier, centre, arm) seated with two or more different contents."""
    d = contents.where("content is not null and content <> ''").groupBy("tier", "centre", "arm").agg(F.count_distinct("content").alias("n"), F.min("content").alias("one"), F.max("content").alias("other"))
    return d.where("n >= 2")


def unanchored(seated: DataFrame, adhesion: DataFrame) -> DataFrame:
    """Units on an arm for which nothing attests its particle, while another particle
    has at least two sentences."""
    best = adhesion.groupBy("unit").agg(F.max("adj").alias("best"))
    d = seated.join(adhesion.select("unit", "particle", "adj"), ["unit", "particle"], "left").join(best, "unit")
    return d.where("coalesce(adj, 0) = 0 and best >= 2").select("unit", "particle", "best")


def question_echoes(seated: DataFrame, questions: DataFrame) -> DataFrame:
    """Units of two or more characters that the run's question holds."""
    return seated.where(F.length("unit") >= 2).join(questions, "run").where(F.contains(F.lower("question"), F.lower("unit"))).select("run", "unit")


def read_sentences(occ_by_tier: dict[str, DataFrame], sids: DataFrame | None = None) -> DataFrame:
    """The units of asked sentences, or of all, per tier."""
    out = None
    for tier, occ in occ_by_tier.items():
        occ = occ if sids is None else occ.join(sids, "sid", "left_semi")
        one = occ.groupBy("sid").agg(F.lit(tier).alias("tier"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]), "/").alias("units"))
        out = one if out is None else out.union(one)
    return out


def tiers_holding(occ_by_tier: dict[str, DataFrame], surfaces: DataFrame) -> DataFrame:
    """In which tiers a surface is a unit."""
    out = None
    for tier, occ in occ_by_tier.items():
        one = occ.select("unit").distinct().join(surfaces.select("unit").distinct(), "unit").select("unit", F.lit(tier).alias("tier"))
        out = one if out is None else out.union(one)
    return out.groupBy("unit").agg(F.array_join(F.sort_array(F.collect_list("tier")), ",").alias("tiers"))


def swap_moves(seats: DataFrame) -> DataFrame:
    """Every unordered pair of seats; seats are a fixed few dozen."""
    a, b = seats.select(F.col("seat").alias("s")), seats.select(F.col("seat").alias("t"))
    return a.join(F.broadcast(b), F.col("s") < F.col("t"))


def energy_log(placed: DataFrame, energies: DataFrame) -> DataFrame:
    """The energy of every placed unit for every logged query."""
    return placed.select("seed", "unit").join(energies, "unit").select("q", "seed", "unit", "num")


def contract(arms: Column) -> Column:
    """An arm without its innermost seat, which the foundation holds."""
    return F.slice(arms, 1, F.greatest(F.size(arms) - 1, F.lit(0)))


def question_forms(questions: DataFrame) -> DataFrame:
    """The forms a question is tried in: as asked, then under each open topic."""
    topic = F.transform("topics", lambda t: F.struct(F.lit(2).alias("stage"), F.concat(t, F.lit("の"), "question").alias("form")))
    return questions.select("qid", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("stage"), F.col("question").alias("form"))), topic)).alias("x")).select("qid", "x.stage", "x.form")


def owner_text(prompt: Column, tag: str = "system-reminder") -> Column:
    """What is left of a prompt without its system blocks; an unclosed block runs to the end."""
    return F.trim(F.regexp_replace(prompt, rf"(?s)<{tag}>.*?(?:</{tag}>|$)", ""))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """L2: sorted keys, compact, as written; what is no JSON is null."""

    def one(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def redaction_loses_boundary(before: Column, after: Column) -> Column:
    """Did redaction take a sentence end with it?"""
    count = lambda c: F.regexp_count(c, F.lit("[。！？!?\\n]"))
    return count(before) != count(after)


def rules_digest(rules: dict) -> Column:
    """A rule table's version pin as a column."""
    return F.sha2(F.lit(json.dumps(rules, ensure_ascii=False, sort_keys=True)), 256)
