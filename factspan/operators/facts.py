"""Versioned facts: history, live values, notes and verdicts (survey W1-W3, W5, J9-J12, J15, M3, M5-M9, X9).

A fact row is (position, scope, ord, sid, value, change, old). Facts compare within one
position and scope; `ord` is the order they were written in. Positions may be hot: windows
spill, and hold counts, not values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from factspan.operators.folds import ordered_fold

GROUP = ("position", "scope")


def _epochs(facts: DataFrame) -> DataFrame:
    """The epoch (changes so far) and whether the value is new within it."""
    w = W.partitionBy(*GROUP).orderBy("ord")
    d = facts.withColumn("ep", F.sum(F.col("change").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("fresh", F.row_number().over(W.partitionBy(*GROUP, "ep", "value").orderBy("ord")) == 1)


def history(facts: DataFrame) -> DataFrame:
    """Each fact as first, update or other, and whether a change names the value before it."""
    w = W.partitionBy(*GROUP).orderBy("ord")
    kind = F.when(F.row_number().over(w) == 1, "first").when(F.col("change"), "update").otherwise("other")
    return facts.select(*GROUP, "ord", "value", kind.alias("kind"), F.when(F.col("change"), F.col("old") == F.lag("value").over(w)).alias("old_matches"))


def notes(facts: DataFrame) -> DataFrame:
    """SAME_SEAT and UPDATE notes with the number of earlier values they contradict.

    The live values before a row are the distinct values of its epoch so far (of the epoch it
    ends, for a change); a note looks at those of another sentence and another value, but any
    live equal value silences SAME_SEAT. A change is judged in the epoch it ends and observed in
    the one it begins; all counts are running sums, so no row carries the values before it."""
    d = _epochs(facts).drop("fresh")
    own = F.struct(F.col("ep").alias("key"), (~F.col("change")).alias("judged"), F.lit(True).alias("seen"))
    ended = F.struct((F.col("ep") - 1).alias("key"), F.lit(True).alias("judged"), F.lit(False).alias("seen"))
    d = d.withColumn("x", F.explode(F.when(F.col("change"), F.array(ended, own)).otherwise(F.array(own)))).select("*", "x.*").drop("x")

    def before(*by: str):
        return W.partitionBy(*GROUP, "key", *by).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)

    d = d.withColumn("first_sid", F.first(F.when(F.col("seen"), F.col("sid")), ignorenulls=True).over(before("value")))
    d = d.withColumn("same", F.col("first_sid").isNotNull().cast("int")).withColumn("fresh", (F.col("seen") & (F.col("same") == 0)).cast("int"))
    total = lambda *by: F.coalesce(F.sum("fresh").over(before(*by)), F.lit(0))
    d = d.withColumn("live", total()).withColumn("of_sentence", total("sid"))
    d = d.withColumn("earlier_n", F.col("live") - F.col("same") - F.col("of_sentence") + F.when(F.col("first_sid") == F.col("sid"), 1).otherwise(0))
    note = F.when(F.col("change") & ((F.col("earlier_n") > 0) | (F.col("live") == 0)), "UPDATE").when(~F.col("change") & (F.col("earlier_n") > 0) & (F.col("same") == 0), "SAME_SEAT")
    return d.where("judged").withColumn("note", note).where(F.col("note").isNotNull()).select(*GROUP, "ord", "sid", "value", "note", F.col("earlier_n").cast("long").alias("earlier_n"))


def live_values(facts: DataFrame) -> DataFrame:
    """The live values of a group (those of its last epoch) and whether it has history."""
    d = _epochs(facts)
    last = F.max("ep").over(W.partitionBy(*GROUP))
    d = d.withColumn("last", last)
    per = d.groupBy(*GROUP, "value").agg(F.max(F.when(F.col("ep") == F.col("last"), 1).otherwise(0)).alias("live"), F.min("ord").alias("since"))
    return per.groupBy(*GROUP).agg(F.sum("live").alias("n_live"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("live") == 1, F.col("value").cast("string")))), "|").alias("live"), (F.count(F.lit(1)) > F.sum("live")).alias("has_history"))


def fold_partial(facts: DataFrame) -> DataFrame:
    """W2 where a change that names a live old value retires that value alone. Which values are
    live decides what a later change does, so groups are folded in order; the state is the live
    values alone."""
    schema = T.StructType([facts.schema["position"], facts.schema["scope"], T.StructField("live", T.StringType()), T.StructField("n_live", T.LongType()), T.StructField("has_history", T.BooleanType())])

    def step(state, row):
        live, history = state
        _, _, _, value, change, old = row
        if change and old is not None:
            if old in live and old != value:
                live, history = (live - {old}) | {value}, True
        elif change:
            live, history = {value}, history or bool(live - {value})
        else:
            live = live | {value}
        return (live, history), []

    def end(key, state):
        live, history = state
        return [(*key, "|".join(sorted(map(str, live))), len(live), history)]

    return ordered_fold(facts.select(*GROUP, "ord", "value", "change", "old"), list(GROUP), "ord", schema, lambda: (frozenset(), False), step, end)


def verdicts(live: DataFrame) -> DataFrame:
    """M8 per position: ANSWER, UPDATED, CHOICE with its kind, or SUPERSEDED; ties are a choice."""
    d = live.groupBy("position").agg(F.sum("n_live").alias("n"), F.max("n_live").alias("most"), F.max(F.col("has_history").cast("int")).alias("old"), F.count(F.lit(1)).alias("scopes"))
    verdict = F.when(F.col("n") == 0, "SUPERSEDED").when((F.col("n") == 1) & (F.col("old") == 1), "UPDATED").when(F.col("n") == 1, "ANSWER").otherwise("CHOICE")
    kind = F.when(F.col("n") < 2, F.lit("")).when(F.col("most") >= 2, "same_seat").otherwise("scopes")
    return d.select("position", verdict.alias("verdict"), kind.alias("choice_kind"), "n", "scopes")


def recall(asked: DataFrame, routes: list[tuple[str, DataFrame]], found: DataFrame) -> DataFrame:
    """The first route that maps the asked words to positions wins; NONE without one."""
    hits = None
    for rank, (name, route) in enumerate(routes):
        one = asked.join(route, "word").select("word", "position", F.lit(rank).alias("rank"), F.lit(name).alias("route"))
        hits = one if hits is None else hits.union(one)
    best = hits.groupBy("word").agg(F.min("rank").alias("rank"))
    picked = hits.join(best, ["word", "rank"]).join(found, "position", "left")
    return asked.select("word").distinct().join(picked, "word", "left").select("word", F.coalesce("route", F.lit("")).alias("route"), "position", F.coalesce("verdict", F.lit("NONE")).alias("verdict"))


def reversals(relations: DataFrame) -> DataFrame:
    """Relations (kind, first, second, sid) that an earlier sentence states the other way
    round. The earlier ones of a pair are a count and a first sentence, not a list of pairs."""
    stated = relations.where("first <> second").withColumn("up", F.col("first") < F.col("second"))
    lo, hi = F.least("first", "second"), F.greatest("first", "second")
    w = W.partitionBy("kind", lo, hi).orderBy("sid").rangeBetween(W.unboundedPreceding, -1)
    other = lambda up: F.sum(F.when(F.col("up") == up, 1).otherwise(0)).over(w)
    firsts = lambda up: F.min(F.when(F.col("up") == up, F.col("sid"))).over(w)
    d = stated.withColumn("earlier_n", F.when(F.col("up"), other(False)).otherwise(other(True))).withColumn("earlier", F.when(F.col("up"), firsts(False)).otherwise(firsts(True)))
    return d.where("earlier_n > 0").select("kind", "first", "second", "sid", F.col("earlier_n").cast("long"), "earlier")


def enumerations(facts: DataFrame) -> DataFrame:
    """J12, reason nest: at the first fact of a group that is no change, how many other scopes of
    the position hold live values all different from it, as of that row.

    Live values as of a row are a running fact of the scope; scopes of a position are few (they
    are topics), rows are not, so rows are reduced to changes of live state first."""
    d = _epochs(facts)
    first = F.row_number().over(W.partitionBy(*GROUP).orderBy("ord")) == 1
    opened = d.withColumn("first", first).where("first and not change").select("position", "scope", "ord", "value", "sid")
    state = d.where("fresh").select("position", F.col("scope").alias("s2"), F.col("ord").alias("o2"), "ep", F.col("value").alias("v2"))
    o, s = opened.alias("o"), state.alias("s")
    past = o.join(s, (F.col("o.position") == F.col("s.position")) & ~F.col("o.scope").eqNullSafe(F.col("s.s2")) & (F.col("s.o2") < F.col("o.ord")))
    past = past.select("o.position", "o.scope", "o.ord", "o.sid", "o.value", "s.s2", "s.ep", "s.v2")
    last = F.max("ep").over(W.partitionBy("position", "scope", "s2"))
    per = past.withColumn("last", last).where("ep = last").groupBy("position", "scope", "ord", "sid", "value", "s2").agg(F.max((F.col("v2") == F.col("value")).cast("int")).alias("same"))
    return per.where("same = 0").groupBy("position", "scope", "ord", "sid", "value").agg(F.count(F.lit(1)).alias("others_n"))


def open_topics(rows: DataFrame) -> DataFrame:
    """The topic declared last in the session before or at a row."""
    w = W.partitionBy("session").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("topic", F.last("declared", ignorenulls=True).over(w))


def supersede_verdicts(requests: DataFrame) -> DataFrame:
    """A request (id, new_turn, old_turn, new_sourced, old_sourced) per retired row is
    good if every retired turn is strictly earlier and both sides come from the user."""
    sourced = F.min((F.col("new_sourced") & F.col("old_sourced")).cast("int"))
    later = F.min(F.coalesce((F.col("new_turn") > F.col("old_turn")).cast("int"), F.lit(0)))
    d = requests.groupBy("id").agg(sourced.alias("sourced"), later.alias("later"), F.count(F.lit(1)).alias("retired"))
    return d.select("id", F.when(F.col("sourced") == 0, "unsourced_order").when(F.col("later") == 0, "supersede_order").otherwise("ok").alias("verdict"), "retired")


def ranked_seats(seats: DataFrame, by: list[str], key: list[Column]) -> DataFrame:
    """Seats of an arm by key, ties by the earlier sentence; the ring is the rank."""
    return seats.withColumn("ring", F.row_number().over(W.partitionBy(*by).orderBy(*(F.desc(k) for k in key), "sid")))


def emit_decision(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first failing check, or emit."""
    return F.coalesce(*(F.when(failed, code) for code, failed in checks), F.lit("emit"))


def holding(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """The positions that ever held an asked value, and since when."""
    return facts.join(asked.select("value").distinct(), "value").groupBy("value", "position").agg(F.min("ord").alias("since"), F.count(F.lit(1)).alias("times"))


def note_counts(facts: DataFrame) -> DataFrame:
    """Facts by scope and epoch (how many changes their position had seen by then)."""
    so_far = W.partitionBy("position", "scope").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    epoch = F.sum(F.col("change").cast("int")).over(so_far)
    return facts.select("scope", epoch.alias("epoch")).groupBy("scope", "epoch").agg(F.count(F.lit(1)).alias("n"))
