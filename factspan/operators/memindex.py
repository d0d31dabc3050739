"""The memory index: a fold of declarations, rows, marks and bridges into tables (survey M2, M4, M5, X9, A16).

A ledger is four tables in one order (`ord`; the ord of a row is its sid):

  declares(session, ord, topic, centre, arms)      rows(sid, session, clauses, words)
  marks(ord, sid, by, reason)                      bridges(ord, qword, phrase)

`clauses` is an array of (shape, centre, arms, value, change, old); `arms` is the chain of
(particle, phrase) from the centre outwards; shape F0 has no centre. The index is a pure function
of the ledger, kept as tables (PARTS), each the union or the merge of what single parts of the
ledger give, or a function of one group:

* `opened` is the topic declared last in each session, `nests` the topics;
* `clauses` are placed: an F4 clause under an open nest is completed to F3 by the nest's centre;
* `members` tie clauses to nests: completed, on the centre, on the chain, or written under it;
* `vocabulary` is where a unit was seen first; a seat's origin is `record` if all its units were
  seen before its sentence, else `constructed` (M4);
* `arms` count the seats of each arm of a cross (tank, centre); a cross has 1 + the most rings;
* `values` are the entries of a position (tank, centre, chain) in slide order, with their kind,
  whether a change names the value before it, and the mark of their sentence;
* `marks` and `bridges` keep the last mark of a sentence and the first bridge of a pair.

`extend` adds a later batch: appended parts look only at the batch, merged ones at equal keys,
and values are made anew for the positions that the batch or its marks touch. What an earlier row
hands to later ones (open topic, previous value) is found in buckets of `ord` first and then over
one row a bucket, so neither a session nor a position is one task."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed value: the tanks, in order.
TANKS = ("F1", "F2", "F3", "F4")
NEST_ARM, GENITIVE, VALUE = "subject", "of", "is"
#: Consecutive ords of one bucket.
BUCKET = 65_536

ARMS = "array<struct<particle: string, phrase: string>>"
POSITION = ("tank", "centre", "chain")


@dataclass(frozen=True)
class Ledger:
    declares: DataFrame
    rows: DataFrame
    marks: DataFrame
    bridges: DataFrame


@dataclass(frozen=True)
class Index:
    opened: DataFrame
    nests: DataFrame
    clauses: DataFrame
    members: DataFrame
    vocabulary: DataFrame
    seats: DataFrame
    arms: DataFrame
    values: DataFrame
    marks: DataFrame
    bridges: DataFrame


PARTS = tuple(f.name for f in fields(Index))


def carried(df: DataFrame, by: list[str], order: list[str], value: str, out: str, inclusive: bool = False, bucket: int = BUCKET) -> DataFrame:
    """df with the last value that is not null in an earlier row (or in this one) of the same group.
    The first column of `order` is a number. Groups are null-safe and may be of any size."""
    keys = [f"_{b}" for b in by]
    d = df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(b).cast("string")), F.lit("")) for k, b in zip(keys, by)})
    d = d.withColumn("_bucket", F.floor(F.col(order[0]) / bucket))
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    last = d.where(F.col(value).isNotNull()).groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    buckets = d.select(*keys, "_bucket").distinct().join(last, [*keys, "_bucket"], "left")
    over = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = buckets.withColumn("_before", F.last("_last", ignorenulls=True).over(over)).drop("_last")
    d = d.withColumn("_inner", F.last(value, ignorenulls=True).over(inner)).join(before, [*keys, "_bucket"])
    return d.withColumn(out, F.coalesce("_inner", "_before")).drop(*keys, "_bucket", "_inner", "_before")


def chain_text(arms: Column) -> Column:
    return F.array_join(F.transform(arms, lambda a: F.concat(a["particle"], F.lit("="), a["phrase"])), ">")


def units_of(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _nests(declares: DataFrame) -> DataFrame:
    first = F.struct("ord", "centre", "arms")
    return declares.groupBy("topic").agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("declared"), F.max("ord").alias("last")).select("topic", "f.ord", "f.centre", "f.arms", "declared", "last")


def _merged_nests(a: DataFrame, b: DataFrame) -> DataFrame:
    d = a.unionByName(b).groupBy("topic").agg(F.min(F.struct("ord", "centre", "arms")).alias("f"), F.sum("declared").alias("declared"), F.max("last").alias("last"))
    return d.select("topic", "f.ord", "f.centre", "f.arms", "declared", "last")


def _opened(declares: DataFrame) -> DataFrame:
    return declares.groupBy("session").agg(F.max_by(F.struct("ord", "topic", "centre", "arms"), "ord").alias("o")).select("session", "o.*")


def _placed(ledger: Ledger, opened: DataFrame) -> DataFrame:
    """The clauses of the rows with the nest open at each, F4 ones completed by it."""
    none = F.lit(None)
    nest = F.struct("topic", "centre", "arms")
    told = ledger.declares.select("session", "ord", nest.alias("nest")).unionByName(opened.select("session", "ord", nest.alias("nest")))
    told = told.withColumns({"clauses": none.cast(dict(ledger.rows.dtypes)["clauses"]), "sid": none.cast("long")})
    rows = ledger.rows.select("session", F.col("sid").alias("ord"), none.cast(dict(told.dtypes)["nest"]).alias("nest"), "clauses", "sid")
    d = carried(told.unionByName(rows), ["session"], ["ord"], "nest", "open", inclusive=True).where("sid is not null")
    d = d.select("sid", "session", "open", F.posexplode("clauses").alias("k", "c")).select("sid", "k", "session", "open", "c.*")
    completed = (F.col("shape") == "F4") & F.col("open").isNotNull()
    subject = F.concat(F.array(F.struct(F.lit(NEST_ARM).alias("particle"), F.col("open.centre").alias("phrase"))), F.col("open.arms"))
    arms = F.when(completed, F.concat("arms", subject)).otherwise(F.col("arms"))
    tank = F.when(completed, "F3").when(F.col("shape") != "F0", F.col("shape"))
    d = d.withColumns({"tank": tank, "via": F.when(completed, "nest"), "nest": F.when(completed, F.col("open.topic")), "arms": F.coalesce(arms, F.array().cast(ARMS))})
    return d.select("sid", "k", "session", "shape", "tank", "centre", "arms", chain_text(F.col("arms")).alias("chain"), "value", "change", "old", "via", "nest", F.col("open.topic").alias("open"))


def _members(clauses: DataFrame, nests: DataFrame) -> DataFrame:
    """(topic, sid, k, kind, exact): how a clause belongs to a nest, by the closest tie. Every tie is an equi-join."""
    c = clauses.where("tank is not null")
    phrases = F.array_distinct(F.transform(F.filter("arms", lambda a: a["particle"] == GENITIVE), lambda a: a["phrase"]))
    have = F.array_append(F.transform("arms", lambda a: a["phrase"]), F.col("centre"))
    c = c.select("sid", "k", "centre", "nest", "open", phrases.alias("owners"), have.alias("have"))
    n = nests.select("topic", F.col("centre").alias("of"), F.transform("arms", lambda a: a["phrase"]).alias("needs"))
    ties = [
        (0, "completed", c.join(n, c["nest"] == n["topic"])),
        (1, "centre", c.join(n, c["centre"] == n["of"])),
        (2, "path", c.withColumn("owner", F.explode("owners")).join(n, F.col("owner") == n["of"]).drop("owner")),
        (3, "context", c.join(n, c["open"] == n["topic"])),
    ]
    exact = {"completed": F.lit(True), "context": F.lit(False)}
    every = None
    for rank, kind, tie in ties:
        tie = tie.select("topic", "sid", "k", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), exact.get(kind, F.size(F.array_except("needs", "have")) == 0).alias("exact"))
        every = tie if every is None else every.union(tie)
    return every.groupBy("topic", "sid", "k").agg(F.min(F.struct("rank", "kind", "exact")).alias("m")).select("topic", "sid", "k", "m.kind", "m.exact")


def _vocabulary(rows: DataFrame) -> DataFrame:
    return rows.select("sid", F.explode("words").alias("unit")).groupBy("unit").agg(F.min("sid").alias("first_sid"))


def _seats(clauses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every seat of every clause: the chain's, each under the ones before it, the value's and the
    centre itself, with the origin of its units."""
    c = clauses.where("tank is not null")
    chain = F.transform("arms", lambda a, i: F.struct(a["particle"].alias("slot"), a["phrase"].alias("phrase"), chain_text(F.slice("arms", F.lit(1), i)).alias("under")))
    own = F.array(F.struct(F.lit("centre").alias("slot"), F.col("centre").alias("phrase"), F.lit("").alias("under")))
    value = F.when(F.col("value").isNotNull(), F.array(F.struct(F.lit(VALUE).alias("slot"), F.col("value").alias("phrase"), F.col("chain").alias("under"))))
    # the subject that a nest completes begins a chain of its own, on the cross
    whole = F.concat(own, chain, F.coalesce(value, F.array().cast("array<struct<slot: string, phrase: string, under: string>>")))
    d = c.select("tank", "centre", "sid", "k", F.posexplode(whole).alias("n", "s")).select("tank", "centre", "sid", "k", "n", "s.*")
    each = d.select("sid", "k", "n", F.explode(F.array_distinct(units_of(F.col("phrase")))).alias("unit"))
    known = each.join(vocabulary, "unit", "left").groupBy("sid", "k", "n").agg(F.min(F.coalesce(F.col("first_sid") < F.col("sid"), F.lit(False)).cast("int")).alias("known"))
    d = d.join(known, ["sid", "k", "n"], "left")
    return d.withColumn("origin", F.when(F.col("known") == 1, "record").otherwise("constructed")).drop("known")


def _arms(seats: DataFrame) -> DataFrame:
    """Seats of each arm of a cross; those deeper in a chain sit on seats, not on the cross."""
    on = seats.where("slot = 'centre' or under = '' or slot = 'is'")
    return on.groupBy("tank", "centre", "slot").agg(F.count(F.lit(1)).alias("seats"), F.min("sid").alias("first_sid"))


def _merged_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("tank", "centre", "slot").agg(F.sum("seats").alias("seats"), F.min("first_sid").alias("first_sid"))


def _values(clauses: DataFrame, marks: DataFrame, bucket: int) -> DataFrame:
    """The entries of each position in slide order. An entry is an update if a change wrote it or
    if its sentence replaces an earlier one of the position by a mark."""
    d = clauses.where("tank is not null and value is not null").select(*POSITION, "sid", "k", "session", F.col("open").alias("scope"), "value", "change", "old")
    d = d.join(marks.select("sid", "by", "reason"), "sid", "left")
    d = carried(d, list(POSITION), ["sid", "k"], "value", "before", bucket=bucket)
    replaced = d.where("by is not null").groupBy(*POSITION, F.col("by").alias("sid")).agg(F.min("sid").alias("replaced"))
    d = d.join(replaced, [*POSITION, "sid"], "left")
    kind = F.when(F.col("before").isNull(), "first").when(F.col("change") | (F.col("replaced") < F.col("sid")), "update").otherwise("other")
    matches = F.when(F.col("change") & F.col("old").isNotNull() & F.col("before").isNotNull(), F.col("old") == F.col("before"))
    return d.select(*POSITION, "sid", "k", "session", "scope", "value", kind.alias("kind"), matches.alias("old_matches"), "by", "reason")


def _marks(marks: DataFrame) -> DataFrame:
    return marks.groupBy("sid").agg(F.max(F.struct("ord", "by", "reason")).alias("m")).select("sid", "m.ord", "m.by", "m.reason")


def _bridges(bridges: DataFrame) -> DataFrame:
    return bridges.groupBy("qword", "phrase").agg(F.min("ord").alias("ord"))


def build(ledger: Ledger, bucket: int = BUCKET) -> Index:
    nests, marks, vocabulary = _nests(ledger.declares), _marks(ledger.marks), _vocabulary(ledger.rows)
    opened = _opened(ledger.declares)
    clauses = _placed(ledger, opened.limit(0))
    seats = _seats(clauses, vocabulary)
    return Index(opened, nests, clauses, _members(clauses, nests), vocabulary, seats, _arms(seats), _values(clauses, marks, bucket), marks, _bridges(ledger.bridges))


def extend(index: Index, batch: Ledger, bucket: int = BUCKET) -> Index:
    """The index of the ledger and a later batch; equal to the index of both together."""
    nests, marks = _merged_nests(index.nests, _nests(batch.declares)), _marks(index.marks.select("ord", "sid", "by", "reason").unionByName(batch.marks.select("ord", "sid", "by", "reason")))
    vocabulary = index.vocabulary.unionByName(_vocabulary(batch.rows)).groupBy("unit").agg(F.min("first_sid").alias("first_sid"))
    clauses = _placed(batch, index.opened)
    new_nests = _nests(batch.declares).join(index.nests, "topic", "left_anti")
    members = index.members.unionByName(_members(clauses, nests)).unionByName(_members(index.clauses, new_nests))
    seats = _seats(clauses, vocabulary)

    # positions with new values, or with values that a new mark retires or justifies
    new = clauses.where("value is not null").select(*POSITION)
    marked = batch.marks.select("sid").unionByName(batch.marks.select(F.col("by").alias("sid"))).distinct()
    touched = new.unionByName(index.values.join(marked, "sid", "left_semi").select(*POSITION)).distinct()
    whole = index.clauses.join(touched, list(POSITION), "left_semi").unionByName(clauses)
    values = index.values.join(touched, list(POSITION), "left_anti").unionByName(_values(whole, marks, bucket))
    opened = _opened(index.opened.unionByName(batch.declares.select("session", "ord", "topic", "centre", "arms")))
    bridges = _bridges(index.bridges.unionByName(_bridges(batch.bridges)))
    return Index(opened, nests, index.clauses.unionByName(clauses), members, vocabulary, index.seats.unionByName(seats), _merged_arms(index.arms, _arms(seats)), values, marks, bridges)


def save(index: Index, folder: str) -> None:
    """Parts are written side by side: each alone is too small a job to fill a cluster."""
    with ThreadPoolExecutor(len(PARTS)) as pool:
        list(pool.map(lambda part: getattr(index, part).write.mode("overwrite").parquet(f"{folder}/{part}"), PARTS))


def load(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{part}") for part in PARTS))


def saved(index: Index, folder: str) -> Index:
    """The index written and read again, part by part, so that nothing is computed twice."""
    spark = index.clauses.sparkSession
    save(index, folder)
    return load(spark, folder)


# ---------------------------------------------------------------- what is asked of an index


def crosses(index: Index) -> DataFrame:
    """One row per cross: its rings are one more than the seats of its fullest arm."""
    arm = ~F.col("slot").isin("centre", VALUE)
    most = F.coalesce(F.max(F.when(arm, F.col("seats"))), F.lit(0))
    count = F.sum(F.when(F.col("slot") != "centre", F.col("seats")).otherwise(0))
    return index.arms.groupBy("tank", "centre").agg((most + 1).alias("rings"), count.alias("seats"), F.min("first_sid").alias("first_sid"))


def centres_with(index: Index, phrases: DataFrame) -> DataFrame:
    """For phrases(phrase): the crosses that hold each, and where (centre, an arm, or an arm below others)."""
    below = F.when((F.col("under") == "") | F.col("slot").isin("centre", VALUE), F.col("slot"))
    where = F.coalesce(below, F.concat(F.regexp_replace("under", "=[^>]*", ""), F.lit(">"), F.col("slot")))
    return index.seats.join(phrases.select("phrase").distinct(), "phrase").select("phrase", "tank", F.col("centre"), where.alias("place")).distinct()


def position_phrase(chain: Column, centre: Column, joint: str) -> Column:
    """The position's phrase as one text: the owners from the outermost to the centre."""
    owners = F.reverse(F.transform(F.split(chain, ">"), lambda a: F.regexp_extract(a, "=(.*)$", 1)))
    return F.when(chain == "", centre).otherwise(F.concat(F.array_join(owners, joint), F.lit(joint), centre))


def positions_of(index: Index, asked: DataFrame) -> DataFrame:
    """For asked(text): the F1 and F2 positions that it names, by the bare centre, by the whole phrase
    with its joints, or by the phrase without them; with the sid of each position's first value."""
    own = index.values.where(F.col("tank").isin("F1", "F2")).groupBy(*POSITION).agg(F.min("sid").alias("since"))
    by = [("centre", F.col("centre")), ("text", position_phrase(F.col("chain"), F.col("centre"), f" {GENITIVE} ")), ("flat", position_phrase(F.col("chain"), F.col("centre"), ""))]
    named = own.withColumn("names", F.array(*(F.struct(F.lit(route).alias("route"), text.alias("text")) for route, text in by)))
    named = named.select(*POSITION, "since", F.explode("names").alias("n")).select(*POSITION, "since", "n.*")
    return named.join(asked.select("text").distinct(), "text").select("text", "route", *POSITION, "since")


def history(index: Index, positions: DataFrame) -> DataFrame:
    """The entries of positions(tank, centre, chain), in slide order by (sid, k)."""
    return index.values.join(positions.select(*POSITION).distinct(), list(POSITION))


def nests_of(index: Index, centres: DataFrame) -> DataFrame:
    """For centres(centre): the nests around each, with how many clauses belong to them by kind."""
    kinds = index.members.groupBy("topic", "kind").agg(F.count(F.lit(1)).alias("n"))
    return index.nests.join(centres.select("centre").distinct(), "centre").join(kinds, "topic").select("centre", "topic", "declared", "kind", "n")


def bridged(index: Index, asked: DataFrame) -> DataFrame:
    """For asked(qword): the positions whose centre a bridge leads to."""
    ends = index.bridges.join(asked.select("qword").distinct(), "qword").select("qword", F.col("phrase").alias("text"))
    return ends.join(positions_of(index, ends).where("route = 'centre'"), "text").select("qword", *POSITION)


def slides(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges from every row to the next one by sid, flagged where the session changes."""
    d = carried(rows.select("sid", "session", F.struct("sid", "session").alias("own"), F.lit(0).alias("all")), ["all"], ["sid"], "own", "prior", bucket=bucket)
    return d.where("prior is not null").select(F.col("prior.sid").alias("sid"), F.col("sid").alias("next"), (F.col("prior.session") != F.col("session")).alias("boundary"))


def note_counts(notes: DataFrame, declares: DataFrame) -> DataFrame:
    """notes(session, ord, note) counted by the topic open where they were made, as of each."""
    none = F.lit(None).cast("string")
    told = declares.select("session", "ord", "topic", none.alias("note")).unionByName(notes.select("session", "ord", none.alias("topic"), "note"))
    d = carried(told, ["session"], ["ord"], "topic", "open", inclusive=True).where("note is not null")
    return d.groupBy("open", "note").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


