"""Units, postings and look-ups (survey T1-T5, X1-X8, A1-A3, O1-O6).

A sentence id is doc_id * PER_DOC + k: ordered, and made without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.functions.text import LETTER, strip_attribution

PER_DOC = 1_000_000
#: Sentence ids of one unit are kept in arrays per block of ids, so none outgrows a row.
BLOCK = 4096
TIERS = {"WORD": f"{LETTER}+", "CHAR": LETTER}


#: Runs of one script; kana between content runs are units of their own.
RUN = r"[\p{IsHan}\p{IsKatakana}ー々]+|\p{IsHiragana}+|[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{N}\p{M}]+"


def runs(c: Column) -> Column:
    """The RUN tier of a sentence, its attribution left out."""
    return F.regexp_extract_all(strip_attribution(c), F.lit(RUN), F.lit(0))


def without(occ: DataFrame, functions: DataFrame) -> DataFrame:
    """P2 for a listed set of function units."""
    return occ.join(functions.select("unit").distinct(), "unit", "left_anti")


def sentence_ids(sentences: DataFrame) -> DataFrame:
    fits = F.col("k") < PER_DOC
    sid = F.when(fits, F.col("doc_id") * PER_DOC + F.col("k")).otherwise(F.raise_error(F.lit(f"a document has more than {PER_DOC} sentences")))
    return sentences.select(sid.cast("long").alias("sid"), "doc_id", "k", "sent")


def units(c: Column, tier: str = "WORD") -> Column:
    """The letters rule per tier, surfaces as written."""
    return F.regexp_extract_all(c, F.lit(TIERS[tier]), F.lit(0))


def occurrences(sentences: DataFrame, tier: str = "WORD", keep: tuple[str, ...] = ("sid",)) -> DataFrame:
    """T4 without offsets: one row per unit of a sentence, in order."""
    return sentences.select(*keep, F.posexplode(units(F.col("sent"), tier)).alias("pos", "unit"))


def neighbours(sentences: DataFrame, tier: str = "WORD") -> DataFrame:
    """Occurrences with the unit that comes next, read off the sentence itself: nothing is shuffled."""
    d = sentences.select("sid", units(F.col("sent"), tier).alias("u"))
    rows = F.transform("u", lambda x, i: F.struct(x.alias("unit"), F.get("u", i + 1).alias("next")))
    return d.select("sid", F.posexplode(rows).alias("pos", "x")).select("sid", "pos", "x.unit", "x.next")


def once(sentences: DataFrame, tier: str = "WORD") -> DataFrame:
    """Each unit once per sentence; nothing is shuffled."""
    return sentences.select("sid", F.explode(F.array_distinct(units(F.col("sent"), tier))).alias("unit"))


def with_next(occ: DataFrame) -> DataFrame:
    """Occurrences with the unit after each: as they are if they have it, else by a window."""
    return occ if "next" in occ.columns else occ.withColumn("next", F.lead("unit").over(W.partitionBy("sid").orderBy("pos")))


def spans(sentences: DataFrame, tier: str = "WORD") -> DataFrame:
    """T4: units with half-open code-point spans, found from the texts between them."""
    d = sentences.select("sid", "sent", units(F.col("sent"), tier).alias("u"), F.split("sent", TIERS[tier], -1).alias("gaps"))
    ends = F.expr("""aggregate(sequence(0, size(u) - 1), cast(array() as array<int>), (acc, i) ->
        concat(acc, array(coalesce(try_element_at(acc, -1), 0) + length(gaps[i]) + length(u[i]))))""")
    d = d.where(F.size("u") > 0).withColumn("ends", ends)
    d = d.select("sid", "sent", F.posexplode(F.arrays_zip("u", "ends")).alias("pos", "x"))
    return d.select("sid", "pos", F.col("x.u").alias("unit"), (F.col("x.ends") - F.length("x.u")).alias("start"), F.col("x.ends").alias("end"), "sent")


def gaps(spans_: DataFrame) -> DataFrame:
    """T5: the text between a unit and the next one of its sentence."""
    nxt = F.lead("start").over(W.partitionBy("sid").orderBy("pos"))
    d = spans_.withColumn("next", nxt).where(F.col("next").isNotNull())
    return d.select("sid", "pos", F.expr("substring(sent, end + 1, next - end)").alias("gap"))


def postings(distinct: DataFrame, tier: str) -> DataFrame:
    """X1 in blocks: (tier, unit, block, sids), every array at most BLOCK ids long, from rows that
    name a unit once per sentence. Appending sentences (X2) is the union of two postings where no
    block is shared."""
    d = distinct.select(F.lit(tier).alias("tier"), "unit", F.floor(F.col("sid") / BLOCK).alias("block"), "sid")
    return d.groupBy("tier", "unit", "block").agg(F.sort_array(F.collect_list("sid")).alias("sids"))


def append_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Equal to a rebuild over the sentences of both."""
    return old.unionByName(new).groupBy("tier", "unit", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sids")))).alias("sids"))


def frequencies(sentences: DataFrame, tier: str = "WORD") -> DataFrame:
    """A1: in how many sentences a unit stands, its occurrences, and where it stands first. A sentence
    gives one row per occurrence and one per unit, so one shuffle of sums is enough."""
    u = sentences.select("sid", units(F.col("sent"), tier).alias("u"))
    marked = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("unit"), F.lit(n).alias("n")))
    d = u.select("sid", F.explode(F.concat(marked(F.col("u"), 0), marked(F.array_distinct("u"), 1))).alias("x"))
    return d.groupBy("x.unit").agg(F.sum("x.n").alias("n"), F.sum(1 - F.col("x.n")).alias("occurrences"), F.min("sid").alias("first_sid"))


def ratios(freq: DataFrame, sentences: DataFrame) -> DataFrame:
    """A2: n(u) over the number of all sentences, those without a unit included."""
    return freq.withColumnRenamed("n", "num").withColumn("den", F.lit(sentences.count()).cast("long"))


def lookup(occ: DataFrame, surfaces: DataFrame, first: int = 5) -> DataFrame:
    """How many sentences hold each asked surface, and the first of them. Surfaces without a
    sentence answer 0."""
    hits = occ.join(surfaces.select("unit").distinct(), "unit").select("unit", "sid").distinct()
    ranked = hits.withColumn("r", F.row_number().over(W.partitionBy("unit").orderBy("sid"))).where(F.col("r") <= first)
    head = ranked.groupBy("unit").agg(F.array_join(F.sort_array(F.collect_list("sid")), ",").alias("sids"))
    n = hits.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return surfaces.select("unit").distinct().join(n, "unit", "left").join(head, "unit", "left").select("unit", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sids", F.lit("")).alias("sids"))


def trace(occ: DataFrame, sentences: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Every sentence that holds an asked unit."""
    return occ.join(surfaces.select("unit").distinct(), "unit").select("unit", "sid").distinct().join(sentences.select("sid", "sent"), "sid")


def attested_joins(spans_: DataFrame) -> DataFrame:
    """For every two units that stand side by side without a letter between, where first."""
    d = with_next(spans_).where(F.col("next").isNotNull())
    return d.groupBy(F.col("unit").alias("first"), F.col("next").alias("second")).agg(F.min("sid").alias("sid"), F.count(F.lit(1)).alias("n"))


def union_of(post: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sentences of any wanted unit; a unit without postings raises."""
    missing = wanted.join(post, "unit", "left_anti").select(F.raise_error(F.concat(F.lit("unknown unit: "), F.col("unit"))).alias("sid").cast("long"))
    return post.join(wanted, "unit").select(F.explode("sids").alias("sid")).distinct().union(missing)


def tier_counts(sentences: DataFrame) -> DataFrame:
    """A3: distinct units and occurrences of every tier."""
    out = None
    for tier in TIERS:
        one = occurrences(sentences, tier).groupBy("unit").agg(F.count(F.lit(1)).alias("c")).agg(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("units"), F.coalesce(F.sum("c"), F.lit(0)).alias("occurrences"))
        out = one if out is None else out.union(one)
    return out


def group_order(occ: DataFrame, asked: DataFrame) -> DataFrame:
    """K3: the recorded order within a tie: members (seed, unit) of a group by the first sentence
    they share with the seed, and within it by their first place. A member that shares no sentence
    with its seed has no rank and is left out. Only sentences of asked seeds are met."""
    at = occ.groupBy("sid", "unit").agg(F.min("pos").alias("pos"))
    seeds = asked.select("seed").distinct()
    shared = at.select("sid", F.col("unit").alias("seed")).join(seeds, "seed").join(at, "sid").join(asked.select("seed", "unit").distinct(), ["seed", "unit"])
    first = shared.groupBy("seed", "unit").agg(F.min(F.struct("sid", "pos")).alias("first"))
    rank = F.row_number().over(W.partitionBy("seed").orderBy("first", "unit")).cast("long")
    return first.select("seed", "unit", "first.sid", "first.pos", rank.alias("rank"))


def merge_parts(parts: DataFrame, key: list[str], entries: str) -> DataFrame:
    """Parts of one key become one, with all their entries once and in order. Entries are
    gathered one by one, so equal ones meet before the shuffle; a part without entries stays."""
    d = parts.select(*key, F.explode_outer(entries).alias(entries))
    return d.groupBy(*key).agg(F.array_sort(F.collect_set(entries)).alias(entries))
