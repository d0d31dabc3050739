"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts are words (A-Z lower-cased). Of every run of EIGHT consecutive six-word hashes the least
is kept, on both sides, so any shared span of 6 + 8 - 1 = 13 words shares a kept hash at the
same place: no window of a benchmark item can be missed. Kept hashes meet in a join (the
benchmark side is broadcast only if its measured size allows). What a document and an item have
of one hash goes one of two ways:

* few places: each pair of places is a shift between the two, and the hit is extended by comparing
  the words themselves along the item; only runs of a whole window count;
* more than DENSE pairs of places, as where both repeat a word or a line: the windows of the
  document around its places meet the distinct windows of the item by their text, so the work
  grows with the document, not with the product of the places.

Items shorter than a window are one window of their own length; they meet by the hash of the
whole item, and every place is compared with it.

Nothing but the kept hashes of documents is exploded; texts stay where they are unless a
document has a meeting.

Defined results: null text has no words and is clean; rows with a null id keep their row; items
with a null id or without words are no items; items with the same id count once; repeated rows
each get the same result; empty tables give clean or empty results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.llm.common import BROADCAST_ROWS, documents, fresh, materialise

WINDOW = 13
GRAM = 6
EIGHT = 8
#: Pairs of places of one hash, in a document and an item, up to which each is followed by itself.
DENSE = 16
#: Low bits of a kept hash hold its position; no array is longer than 2**31.
PLACE = (1 << 31) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def fingerprints(df: DataFrame) -> DataFrame:
    """df(key columns, words) to (key columns, print, place): the winnowed hashes of each row.

    Every array is named twice by its reader, so the optimiser computes it once per row."""
    keys = [c for c in df.columns if c != "words"]
    d = df.where(F.size("words") >= WINDOW).withColumn("h1", F.transform("words", lambda x: F.xxhash64(x)))
    d = d.withColumn("h2", F.transform("h1", lambda x, i: F.xxhash64(x, F.get("h1", i + 1))))
    d = d.withColumn("h4", F.transform("h2", lambda x, i: F.xxhash64(x, F.get("h2", i + 2))))
    # a six-word hash, its position in the low bits; the last five have no six words and are cut
    d = d.withColumn("h6", F.transform("h4", lambda x, i: F.xxhash64(x, F.get("h2", i + 4)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))))
    d = d.withColumn("h6", F.slice("h6", 1, F.size("words") - (GRAM - 1)))
    d = d.withColumn("m2", F.transform("h6", lambda x, i: F.least(x, F.get("h6", i + 1))))
    d = d.withColumn("m4", F.transform("m2", lambda x, i: F.least(x, F.get("m2", i + 2))))
    d = d.withColumn("m8", F.transform("m4", lambda x, i: F.least(x, F.get("m4", i + 4))))
    d = d.select(*keys, F.explode(F.array_distinct(F.slice("m8", 1, F.size("words") - (WINDOW - 1)))).alias("v"))
    return d.select(*keys, F.shiftrightunsigned("v", 31).alias("print"), F.col("v").bitwiseAND(F.lit(PLACE)).cast("int").alias("place"))


def _whole(df: DataFrame, n: int) -> DataFrame:
    """Hashes of all n-word runs, for items of n words."""
    keys = [c for c in df.columns if c != "words"]
    d = df.where(F.size("words") >= n).withColumn("h1", F.transform("words", lambda x: F.xxhash64(x)))
    d = d.withColumn("h1", F.col("h1")).withColumn("g", F.transform("h1", lambda x, i: F.xxhash64(x, *(F.get("h1", i + k) for k in range(1, n)))))
    return d.select(*keys, F.posexplode(F.slice("g", 1, F.size("words") - (n - 1))).alias("place", "print"))


def _meetings(doc_side: DataFrame, item_side: DataFrame) -> DataFrame:
    """(met_id, met_row, item_row, places, item_places): where a document and an item have the same hash."""
    item_side = materialise(item_side.groupBy("item_row", "print").agg(F.collect_list("place").alias("item_places")), "prints")
    prints = item_side.select("print").distinct()
    few = item_side.count() <= BROADCAST_ROWS
    # only hashes that an item has are gathered, so a list is no longer than its document
    own = doc_side.join(F.broadcast(prints) if few else prints, "print", "left_semi").groupBy("doc_id", "row", "print").agg(F.collect_list("place").alias("places"))
    met = own.join(F.broadcast(item_side) if few else item_side, "print")
    return materialise(met.select(F.col("doc_id").alias("met_id"), F.col("row").alias("met_row"), "item_row", "places", "item_places"), "meetings")


def _span(begin: Column | str, size: Column | str) -> Column:
    return F.struct((F.col(begin) if isinstance(begin, str) else begin).cast("int").alias("begin"), (F.col(size) if isinstance(size, str) else size).cast("int").alias("size"))


def _along(once: DataFrame, same: Column, items: DataFrame, met: DataFrame) -> DataFrame:
    """Every shift followed along its item. Of a document only the stretch beside the item goes on."""
    shifts = met.select("met_id", "met_row", "item_row", F.explode("places").alias("place"), "item_places")
    shifts = shifts.select("met_id", "met_row", "item_row", F.expr("explode(transform(item_places, q -> place - q))").alias("shift")).distinct()
    sizes = items.select("item_row", F.size("item_words").alias("n"))
    small = items.count() <= BROADCAST_ROWS
    shifts = shifts.join(F.broadcast(sizes) if small else sizes, "item_row")
    beside = F.expr("slice(words, greatest(shift, 0) + 1, n + least(shift, 0))")
    pairs = once.join(shifts, same).select("doc_id", "row", "item_row", "shift", beside.alias("part")).join(items, "item_row")
    pairs = pairs.withColumn("equal", F.array_join(F.expr("transform(item_words, (w, j) -> if(w = get(part, j + least(shift, 0)), '1', '0'))"), ""))
    starts = F.expr(f"filter(sequence(0, size(item_words) - {WINDOW}), s -> substring(equal, s + 1, {WINDOW}) = repeat('1', {WINDOW}))")
    spans = F.transform(starts, lambda s: _span(F.col("shift") + s, F.lit(WINDOW)))
    return pairs.select("doc_id", "row", "item", spans.alias("spans")).where(F.size("spans") > 0)


def _dense(once: DataFrame, same: Column, items: DataFrame, met: DataFrame) -> DataFrame:
    """The document's windows around its places that are windows of the item, by their text."""
    text = lambda array, at: f"array_join(slice({array}, {at} + 1, {WINDOW}), ' ')"
    around = f"array_distinct(flatten(transform(places, p -> sequence(greatest(p - {EIGHT - 1}, 0), p))))"
    near = once.join(met, same).select("doc_id", "row", "item_row", "words", F.explode(F.expr(around)).alias("begin")).where(F.expr(f"begin <= size(words) - {WINDOW}"))
    near = near.select("doc_id", "row", "item_row", "begin", F.expr(text("words", "begin")).alias("window")).distinct()
    own = items.join(met.select("item_row").distinct(), "item_row", "left_semi")
    own = own.select("item_row", "item", F.expr(f"explode(array_distinct(transform(sequence(0, size(item_words) - {WINDOW}), q -> {text('item_words', 'q')})))").alias("window"))
    return near.join(own, ["item_row", "window"]).select("doc_id", "row", "item", F.array(_span("begin", F.lit(WINDOW))).alias("spans"))


def _exact(once: DataFrame, same: Column, items: DataFrame, met: DataFrame) -> DataFrame:
    """The places where a short item stands whole."""
    pairs = once.join(met, same).join(items, "item_row")
    starts = F.expr("filter(places, p -> slice(words, p + 1, size(item_words)) = item_words)")
    spans = F.transform(starts, lambda p: _span(p, F.size("item_words")))
    return pairs.select("doc_id", "row", "item", spans.alias("spans")).where(F.size("spans") > 0)


def hits(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    text = F.col("text").cast("string")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words(F.col("text")).alias("words"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(text).alias("item_words"))
    items = materialise(items.where(F.col("item").isNotNull() & (F.size("item_words") > 0)).distinct(), "items")
    items = items.withColumn("item_row", F.xxhash64("item", F.array_join("item_words", " ")))

    own = items.select("item_row", F.col("item_words").alias("words"))
    short = [r.n for r in items.where(F.size("item_words") < WINDOW).groupBy(F.size("item_words").alias("n")).count().collect()]  # at most 12 rows
    long_met = _meetings(fingerprints(docs), fingerprints(own.where(F.size("words") >= WINDOW)))
    short_met = [_meetings(_whole(docs, n), _whole(own.where(F.size("words") == n), n)) for n in short]

    every = reduce(DataFrame.union, (m.select("met_id", "met_row") for m in [long_met, *short_met])).distinct()
    few = every.count() <= BROADCAST_ROWS
    same = (F.col("row") == F.col("met_row")) & F.col("doc_id").eqNullSafe(F.col("met_id"))
    once = docs.join(F.broadcast(every) if few else every, same, "left_semi").dropDuplicates(["doc_id", "row"])
    once = materialise(once, "met-documents")

    dense = F.size("places") * F.size("item_places") > DENSE
    found = [_along(once, same, items, long_met.where(~dense)), _dense(once, same, items, long_met.where(dense))] + [_exact(once, same, items, m) for m in short_met]
    found = materialise(reduce(DataFrame.union, found), "found")  # (doc_id, row, item, spans): stretches of the document
    placed = found.select("doc_id", "row", F.explode(F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.begin, s.begin + s.size - 1))))")).alias("at"))
    n_hit = placed.distinct().groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("doc_id", "row", "item").distinct().groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = n_hit.alias("h").join(named.alias("k"), (F.col("h.row") == F.col("k.row")) & F.col("h.doc_id").eqNullSafe(F.col("k.doc_id")))
    hit = hit.select(F.col("h.doc_id").alias("hit_id"), F.col("h.row").alias("hit_row"), "n_hit", "items")

    base = docs.select("doc_id", "row", F.size("words").cast("long").alias("n_words"))
    out = base.join(hit, (F.col("row") == F.col("hit_row")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "row", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of df that are not contaminated, unchanged."""
    bad_id, bad_row = fresh(df, 2)
    bad = hits(df, benchmark).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("row").alias(bad_row)).distinct()
    bad = materialise(bad, "contaminated")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return df.join(side, (row == F.col(bad_row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)), "left_anti")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")


ORACLE = rf"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
bk as (select item, w, least(len(w), {WINDOW}) k from b where len(w) > 0),
bw as (select item, k, array_to_string(w[i:i + k - 1], ' ') g from (select item, w, k, unnest(range(1, len(w) - k + 2)) i from bk)),
dw as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from t join (select distinct k from bk) on len(w) >= k)),
hit as (select distinct doc_id, item, i, dw.k from dw join bw on bw.k = dw.k and bw.g = dw.g),
n as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(i, i + k)) p from hit) group by doc_id),
m as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from hit) group by doc_id)
select t.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from t left join n on n.doc_id = t.doc_id left join m on m.doc_id = t.doc_id
"""
