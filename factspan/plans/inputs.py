"""How the driver tables stand in for the engine's own tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.operators import units
from factspan.operators.gate import Reading
from factspan.session import table
from factspan.sources.documents import split_sentences

#: Stand-ins for the seven particles in Latin-script prose.
PARTICLES = ("the", "of", "and", "in", "to", "de", "la")
#: How the gate reads that prose.
READING = Reading(particles=PARTICLES, topic="is", genitive="of")


def dealt(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer parts than there are cores (one small file) is dealt out once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return units.sentence_ids(split_sentences(dealt(table(spark, d, "documents").select("doc_id", "text"))))


def words(spark: SparkSession, d: str) -> DataFrame:
    return units.occurrences(sentences(spark, d))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return units.neighbours(sentences(spark, d))


def word_spans(spark: SparkSession, d: str) -> DataFrame:
    return units.spans(sentences(spark, d))


def order_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an order as units of a sentence."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("unit"))


def asked_parts(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: parts whose key is divisible by 100."""
    return table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("q"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Events as facts: a user's value, in the scope of views and clicks or none; a purchase is a
    change that names an old value."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("user_id").alias("position"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).alias("scope"),
        F.col("event_id").alias("ord"), F.expr("event_id div 3").alias("sid"), (k % 7).alias("value"),
        (F.col("event_type") == "purchase").alias("change"), F.when(F.col("event_type") == "purchase", F.expr("cast(get_json_object(props, '$.k') as bigint) div 10 % 7")).alias("old"),
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"), (F.get_json_object("props", "$.k").cast("long") % 4 == 0).alias("refused"), "props")


SENTS = r"""
lines as (
  select doc_id, unnest(l) line, generate_subscripts(l, 1) ln
  from (select doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) l from documents)),
cut as (
  select doc_id, ln, regexp_extract_all(regexp_replace(regexp_replace(line, '^\s*(?:#{1,6}\s+|>+\s*|[-*+]\s+|\d{1,3}[.)]\s+)', ''), '^\s+|\s+$', '', 'g'),
    '[^.。！？!?]*[.。！？!?][.。！？!?」』）)】〕］\]”"''’]*|[^.。！？!?]+') s from lines),
pieces as (select doc_id, ln, unnest(s) raw, generate_subscripts(s, 1) i from cut),
kept as (select doc_id, ln, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') sent from pieces),
sents as (
  select doc_id * 1000000 + k sid, doc_id, k, sent
  from (select doc_id, sent, row_number() over (partition by doc_id order by ln, i) - 1 k from kept where sent <> ''))"""
WORDS = SENTS + r""",
arr as (select sid, sent, regexp_extract_all(sent, '[\p{L}\p{N}\p{M}]+') u from sents),
occ as (select sid, unnest(u) unit, generate_subscripts(u, 1) - 1 pos from arr)"""
FACTS = """
facts as (
  select user_id "position", case when event_type in ('view', 'click') then event_type end scope, event_id ord, event_id // 3 sid,
    cast(props->>'$.k' as bigint) % 7 "value", event_type = 'purchase' change, case when event_type = 'purchase' then cast(props->>'$.k' as bigint) // 10 % 7 end old
  from events),
ep as (select *, sum(change::int) over (partition by "position", scope order by ord) e from facts)"""
CALLS = """calls as (select user_id run, event_id seq, event_type op, cast(props->>'$.k' as bigint) % 4 = 0 refused, props from events)"""
