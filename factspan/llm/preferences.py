"""Preference formatting: common prompt once, two masked completions.

A pair of conversations shares its longest common prefix of turns. That prefix is rendered once
as the prompt; the rest of either conversation is its completion, with the spans of assistant
turns (their text and end mark) as the mask of what is trained on, in code points of the
completion. Everything is a DataFrame expression within the row of a pair.

Defined results: turns are ordered by (turn, role, text); null role or text count as empty;
marker openings inside a text are broken up so that no text can end its turn; rows without a
conversation id, and conversations without a counterpart, form no pair; identical
conversations are all prompt with empty completions and masks; repeated rows are repeated
turns; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls replaced and markers broken up."""
    safe = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), safe("role").alias("role"), safe("text").alias("text"))
    return out.where(F.col("conv_id").isNotNull())


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: conversation 2k is preferred to 2k + 1."""
    t = turns(conversations)
    one = F.struct("turn", "role", "text")
    side = lambda k: F.sort_array(F.collect_list(F.when(F.pmod("conv_id", F.lit(2)) == k, one)))
    pairs = t.groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id")).agg(side(0).alias("chosen"), side(1).alias("rejected"))
    pairs = pairs.where((F.size("chosen") > 0) & (F.size("rejected") > 0))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return pairs.select("pair_id", plain("chosen").alias("chosen"), plain("rejected").alias("rejected"))


def _render(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE))), "")


def _mask(part: str) -> Column:
    """start:end of every assistant turn's text and end mark, comma-joined, in code points."""
    head, tail = len(OPEN) + 1, len(CLOSE)
    return F.expr(f"""
        array_join(aggregate({part}, struct(0 as at, cast(array() as array<string>) as spans), (s, x) -> struct(
            s.at + {head + tail} + length(x.role) + length(x.text) as at,
            if(x.role = '{ASSISTANT}', concat(s.spans, array(concat(s.at + {head} + length(x.role), ':', s.at + {head + tail} + length(x.role) + length(x.text)))), s.spans) as spans
        ), s -> s.spans), ',')""")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, chosen and rejected (arrays of role, text) to prompt, completions and masks."""
    equal = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(equal, False)
    d = pairs.withColumn("n_prefix", F.when(first == 0, F.size("chosen")).otherwise(first - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    d = d.select("pair_id", F.col("n_prefix").cast("long").alias("n_prefix_turns"), F.slice("chosen", 1, F.col("n_prefix")).alias("prefix"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return d.select(
        "pair_id", "n_prefix_turns", _render(F.col("prefix")).alias("prompt"), _render(F.col("chosen")).alias("chosen_completion"), _mask("chosen").alias("chosen_mask"),
        _render(F.col("rejected")).alias("rejected_completion"), _mask("rejected").alias("rejected_mask"),
    )


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(pair_neighbours(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = f"""
with t as (
  select cast(floor(conv_id / 2) as bigint) pair_id, conv_id % 2 side, turn,
    replace(coalesce(role, ''), '<|', '< |') role, replace(coalesce(text, ''), '<|', '< |') text
  from conversations where conv_id is not null),
n as (select *, row_number() over (partition by pair_id, side order by turn, role, text) k from t),
sized as (select pair_id, max(k) filter (side = 0) nc, max(k) filter (side = 1) nr from n group by pair_id),
p as (
  select s.pair_id, coalesce(min(i.k) - 1, least(nc, nr)) n_prefix
  from sized s left join (
    select c.pair_id, c.k from n c left join n r on r.pair_id = c.pair_id and r.side = 1 - c.side and r.k = c.k
    where r.k is null or r.role <> c.role or r.text <> c.text) i on i.pair_id = s.pair_id
  where nc is not null and nr is not null group by s.pair_id, nc, nr),
m as (
  select n.pair_id, n.side, n.k, n_prefix, role, '{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10) body
  from n join p on p.pair_id = n.pair_id),
o as (select *, coalesce(sum(length(body)) over (partition by pair_id, side, k <= n_prefix order by k rows between unbounded preceding and 1 preceding), 0) place from m)
select p.pair_id, cast(p.n_prefix as bigint) n_prefix_turns,
  coalesce(string_agg(body, '' order by k) filter (side = 0 and k <= o.n_prefix), '') prompt,
  coalesce(string_agg(body, '' order by k) filter (side = 0 and k > o.n_prefix), '') chosen_completion,
  coalesce(string_agg(cast(cast(place + {len(OPEN) + 1} + length(role) as bigint) as varchar) || ':' || cast(cast(place + length(body) as bigint) as varchar), ',' order by k) filter (side = 0 and k > o.n_prefix and role = '{ASSISTANT}'), '') chosen_mask,
  coalesce(string_agg(body, '' order by k) filter (side = 1 and k > o.n_prefix), '') rejected_completion,
  coalesce(string_agg(cast(cast(place + {len(OPEN) + 1} + length(role) as bigint) as varchar) || ':' || cast(cast(place + length(body) as bigint) as varchar), ',' order by k) filter (side = 1 and k > o.n_prefix and role = '{ASSISTANT}'), '') rejected_mask
from p join o on o.pair_id = p.pair_id group by p.pair_id, p.n_prefix
"""
