"""Queries over replays, the recorder and the late rule. Events stand in for recorded calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.operators import recorder, replay
from factspan.plans.named import query
from factspan.session import shared_folder, table
from factspan.streaming import windows


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events as ops on a store, with results and checks by window functions, and some
    of them damaged by the event's number."""
    k = F.get_json_object("props", "$.k").cast("long")
    run = W.partitionBy("run").orderBy("event_id")
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("run"), "event_type", k.alias("k"))
    op = F.when(F.col("event_type").isin("click", "purchase"), "put").when(F.col("event_type") == "error", "drop").when(F.col("event_type") == "view", "get").otherwise("count")
    e = e.withColumns({"i": (F.row_number().over(run) - 1).cast("long"), "op": op, "key": F.concat(F.lit("k"), (F.col("k") % 5).cast("string")), "value": F.concat(F.lit("v"), (F.col("k") % 7).cast("string"))})
    write = F.when(F.col("op") == "put", F.struct(F.col("value").alias("v"))).when(F.col("op") == "drop", F.struct(F.lit(None).cast("string").alias("v")))
    e = e.withColumn("was", F.last(write, ignorenulls=True).over(W.partitionBy("run", "key").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))["v"])
    weight = lambda v: F.coalesce(F.crc32(F.concat_ws("=", "key", v).cast("binary")), F.lit(0))
    own, held = F.when(F.col("op") == "put", F.col("value")), F.col("op").isin("put", "drop")
    sums = W.partitionBy("run").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumns({
        "n": F.sum(F.when(held, own.isNotNull().cast("int") - F.col("was").isNotNull().cast("int")).otherwise(0)).over(sums),
        "total": F.sum(F.when(held, F.when(own.isNotNull(), weight(own)).otherwise(0) - F.when(F.col("was").isNotNull(), weight(F.col("was"))).otherwise(0)).otherwise(0)).over(sums),
    })
    told = lambda name, v: F.concat(F.lit(f'{{"{name}":'), F.coalesce(F.concat(F.lit('"'), v, F.lit('"')), F.lit("null")), F.lit("}"))
    result = F.when(F.col("op") == "get", told("value", F.col("was"))).when(F.col("op") == "count", F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit("}"))).otherwise(told("was", F.col("was")))
    args = F.when(F.col("op") == "count", "{}").when(F.col("op") == "put", F.to_json(F.struct("key", "value"))).otherwise(F.to_json(F.struct("key")))
    damaged = lambda n, r: F.col("event_id") % n == r
    return e.select(
        "run", "i", F.when(damaged(701, 13), "bogus").otherwise(F.col("op")).alias("op"), F.when(damaged(809, 17), "{").otherwise(args).alias("args"),
        F.when(damaged(401, 7), '{"was":"x"}').otherwise(result).alias("result"), F.when(damaged(577, 11), "?").otherwise(F.concat_ws(":", "n", "total")).alias("state"),
    )


_DAMAGE = """e as (select *, row_number() over (partition by user_id order by event_id) - 1 i, case when event_id % 809 = 17 then 'args' when event_id % 701 = 13 then 'op' when event_id % 401 = 7 then 'result' when event_id % 577 = 11 then 'state' end field from events),
first as (select user_id, min(i) at, arg_min(field, i) field from e where field is not null group by user_id),
w as (select user_id, cast(props->>'$.k' as bigint) % 5 k, arg_max(event_type, event_id) last from e where event_type in ('click', 'purchase', 'error') group by all),
live as (select user_id, count(*) filter (last <> 'error') n from w group by user_id),
runs as (select user_id, count(*) n from e group by user_id)"""


@query(
    "l6_replay_executes",
    f"""with {_DAMAGE} select r.user_id run, case when at is null then 'REPLAYS' else 'DIFFERS' end status, r.n, at, field, case when at is null then coalesce(live.n, 0) end live
from runs r left join first using (user_id) left join live using (user_id)""".replace(" at,", ' "at",').replace("min(i) at", 'min(i) "at"').replace("when at is", 'when "at" is'),
)
def _(s, d):
    """Every run executed again; the first damage is found, and sound runs give their number of live keys."""
    found = replay.replay(_recorded(s, d))
    return found.select("run", "status", "n", "at", "field", F.split("output", ":")[0].cast("long").alias("live"))


@query("l9_replay_outcomes", f"""with {_DAMAGE} select case when field is null then 'REPLAYS' else 'DIFFERS' end status, coalesce(field, '') field, count(*) runs, sum(n)::bigint "rows" from runs left join first using (user_id) group by all""".replace("min(i) at", 'min(i) "at"'))
def _(s, d):
    return replay.explain(replay.replay(_recorded(s, d)))


_KIND = "case event_type when 'view' then 'owner_utterance' when 'click' then 'system_message' when 'purchase' then 'tool_call' when 'error' then 'nonsense' else 'approval' end"
_ROWS = f"""rws as (select user_id run, event_id, {_KIND} kind, case when event_type = 'click' then 'system' when event_id % 11 = 3 then 'nobody' else 'owner' end actor,
  case when event_id % 13 = 5 then '[1]' when event_id % 17 = 6 then '{{"note":"sk-ant-abcdefgh1234"}}' else '{{"k":' || (props->>'$.k') || '}}' end data from events),
chk as (select *, case when kind = 'nonsense' then 'UNKNOWN_KIND' when actor = 'nobody' then 'BAD_ACTOR' when data = '[1]' then 'BAD_DATA' when contains(data, 'sk-ant') then 'UNREDACTED_SECRET_REFUSED' end reason from rws)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr(_KIND)
    actor = F.when(F.col("event_type") == "click", "system").when(F.col("event_id") % 11 == 3, "nobody").otherwise("owner")
    data = F.when(F.col("event_id") % 13 == 5, "[1]").when(F.col("event_id") % 17 == 6, '{"note":"sk-ant-abcdefgh1234"}')
    data = data.otherwise(F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit("}")))
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), kind.alias("kind"), actor.alias("actor"), data.alias("data"))


def _recording(spark: SparkSession, d: str) -> str:
    """A recorder that two appends have written to, the first half of the events and the second."""
    folder = f"{shared_folder(spark)}/factspan-recorder-{uuid.uuid4().hex}"
    rows = _rows(spark, d)
    cut = (rows.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0] + 1) // 2
    for half in (rows.where(F.col("ord") < cut), rows.where(F.col("ord") >= cut)):
        recorder.append(spark, folder, half)
    return folder


_SEALED = f"""with recursive {_ROWS}, b as (select run, row_number() over (partition by run order by event_id) - 1 i, kind, '{{"kind":"' || kind || '","actor":"' || actor || '","data":"' || replace(data, '"', '\\"') || '"}}' body from chk where reason is null),
c as (select run, i, kind, sha256(repeat('0', 64) || '|0|' || body) sha from b where i = 0 union all select b.run, b.i, b.kind, sha256(c.sha || '|' || b.i || '|' || b.body) from c join b on b.run = c.run and b.i = c.i + 1)"""


@query("s10_recorded_heads", f"""{_SEALED} select run, max(i) + 1 n, arg_max(sha, i) head from c group by run""")
def _(s, d):
    from factspan.operators import ledger

    return ledger.head(recorder.read_events(s, _recording(s, d)))


@query("s10_rejects", f"with {_ROWS} select reason, count(*) n from chk where reason is not null group by reason")
def _(s, d):
    return recorder.rejects(s, _recording(s, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l19_corrections",
    f"""{_SEALED}, a as (select *, count(*) over (partition by sha) same, case i % 5 when 1 then 'tool_call' when 2 then 'owner_utterance' else 'system_message' end should, case when i % 7 = 2 then ' ' else 'note' end note, case when i % 9 = 4 then sha[1:5] when i % 9 = 5 then 'zzzz' || sha else sha[1:20] end refers from c)
select code, count(*) n from (select case when length(refers) < 8 then 'PREFIX_TOO_SHORT' when refers[1:1] = 'z' then 'NOT_FOUND' when same > 1 then 'AMBIGUOUS_PREFIX' when kind not in ('owner_utterance', 'system_message') then 'NOT_AN_ATTRIBUTION_ROW'
  when should = 'tool_call' then 'UNKNOWN_KIND' when should = kind then 'NO_CHANGE' when note = ' ' then 'NOTE_REQUIRED' else 'ok' end code from a) q group by code""",
)
def _(s, d):
    """A correction asked for every recorded row, most of them not to be had. Equal first rows of two
    runs have one digest, so it names neither."""
    events = recorder.read_events(s, _recording(s, d))
    i = F.col("i")
    refers = F.when(i % 9 == 4, F.substring("sha", 1, 5)).when(i % 9 == 5, F.concat(F.lit("zzzz"), "sha")).otherwise(F.substring("sha", 1, 20))
    should = F.when(i % 5 == 1, "tool_call").when(i % 5 == 2, "owner_utterance").otherwise("system_message")
    asked = events.select(F.concat_ws("#", "run", "i").alias("id"), refers.alias("refers"), should.alias("kind_should_be"), F.when(i % 7 == 2, " ").otherwise("note").alias("note"), F.lit("owner").alias("actor"))
    return recorder.corrections(events, asked).groupBy(F.coalesce("code", F.lit("ok")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "late_rule",
    """with u as (select user_id "position", event_id seq, cast(props->>'$.k' as bigint) turn from events)
select "position", seq, turn, coalesce(turn <= max(turn) over (partition by "position" order by seq rows between unbounded preceding and 1 preceding), false) late from u""",
)
def _(s, d):
    """Updates accepted or late, the second half against what the first has accepted."""
    u = table(s, d, "events").select(F.col("user_id").alias("position"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("turn"))
    cut = (u.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1) // 2
    first = windows.strictly_later(u.where(F.col("seq") < cut), u.select("position", "turn").limit(0))
    known = first.where("not late").select("position", "turn")
    return first.union(windows.strictly_later(u.where(F.col("seq") >= cut), known))
