"""Queries over the memory index. Events stand in for a ledger: signups declare topics, views,
purchases and clicks are rows of one clause, errors are marks, bridges or unshaped rows. The index
is built of the first half of the ledger, written, and extended by the second half; the SQL knows
nothing of halves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.operators import memindex as mi
from factspan.plans.named import query
from factspan.session import shared_folder, table

_CLAUSE = "struct<shape: string, centre: string, arms: " + mi.ARMS + ", value: string, change: boolean, old: string>"


def ledger(spark: SparkSession, d: str) -> mi.Ledger:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("session"), F.col("event_type").alias("t"), k.alias("k"))
    name = lambda letter, n: F.concat(F.lit(letter), (F.col("k") % n).cast("string"))
    arm = lambda particle, phrase: F.struct(F.lit(particle).alias("particle"), phrase.alias("phrase"))
    none, no_arms = F.lit(None).cast("string"), F.array().cast(mi.ARMS)

    def clause(shape, centre, arms, value, change, old):
        return F.array(F.struct(F.lit(shape).alias("shape"), centre.alias("centre"), arms.alias("arms"), value.alias("value"), F.lit(change).alias("change"), old.alias("old")))

    old = F.concat(F.lit("v"), F.expr("k div 10 % 4").cast("string"))
    place = F.concat_ws(" ", name("o", 3), name("p", 4))
    clauses = (
        F.when(F.col("t") == "view", clause("F1", name("c", 7), F.array(arm("of", name("o", 5))), name("v", 4), False, none))
        .when(F.col("t") == "purchase", clause("F2", name("c", 7), no_arms, name("v", 4), True, old))
        .when(F.col("t") == "click", clause("F4", name("e", 5), F.array(arm("in", place)), none, False, none))
        .when((F.col("t") == "error") & (F.col("k") % 3 == 2), clause("F0", none, no_arms, none, False, none))
    )
    words = F.expr("array_distinct(array_compact(flatten(transform(clauses, c -> concat(array(c.centre, c.value), flatten(transform(c.arms, a -> split(a.phrase, ' '))))))))")
    rows = e.withColumn("clauses", clauses.cast(f"array<{_CLAUSE}>")).where("clauses is not null")
    error = e.where("t = 'error'")
    return mi.Ledger(
        e.where("t = 'signup'").select("session", "ord", F.concat_ws(" of ", name("o", 3), name("c", 7)).alias("topic"), name("c", 7).alias("centre"), F.array(arm("of", name("o", 3))).alias("arms")),
        rows.select(F.col("ord").alias("sid"), "session", "clauses", words.alias("words")),
        error.where("k % 3 = 0").select("ord", F.expr("ord - 2 - k % 40").alias("sid"), F.expr("ord - 1").alias("by"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("reason")),
        error.where("k % 3 = 1").select("ord", name("w", 10).alias("qword"), name("c", 7).alias("phrase")),
    )


def _half(whole: mi.Ledger, later: bool, cut: int) -> mi.Ledger:
    side = lambda df, c: df.where(F.col(c) >= cut) if later else df.where(F.col(c) < cut)
    return mi.Ledger(side(whole.declares, "ord"), side(whole.rows, "sid"), side(whole.marks, "ord"), side(whole.bridges, "ord"))


def index(spark: SparkSession, d: str) -> mi.Index:
    """The index of both halves, the second added to the written index of the first."""
    whole = ledger(spark, d)
    cut = (table(spark, d, "events").agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] + 1) // 2
    first = mi.saved(mi.build(_half(whole, False, cut)), f"{shared_folder(spark)}/factspan-index-{uuid.uuid4().hex}")
    return mi.extend(first, _half(whole, True, cut))


LEDGER = """
e as (select event_id ord, user_id session, event_type t, cast(props->>'$.k' as bigint) k from events),
declares as (select session, ord, 'o' || k % 3 || ' of c' || k % 7 topic, 'c' || k % 7 centre, 'o' || k % 3 owner from e where t = 'signup'),
marks as (select ord - 2 - k % 40 sid, ord - 1 "by", 'r' || k reason from e where t = 'error' and k % 3 = 0 qualify row_number() over (partition by ord - 2 - k % 40 order by ord desc) = 1),
bridges as (select distinct 'w' || k % 10 qword, 'c' || k % 7 phrase from e where t = 'error' and k % 3 = 1),
rws as (select ord sid, session, t, k from e where t in ('view', 'purchase', 'click') or (t = 'error' and k % 3 = 2)),
opn as (select r.*, d.topic open, d.centre oc, d.owner oo from rws r asof left join declares d on r.session = d.session and r.sid >= d.ord),
clauses as (select sid, session, open, case when t = 'click' and open is not null then 'F3' when t = 'click' then 'F4' when t = 'view' then 'F1' when t = 'purchase' then 'F2' end tank,
  case when t = 'click' then 'e' || k % 5 when t <> 'error' then 'c' || k % 7 end centre,
  case when t = 'view' then 'of=o' || k % 5 when t = 'click' then 'in=o' || k % 3 || ' p' || k % 4 || case when open is not null then '>subject=' || oc || '>of=' || oo else '' end else '' end chain,
  case when t in ('view', 'purchase') then 'v' || k % 4 end "value", t = 'purchase' change, case when t = 'purchase' then 'v' || k // 10 % 4 end "old", case when t = 'click' then open end nest from opn)"""

VALUES = f"""{LEDGER},
vals as (select c.*, m."by", m.reason, lag("value") over w "before", row_number() over w n from clauses c left join marks m using (sid) where "value" is not null
  window w as (partition by tank, centre, chain order by sid)),
hist as (select tank, centre, chain, sid, session, open "scope", "value", case when n = 1 then 'first'
  when change or exists (select 1 from vals r where r.tank = v.tank and r.centre = v.centre and r.chain = v.chain and r."by" = v.sid and r.sid < v.sid) then 'update' else 'other' end kind,
  case when change and n > 1 then "old" = "before" end old_matches, "by", reason from vals v)"""


@query("m2_index_values", f"with {VALUES} select * from hist")
def _(s, d):
    return index(s, d).values.drop("k")


@query("m2_index_clauses", f"with {LEDGER} select sid, session, tank, centre, chain, \"value\", change, \"old\", nest, open, case when nest is not null then 'nest' end via from clauses")
def _(s, d):
    return index(s, d).clauses.drop("k", "shape", "arms")


@query(
    "m2_index_members",
    f"""with {LEDGER}, nests as (select distinct topic, centre of_centre, owner from declares),
ties as (select n.topic, c.sid, c.nest = n.topic a, c.centre = n.of_centre b, list_contains(string_split(c.chain, '>'), 'of=' || n.of_centre) p, c.open = n.topic o,
  list_contains(string_split(regexp_replace(c.chain, '[a-z]+=', '', 'g'), '>'), n.owner) ex from clauses c, nests n where c.tank is not null)
select topic, sid, case when a then 'completed' when b then 'centre' when p then 'path' else 'context' end kind, coalesce(a, false) or ((b or p) and ex) exact from ties where coalesce(a, false) or b or p or coalesce(o, false)""",
)
def _(s, d):
    return index(s, d).members.drop("k")


_SEATS = f"""{LEDGER}, seats as (
  select tank, centre, sid, 0 n, 'centre' slot, centre phrase, '' under from clauses where tank is not null
  union all select tank, centre, sid, i, string_split(x, '=')[1], string_split(x, '=')[2], array_to_string(l[1:i - 1], '>') from (
    select tank, centre, sid, unnest(l) x, generate_subscripts(l, 1) i, l from (select *, string_split(chain, '>') l from clauses where chain <> ''))
  union all select tank, centre, sid, 99, 'is', "value", chain from clauses where "value" is not null),
unit_rows as (select sid, n, unnest(string_split(phrase, ' ')) unit from seats),
firsts as (select unit, min(sid) first_sid from unit_rows where n <> -1 group by unit),
known as (select sid, n, bool_and(first_sid < sid) known from unit_rows join firsts using (unit) group by all)"""


@query(
    "m4_seat_origins",
    f"with {_SEATS.replace('unit_rows as (select sid, n, unnest', 'own as (select sid, n, phrase from seats where not (slot = ' + chr(39) + 'subject' + chr(39) + ' or contains(under, ' + chr(39) + 'subject=' + chr(39) + '))), unit_rows as (select sid, n, unnest').replace('min(sid) first_sid from unit_rows where n <> -1', 'min(sid) first_sid from (select sid, unnest(string_split(phrase, chr(32))) unit from own)')} "
    "select tank, slot, case when known then 'record' else 'constructed' end origin, count(*) n, min(seats.sid) \"first\" from seats join known using (sid, n) group by all",
)
def _(s, d):
    """M4: were all units of a phrase seen before its sentence? A completed subject stands in no text."""
    return index(s, d).seats.groupBy("tank", "slot", "origin").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("first"))


@query(
    "m2_index_crosses",
    f"""with {_SEATS}, arms as (select tank, centre, slot, count(*) n, min(sid) f from seats where slot in ('centre', 'is') or under = '' group by all)
select tank, centre, 1 + coalesce(max(n) filter (slot not in ('centre', 'is')), 0) rings, coalesce(sum(n) filter (slot <> 'centre'), 0)::bigint seats, min(f) first_sid from arms group by all""",
)
def _(s, d):
    return mi.crosses(index(s, d))


@query(
    "x9_centres_with",
    f"""with {_SEATS} select distinct phrase, tank, centre, case when slot in ('centre', 'is') or under = '' then slot else regexp_replace(under, '=[^>]*', '', 'g') || '>' || slot end place
from seats where phrase in (select distinct 'o' || k % 3 from e union select distinct 'c' || k % 7 from e)""",
)
def _(s, d):
    """Where every topic's owner and centre is held, at any depth."""
    known = ledger(s, d).declares
    return mi.centres_with(index(s, d), known.select(F.explode(F.array("centre", F.expr("arms[0].phrase"))).alias("phrase")))


@query(
    "x9_positions",
    f"""with {VALUES}, p as (select tank, centre, chain, min(sid) since from hist group by all), named as (
  select *, unnest(['centre', 'text', 'flat']) route, unnest([centre, case when chain = '' then centre else chain[4:] || ' of ' || centre end, case when chain = '' then centre else chain[4:] || centre end]) txt from p)
select txt "text", route, tank, centre, chain, since from named where txt in (select topic from declares union select centre from declares)""",
)
def _(s, d):
    """The positions that each topic, and each topic's centre, names."""
    known = ledger(s, d).declares
    return mi.positions_of(index(s, d), known.select(F.explode(F.array("topic", "centre")).alias("text")))


@query("x9_bridged_history", f"""with {VALUES} select qword, tank, centre, chain, count(*) entries, count(*) filter (kind = 'update') updates, max(sid) last from bridges join hist on centre = phrase where tank in ('F1', 'F2') group by all""")
def _(s, d):
    """The histories that question words reach over bridges."""
    i = index(s, d)
    reached = mi.bridged(i, i.bridges)
    entries = mi.history(i, reached).join(reached, list(mi.POSITION))
    return entries.groupBy("qword", *mi.POSITION).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("kind") == "update").alias("updates"), F.max("sid").alias("last"))


@query("w6_slides", f"with {LEDGER} select sid, lead(sid) over w \"next\", session <> lead(session) over w boundary from rws window w as (order by sid) qualify \"next\" is not null")
def _(s, d):
    return mi.slides(ledger(s, d).rows)


@query(
    "a16_notes_by_topic",
    f"""with {VALUES}, n as (select h.session, h.sid, case when kind = 'update' then 'UPDATE' when kind = 'other' then 'SAME_SEAT' end note, "scope" from hist h)
select "scope" open, note, count(*) n, min(sid) "first", max(sid) last from n where note is not null group by all""",
)
def _(s, d):
    """Notes counted by the topic open when they were made."""
    i = index(s, d)
    note = F.when(F.col("kind") == "update", "UPDATE").when(F.col("kind") == "other", "SAME_SEAT")
    notes = i.values.select("session", F.col("sid").alias("ord"), note.alias("note")).where("note is not null")
    return mi.note_counts(notes, ledger(s, d).declares)
