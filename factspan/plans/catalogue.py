"""Every query of the engine by name, and the SQL that must give the same rows.

Names start with the inventory row they cover. Queries without SQL are searches, folds or
predicates that SQL says only awkwardly; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.functions import redaction, text as tx
from factspan.operators import audit, clauses, facts as fx, followers, gate, geometry, intervals, ledger, matching, pairs, scores, store, units
from factspan.plans import inputs as src
from factspan.plans import evidence, memory, reading, records, structure  # noqa: F401  (they register their queries)
from factspan.plans.inputs import CALLS, FACTS, PARTICLES, READING, SENTS, WORDS
from factspan.plans.named import ORACLES, QUERIES, query  # noqa: F401
from factspan.session import table
from factspan.sources import documents as docs
from factspan.streaming import windows

FLAGSHIP = "x3_lookup"
_P = ", ".join(f"'{p}'" for p in PARTICLES)
long = "long"


# ---------------------------------------------------------------- sentences, units, look-ups


@query("s2_sentences", f"with {SENTS} select doc_id, cast(k as bigint) k, sha256(sent) sha from sents")
def _(s, d):
    return src.sentences(s, d).select("doc_id", F.col("k").cast(long).alias("k"), F.sha2("sent", 256).alias("sha"))


@query(
    "s3_corpus_rows",
    rf"""with {SENTS}, red as (
  select doc_id, k, regexp_replace(sent, '((?i:api[_-]?key|token|secret|password)["'']?\s*[=:]\s*["'']?)[^\s"'']{{8,}}', '\1[REDACTED:kv_secret]', 'g') sent from sents)
select cast(doc_id as varchar) title, doc_id || '#' || k "source", sha256(sent) sha from red""",
)
def _(s, d):
    return docs.corpus_rows(docs.split_sentences(table(s, d, "documents").select("doc_id", "text")), F.col("doc_id")).select("title", "source", "sha")


@query(
    "s4_corpus_address",
    rf"""with {SENTS}, red as (select doc_id, k, regexp_replace(sent, '((?i:api[_-]?key|token|secret|password)["'']?\s*[=:]\s*["'']?)[^\s"'']{{8,}}', '\1[REDACTED:kv_secret]', 'g') sent from sents),
j as (select doc_id, k, '{{"sent":' || cast(to_json(sent) as varchar) || ',"sha":"' || sha256(sent) || '","source":"' || doc_id || '#' || k || '","title":"' || doc_id || '"}}' line from red)
select cast(doc_id as varchar) title, sha256(string_agg(line, chr(10) order by k) || chr(10)) sha, count(*) n from j group by doc_id""",
)
def _(s, d):
    rows = docs.corpus_rows(docs.split_sentences(table(s, d, "documents").select("doc_id", "text")), F.col("doc_id"))
    return docs.corpus_digest(rows)


@query("s14_source_codec", """select conv_id, turn, 'conv' store, cast(conv_id as varchar) "session", turn i, role from conversations""")
def _(s, d):
    c = table(s, d, "conversations")
    c = c.withColumn("p", docs.parse_source(docs.make_source(F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn"), F.col("role"))))
    return c.select("conv_id", "turn", "p.store", "p.session", "p.i", "p.role")


@query("p1_p3_clean_text", r"""select doc_id, regexp_matches(text, '[\p{L}\p{N}\p{M}]') has_letter, length(trim(regexp_replace(text, '\((?:reported|said) by .*\)\s*$', ''))) n from documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.has_letter(F.col("text")).alias("has_letter"), F.length(tx.strip_attribution(F.col("text"))).cast(long).alias("n"))


@query(
    "p4_script",
    r"""with c as (select doc_id, len(regexp_extract_all(text, '[぀-ヿ一-鿿]')) ja, len(regexp_extract_all(text, '[㐀-䶿一-鿿]')) han, regexp_matches(text, '[ぁ-んァ-ヶー]') kana,
  len(regexp_extract_all(text, '[A-Za-zＡ-Ｚａ-ｚ][A-Za-z0-9Ａ-Ｚａ-ｚ０-９.+#_-]*')) lat from documents)
select doc_id, case when ja > lat then case when han >= 6 and not kana then 'zh' else 'ja' end when lat = 0 then 'latin' else 'en' end script from c""",
)
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.detect_script(F.col("text")).alias("script"))


@query("p14_shown", """select doc_id, case when lang in ('en', 'de') then lang else 'str:' || substr(sha256(lang), 1, 8) || '/' || length(lang) end lang, 'str:' || substr(sha256("source"), 1, 8) || '/' || length("source") "source" from documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.shown(F.col("lang"), ("en", "de")).alias("lang"), tx.shown(F.col("source")).alias("source"))


@query("a1_frequencies", f"with {WORDS} select unit, count(distinct sid) n, count(*) occurrences, min(sid) first_sid from occ group by unit")
def _(s, d):
    return units.frequencies(src.sentences(s, d))


@query("a2_ratios", f"with {WORDS}, n as (select count(*) den from sents) select unit, count(distinct sid) num, den from occ, n group by unit, den")
def _(s, d):
    sents = src.sentences(s, d)
    return units.ratios(units.frequencies(sents), sents).select("unit", "num", "den")


@query(
    "a3_tier_counts",
    rf"""with {WORDS}, ch as (select unnest(regexp_extract_all(sent, '[\p{{L}}\p{{N}}\p{{M}}]')) unit from sents)
select 'WORD' tier, count(distinct unit) units, count(*) occurrences from occ union all select 'CHAR', count(distinct unit), count(*) from ch""",
)
def _(s, d):
    return units.tier_counts(src.sentences(s, d))


@query("x1_postings", f"with {WORDS}, p as (select distinct unit, sid, sid // 4096 block from occ) select unit, block, count(*) n, min(sid) lo, max(sid) hi, cast(sum(sid) as bigint) total from p group by unit, block")
def _(s, d):
    p = units.postings(units.once(src.sentences(s, d)), "WORD")
    return p.select("unit", F.col("block"), F.size("sids").cast(long).alias("n"), F.array_min("sids").alias("lo"), F.array_max("sids").alias("hi"), F.aggregate("sids", F.lit(0).cast(long), lambda a, x: a + x).alias("total"))


@query("x2_append", f"with {WORDS}, p as (select distinct unit, sid, sid // 4096 block from occ) select unit, block, count(*) n from p group by unit, block")
def _(s, d):
    occ = units.once(src.sentences(s, d))
    old, new = (units.postings(occ.where(F.expr(f"(sid div {units.PER_DOC}) % 2 = {k}")), "WORD") for k in (0, 1))
    return units.append_postings(old, new).select("unit", "block", F.size("sids").cast(long).alias("n"))


_ASKED = r"asked as (select distinct regexp_extract(text, '[\p{L}\p{N}\p{M}]+') unit from benchmark)"


@query(
    "x3_lookup",
    f"""with {WORDS}, {_ASKED}, h as (select distinct unit, sid from occ where unit in (select unit from asked)),
r as (select *, row_number() over (partition by unit order by sid) r from h)
select a.unit, count(r.sid) n, coalesce(string_agg(cast(r.sid as varchar), ',' order by r.sid) filter (where r.r <= 5), '') sids from asked a left join r on a.unit = r.unit group by a.unit""",
)
def _(s, d):
    asked = table(s, d, "benchmark").select(F.regexp_extract("text", tx.LETTER + "+", 0).alias("unit"))
    return units.lookup(src.words(s, d), asked)


@query("x5_trace", f"with {WORDS}, {_ASKED}, h as (select distinct unit, sid from occ where unit in (select unit from asked)) select unit, h.sid, length(sent) n from h join sents on h.sid = sents.sid")
def _(s, d):
    sents = src.sentences(s, d)
    asked = table(s, d, "benchmark").select(F.regexp_extract("text", tx.LETTER + "+", 0).alias("unit"))
    return units.trace(units.occurrences(sents), sents, asked).select("unit", "sid", F.length("sent").cast(long).alias("n"))


@query("x7_attested_joins", f'with {WORDS}, n as (select sid, unit "first", lead(unit) over (partition by sid order by pos) "second" from occ) select "first", "second", min(sid) sid, count(*) n from n where "second" is not null group by all')
def _(s, d):
    return units.attested_joins(src.neighbours(s, d))


@query("t5_gaps", rf"""with {SENTS}, g as (select unnest(regexp_extract_all(sent, '[\p{{L}}\p{{N}}\p{{M}}]([^\p{{L}}\p{{N}}\p{{M}}]+)[^\s]?', 1)) gap, sent from sents),
w as (select sent, regexp_replace(sent, '^[^\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{L}}\p{{N}}\p{{M}}]+$', '', 'g') t from sents),
x as (select unnest(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\p{{M}}]+')) gap from w)
select gap, count(*) n from x group by gap""")
def _(s, d):
    return units.gaps(src.word_spans(s, d)).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


@query("o1_o3_set_operations", rf"""with {WORDS}, s as (select distinct sid, unit from occ), a as (select sid from s where unit = 'the'), b as (select sid from s where unit = 'of')
select 'union' op, count(*) n, cast(sum(sid) as bigint) total from (select * from a union select * from b)
union all select 'intersect', count(*), cast(sum(sid) as bigint) from (select * from a intersect select * from b)
union all select 'except', count(*), cast(sum(sid) as bigint) from (select * from a except select * from b)""")
def _(s, d):
    p = units.postings(units.once(src.sentences(s, d)), "WORD")
    both = p.where("unit in ('the', 'of')").groupBy("block").agg(*(F.coalesce(F.max(F.when(F.col("unit") == u, F.col("sids"))), F.array().cast("array<bigint>")).alias(c) for u, c in (("the", "a"), ("of", "b"))))
    out = None
    for op, f in (("union", F.array_union), ("intersect", F.array_intersect), ("except", F.array_except)):
        one = both.select(F.explode(f("a", "b")).alias("sid")).agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"), F.sum("sid").alias("total"))
        out = one if out is None else out.union(one)
    return out


# ---------------------------------------------------------------- pairs and exact ratios

_PAIRS = """firsts as (select l_orderkey sid, l_partkey unit, min(l_linenumber) pos from lineitem group by all),
freq as (select unit, count(*) n from firsts group by unit),
pairs as (select a.unit q, b.unit, count(*) n, sum(case when a.pos < b.pos then 1 else 0 end)::bigint "before"
  from firsts a join firsts b on a.sid = b.sid where a.unit % 100 = 0 and a.unit in (select p_partkey from part) group by a.unit, b.unit)"""


def _pairs(s, d):
    firsts = pairs.first_positions(src.order_parts(s, d))
    return firsts, pairs.cooccurrence(firsts, src.asked_parts(s, d)), firsts.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("j1_j2_cooccurrence", f"with {_PAIRS} select * from pairs")
def _(s, d):
    return _pairs(s, d)[1]


@query(
    "a4_a5_energy_argmax",
    f"""with {_PAIRS}, e as (select p.q, f.unit, f.n + p.n num from pairs p join freq f on f.unit = p.unit where p.q <> p.unit), m as (select q, max(num) best from e group by q)
select e.q, case when count(*) = 1 and best > 0 then min(unit) end winner, best "value", count(*) ties from e join m on e.q = m.q and e.num = m.best group by e.q, best""",
)
def _(s, d):
    _, p, freq = _pairs(s, d)
    e = p.where("q <> unit").select("q", "unit", F.col("n").alias("shared")).join(freq, "unit").select("q", "unit", (F.col("n") + F.col("shared")).alias("num"))
    return pairs.unique_argmax(e, ["q"])


@query("a4_energy", f"with {_PAIRS}, s as (select unit, sum(n) shared from pairs group by unit) select f.unit, cast(f.n + coalesce(shared, 0) as bigint) num from freq f left join s on s.unit = f.unit")
def _(s, d):
    _, p, freq = _pairs(s, d)
    return pairs.energy(freq, p)


@query("a6_edge_flow", f"""with {_PAIRS}, s as (select unit, sum(n) shared from pairs group by unit), e as (select f.unit, f.n + coalesce(shared, 0) num from freq f left join s on s.unit = f.unit)
select p.unit v, p.q u, cast(e.num * p.n as bigint) num, f.n den from pairs p join e on e.unit = p.q join freq f on f.unit = p.q where p.q <> p.unit""")
def _(s, d):
    _, p, freq = _pairs(s, d)
    return pairs.edge_flow(p, freq, pairs.energy(freq, p))


@query("a7_binding", """with firsts as (select distinct l_orderkey sid, l_partkey unit from lineitem), size as (select sid, count(*) c from firsts group by sid)
select unit, cast(sum(c - 1) as bigint) num, count(*) den from firsts join size using (sid) group by unit""")
def _(s, d):
    return pairs.binding(pairs.first_positions(src.order_parts(s, d)))


@query("k2_share_groups", f'with {_PAIRS}, g as (select q, n, count(*) members, min(unit) first_member from pairs where q <> unit group by q, n) select *, row_number() over (partition by q order by n desc) "rank" from g')
def _(s, d):
    return pairs.share_groups(_pairs(s, d)[1]).withColumn("rank", F.col("rank").cast(long))


_TYPES = "case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end"


@query("a26_twins", f"""with f as (select user_id sid, event_id unit, {_TYPES} pos from events),
w as (select a.unit, b.unit other, sign(b.pos - a.pos) d from f a join f b on a.sid = b.sid and a.pos <> b.pos),
prof as (select unit, string_agg(other || ':' || d, ',' order by other) p from w group by unit) select count(*) members, min(unit) least, max(unit) greatest from prof group by p having count(*) > 1""")
def _(s, d):
    """Events of a user in the order of their types: events of one type may change places."""
    e = table(s, d, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("unit"), F.expr(_TYPES).alias("pos"))
    return pairs.twins(e)


# ---------------------------------------------------------------- followers

_ATT = f"""with {WORDS}, nx as (select sid, unit, lead(unit) over (partition by sid order by pos) nxt from occ),
att as (select sid, unit, case when nxt is null then 'end' when nxt in ({_P}) then 'particle' else 'other' end label, nxt from nx),
cnt as (select unit, nxt particle, count(*) c, count(distinct sid) sids from att where label = 'particle' group by unit, nxt)"""
_W = "case particle " + " ".join(f"when '{p}' then {w}" for p, w in zip(PARTICLES, followers.LADDER)) + " end"
_KIND = "top as (select unit, particle, c from (select *, max(c) over (partition by unit) m from cnt) where c = m), kinds as (select unit, case when count(*) = 1 then 'particle' else 'tied' end label, string_agg(particle, ',' order by particle) particles, max(c) count from top group by unit)"


def _counts(s, d):
    return followers.counts(followers.attachments(src.neighbours(s, d), PARTICLES))


@query("a9_followers", f"{_ATT} select label, count(*) n, count(distinct unit) units from att group by label")
def _(s, d):
    return followers.attachments(src.neighbours(s, d), PARTICLES).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("units"))


@query("a10_modes_with_ties", f"{_ATT}, {_KIND} select * from kinds")
def _(s, d):
    return followers.kinds(_counts(s, d))


@query("a11_adhesion", f"{_ATT} select unit, particle, sids adj, cast(sids * {_W} as bigint) num from cnt")
def _(s, d):
    return followers.adhesion(_counts(s, d), PARTICLES)


@query("k4_read_order", f"{_ATT}, {_KIND} select case label when 'particle' then 1 else 2 end bucket, particles, case label when 'particle' then {_W.replace('case particle', 'case particles')} else 0 end weight, count(*) units, min(unit) least from kinds group by all")
def _(s, d):
    return followers.read_order(followers.kinds(_counts(s, d)), PARTICLES)


@query("a23_window_counts", f"{_ATT} select nxt particle, count(*) c from att where label = 'particle' group by nxt")
def _(s, d):
    att = followers.attachments(src.neighbours(s, d), PARTICLES)
    return followers.window_counts(att)


@query("a25_anchors", f"""{_ATT}, k as (select distinct unit from cnt), sfx as (select unit, unnest(list_transform(range(2, length(unit)), lambda i: substr(unit, i))) suffix from k where length(unit) > 2)
select unit, arg_max(suffix, length(suffix)) anchor from sfx where suffix in (select unit from k) group by unit""")
def _(s, d):
    a = followers.adhesion(_counts(s, d), PARTICLES)
    return followers.anchors(a.select("unit").distinct(), a)


# ---------------------------------------------------------------- spans

_SPANS = """spans as (select user_id, event_id "start", event_id + 1 + cast(floor("value") as bigint) "end" from events),
flag as (select *, case when max("end") over (partition by user_id order by "start", "end" rows between unbounded preceding and 1 preceding) >= "start" then 0 else 1 end nw from spans),
isl as (select *, sum(nw) over (partition by user_id order by "start", "end" rows between unbounded preceding and current row) island from flag),
merged as (select user_id, island, min("start") "start", max("end") "end", count(*) parts from isl group by user_id, island)"""


def _event_spans(s, d):
    return table(s, d, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 1 + F.floor("value")).alias("end"))


@query("w4_span_merge", f"""with {_SPANS} select user_id, cast(island as bigint) island, "start", "end", parts from merged""")
def _(s, d):
    return intervals.merge(_event_spans(s, d), ["user_id"])


@query("j5_containment", f"""with {_SPANS} select m.user_id, m."start" o_start, m."end" o_end, s."start", s."end" from merged m join spans s on s.user_id = m.user_id and s."start" >= m."start" and s."end" <= m."end" """)
def _(s, d):
    inner = _event_spans(s, d)
    return intervals.contained(inner, intervals.merge(inner, ["user_id"]), "user_id")


@query("j6_tiling", f"""with {_SPANS}, c as (select m.user_id, m."start" a, m."end" b, min(s."start") lo, max(s."end") hi, sum(s."end" - s."start") n from merged m join spans s on s.user_id = m.user_id and s."start" >= m."start" and s."end" <= m."end" group by all)
select user_id, a o_start, b o_end from c where lo = a and hi = b and n = b - a""")
def _(s, d):
    inner = _event_spans(s, d)
    return intervals.tiled(intervals.contained(inner, intervals.merge(inner, ["user_id"]), "user_id"), "user_id")


@query("j7_w14_clauses", rf"""with {SENTS}, w as (select sid, regexp_extract_all(regexp_replace(sent, '^[^\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{L}}\p{{N}}\p{{M}}]+$', '', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+') g from sents)
select sid, len(list_filter(g[1:len(g) - 1], lambda x: regexp_matches(x, '{gate.BREAK}'))) clauses, len(g) gaps from w where len(g) > 0""")
def _(s, d):
    c = intervals.islands(units.gaps(src.word_spans(s, d)), gate.BREAK)
    return c.groupBy("sid").agg(F.max("clause").alias("clauses"), F.count(F.lit(1)).alias("gaps"))


@query("w6_session_ranges", 'select conv_id, min(turn) "first", max(turn) "last", count(*) n from conversations group by conv_id')
def _(s, d):
    return intervals.session_ranges(table(s, d, "conversations"), "conv_id", "turn")


# ---------------------------------------------------------------- facts


@query("w1_history", f"""with {FACTS} select "position", scope, ord, "value", case when row_number() over w = 1 then 'first' when change then 'update' else 'other' end kind,
case when change then old = lag("value") over w end old_matches from facts window w as (partition by "position", scope order by ord)""")
def _(s, d):
    return fx.history(src.facts(s, d))


@query(
    "w3_notes",
    f"""with {FACTS}, fr as (select *, row_number() over (partition by "position", scope, e, "value" order by ord) = 1 fresh from ep),
lv as (select a."position", a.scope, a.ord, a.sid, a."value", a.change, count(b.ord) n, count(b.ord) filter (b.sid <> a.sid and b."value" <> a."value") d, coalesce(bool_or(b."value" = a."value"), false) same
  from fr a left join fr b on b."position" = a."position" and b.scope is not distinct from a.scope and b.ord < a.ord and b.fresh and b.e = a.e - a.change::int group by all)
select "position", scope, ord, sid, "value", case when change then 'UPDATE' else 'SAME_SEAT' end note, d earlier_n from lv where (change and (d > 0 or n = 0)) or (not change and d > 0 and not same)""",
)
def _(s, d):
    return fx.notes(src.facts(s, d))


_LIVE = """last as (select *, max(e) over (partition by "position", scope) m from ep),
per as (select "position", scope, "value", max((e = m)::int) live from last group by all),
live as (select "position", scope, sum(live)::bigint n_live, coalesce(string_agg(cast("value" as varchar), '|' order by cast("value" as varchar)) filter (live = 1), '') live, count(*) > sum(live) has_history from per group by "position", scope)"""


@query("w2_live_values", f"with {FACTS}, {_LIVE} select * from live")
def _(s, d):
    return fx.live_values(src.facts(s, d))


@query(
    "w2_partial_fold",
    f"""with recursive {FACTS}, o as (select *, row_number() over (partition by "position", scope order by ord) rn from facts),
r as (select distinct "position", scope, 0::bigint rn, cast([] as bigint[]) live, false h from facts
  union all select o."position", o.scope, o.rn,
    case when change and old is not null and list_contains(live, old) and old <> "value" then list_distinct(list_append(list_filter(live, lambda v: v <> old), "value"))
      when change and old is null then ["value"] when change then live else list_distinct(list_append(live, "value")) end,
    h or (change and old is not null and list_contains(live, old) and old <> "value") or (change and old is null and len(list_filter(live, lambda v: v <> "value")) > 0)
  from r join o on o."position" = r."position" and o.scope is not distinct from r.scope and o.rn = r.rn + 1),
e as (select * from r qualify row_number() over (partition by "position", scope order by rn desc) = 1)
select "position", scope, array_to_string(list_sort(list_transform(live, lambda v: cast(v as varchar))), '|') live, len(live) n_live, h has_history from e""",
)
def _(s, d):
    return fx.fold_partial(src.facts(s, d))


@query("m8_verdicts", f"""with {FACTS}, {_LIVE}, v as (select "position", sum(n_live)::bigint n, max(n_live) most, max(has_history::int) o, count(*) scopes from live group by "position")
select "position", case when n = 0 then 'SUPERSEDED' when n = 1 and o = 1 then 'UPDATED' when n = 1 then 'ANSWER' else 'CHOICE' end verdict, case when n < 2 then '' when most >= 2 then 'same_seat' else 'scopes' end choice_kind, n, scopes from v""")
def _(s, d):
    return fx.verdicts(fx.live_values(src.facts(s, d)))


@query("j9_recall_routes", f"""with {FACTS}, {_LIVE}, v as (select "position", sum(n_live) n, max(has_history::int) o from live group by "position"),
vd as (select "position", case when n = 0 then 'SUPERSEDED' when n = 1 and o = 1 then 'UPDATED' when n = 1 then 'ANSWER' else 'CHOICE' end verdict from v),
w as (select c_custkey word from customer), h as (select word, word p, 0 r, 'exact' route from w where word in (select "position" from facts) union all select word, word - 1000, 1, 'bridge' from w where word - 1000 in (select "position" from facts)),
b as (select word, p, route from h qualify r = min(r) over (partition by word))
select w.word, coalesce(route, '') route, b.p "position", coalesce(verdict, 'NONE') verdict from w left join b on b.word = w.word left join vd on vd."position" = b.p""")
def _(s, d):
    f = src.facts(s, d)
    exact = f.select(F.col("position").alias("word"), "position").distinct()
    bridge = exact.select((F.col("word") + 1000).alias("word"), "position")
    asked = table(s, d, "customer").select(F.col("c_custkey").alias("word"))
    return fx.recall(asked, [("exact", exact), ("bridge", bridge)], fx.verdicts(fx.live_values(f)))


@query("j11_reversals", """with r as (select l_orderkey sid, l_partkey "first", lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) "second" from lineitem),
x as (select distinct sid, "first", "second" from r where "second" is not null and "first" <> "second")
select 'next' kind, a."first", a."second", a.sid, count(*) earlier_n, min(b.sid) earlier from x a join x b on b."first" = a."second" and b."second" = a."first" and b.sid < a.sid group by all""")
def _(s, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    r = table(s, d, "lineitem").select(F.lit("next").alias("kind"), F.col("l_orderkey").alias("sid"), F.col("l_partkey").alias("first"), F.lead("l_partkey").over(w).alias("second"))
    return fx.reversals(r.where("second is not null").distinct())


@query(
    "j12_enumerations",
    f"""with {FACTS}, n as (select *, row_number() over (partition by "position", scope order by ord) rn, row_number() over (partition by "position", scope, e, "value" order by ord) = 1 fresh from ep),
p as (select o."position", o.scope, o.ord, o.sid, o."value", s.scope s2, s.e, s."value" v2, max(s.e) over (partition by o."position", o.scope, o.ord, s.scope) m
  from n o join n s on s."position" = o."position" and s.scope is distinct from o.scope and s.ord < o.ord and s.fresh where o.rn = 1 and not o.change),
g as (select "position", scope, ord, sid, "value", s2 from p where e = m group by all having not bool_or(v2 = "value"))
select "position", scope, ord, sid, "value", count(*) others_n from g group by all""",
)
def _(s, d):
    return fx.enumerations(src.facts(s, d))


@query("w5_open_topics", """select user_id "session", event_id ord, last_value(case when event_type = 'signup' then props end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) topic from events""")
def _(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "signup", F.col("props")).alias("declared"))
    return fx.open_topics(rows).drop("declared")


@query("j15_supersede", """with r as (select o_custkey id, o_orderkey % 10 nt, nullif(o_orderkey % 7, 3) ot, o_orderstatus <> 'P' ns, o_orderpriority <> '5-LOW' os from orders),
g as (select id, min((ns and os)::int) s, min(coalesce((nt > ot)::int, 0)) l, count(*) retired from r group by id)
select id, case when s = 0 then 'unsourced_order' when l = 0 then 'supersede_order' else 'ok' end verdict, retired from g""")
def _(s, d):
    o = table(s, d, "orders")
    r = o.select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 10).alias("new_turn"), F.nullif(F.col("o_orderkey") % 7, F.lit(3)).alias("old_turn"), (F.col("o_orderstatus") != "P").alias("new_sourced"), (F.col("o_orderpriority") != "5-LOW").alias("old_sourced"))
    return fx.supersede_verdicts(r)


@query("w7_ranked_seats", """select o_custkey, o_orderstatus, o_orderkey, row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice desc, o_orderkey) ring from orders""")
def _(s, d):
    o = table(s, d, "orders").withColumn("sid", F.col("o_orderkey"))
    return fx.ranked_seats(o, ["o_custkey", "o_orderstatus"], [F.col("o_totalprice")]).select("o_custkey", "o_orderstatus", "o_orderkey", F.col("ring").cast(long).alias("ring"))


@query("m9_emit_decisions", """select event_id, case when event_type = 'error' then 'ambiguous_task' when "value" < 1 then 'value_boundary' when cast(props->>'$.k' as bigint) > 90 then 'contested_value' else 'emit' end decision from events""")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast(long)
    checks = [("ambiguous_task", F.col("event_type") == "error"), ("value_boundary", F.col("value") < 1), ("contested_value", k > 90)]
    return table(s, d, "events").select("event_id", fx.emit_decision(checks).alias("decision"))


# ---------------------------------------------------------------- ledgers

_BODY = "event_id || '|' || event_type || '|' || props"
_CHAIN = f"""chain as (
  with recursive b as (select user_id run, row_number() over (partition by user_id order by event_id) - 1 i, {_BODY} body from events),
  c as (select run, i, body, repeat('0', 64) prev, sha256(repeat('0', 64) || '|0|' || body) sha from b where i = 0
    union all select b.run, b.i, b.body, c.sha, sha256(c.sha || '|' || b.i || '|' || b.body) from c join b on b.run = c.run and b.i = c.i + 1)
  select * from c)"""


def _chain(s, d):
    e = table(s, d, "events")
    return ledger.seal(e, "user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"))


def _tampered(chain):
    return chain.where("not (run % 11 = 2 and i = 5)").withColumn("body", F.when((F.col("run") % 7 == 3) & (F.col("i") == 4), "changed").otherwise(F.col("body")))


@query("l1_seal", f"with {_CHAIN} select run, i, prev, sha from chain")
def _(s, d):
    return _chain(s, d).drop("body")


@query(
    "l5_verify",
    f"""with {_CHAIN}, heads as (select run, case when run % 13 = 1 then 'other' else arg_max(sha, i) end recorded from chain group by run),
t as (select run, i, case when run % 7 = 3 and i = 4 then 'changed' else body end body, prev, sha from chain where not (run % 11 = 2 and i = 5)),
p as (select run, i, sha, sha <> sha256(prev || '|' || i || '|' || body) a, prev <> coalesce(lag(sha) over w, repeat('0', 64)) b, i <> row_number() over w - 1 c from t window w as (partition by run order by i)),
g as (select run, count(*) n, arg_max(sha, i) head, sum(a::int)::bigint sha_mismatch, sum(b::int)::bigint prev_mismatch, sum(c::int)::bigint bad_index from p group by run)
select g.run, case when sha_mismatch + prev_mismatch + bad_index > 0 then 'TAMPERED' when head <> recorded then 'HEAD_MISMATCH' else 'OK' end status, n, sha_mismatch, prev_mismatch, bad_index from heads join g on g.run = heads.run""",
)
def _(s, d):
    chain = _chain(s, d)
    heads = ledger.head(chain).select("run", F.when(F.col("run") % 13 == 1, "other").otherwise(F.col("head")).alias("head"))
    return ledger.verify(_tampered(chain), heads)


_STORED = """lines as (
  with recursive b as (select user_id run, row_number() over (partition by user_id order by event_id) - 1 i, event_id e, event_type op from events),
  t as (select run, i, '{"actor":"user","args":{"event":' || e || '},"i":' || i || ',"op":"' || op || '","prev":"' x, '","result":null,' y, '"state_sha":"' || sha256(e::varchar) || '","v":1}' z from b),
  c as (select run, i, x || repeat('0', 64) || y a, z, sha256(x || repeat('0', 64) || y || z) sha from t where i = 0
    union all select t.run, t.i, x || c.sha || y, t.z, sha256(x || c.sha || y || t.z) from c join t on t.run = c.run and t.i = c.i + 1)
  select run, i, a || '"sha":"' || sha || '",' || z line, sha from c)"""


def _stored(s, d):
    body = F.to_json(
        F.struct(
            F.lit("user").alias("actor"), F.col("event_type").alias("op"), F.struct(F.col("event_id").alias("event")).alias("args"),
            F.lit(None).cast("string").alias("result"), F.sha2(F.col("event_id").cast("string"), 256).alias("state_sha"),
        ),
        {"ignoreNullFields": "false"},
    )
    return ledger.seal_lines(table(s, d, "events"), "user_id", "event_id", body)


@query("l1_stored_lines", f"with {_STORED} select run, i, line, sha from lines")
def _(s, d):
    return _stored(s, d)


@query(
    "l5_stored_status",
    f"""with {_STORED}, heads as (select run, max(i) top, case when run % 13 = 1 then 'other' when run % 13 <> 2 then arg_max(sha, i) end head from lines group by run),
d as (select run, row_number() over (partition by run order by i) - 1 i, run % 17 = 5 and i = top torn, case
    when run % 7 = 3 and i = 4 then replace(line, '"op":"', '"op":"x') when run % 7 = 4 and i = 2 then '{{ ' || line[2:]
    when run % 17 = 6 and i = 3 then 'no row' when run % 17 = 7 and i = 3 then '{{"v":1}}' when run % 17 = 5 and i = top then line[:20] else line end line
  from lines join heads using (run) where not (run % 11 = 2 and i = 5)),
r as (select *, json_valid(line) ok, json_valid(line) and line like '%"state_sha":"%' good from d),
f as (select *, case when good then line->>'$.sha' end sha, case when good then line->>'$.prev' end prev, case when good then cast(line->>'$.i' as bigint) end own from r),
p as (select *, case when i = 0 then repeat('0', 64) else lag(sha) over (partition by run order by i) end link, regexp_replace(replace(line, ' ', ''), '"sha":"[0-9a-f]+",', '') bare from f),
g as (select run, count(*) n, count_if(not ok and not torn) line_unparsable, count_if(ok and not good) bad_shape, count_if(good and own <> i) bad_index,
    count_if(good and sha256(bare) <> sha) sha_mismatch, count_if(good and link is not null and prev <> link) prev_mismatch, count_if(good and line like '% %') noncanonical_line,
    count_if(torn) torn_tail, arg_max(sha, i) filter (where sha is not null) "last" from p group by run),
h as (select g.*, head, (head is null)::bigint head_missing, coalesce(head <> "last" or "last" is null and head is not null, false)::bigint head_mismatch from g join heads using (run))
select run, case when line_unparsable + bad_shape + bad_index + sha_mismatch + prev_mismatch + noncanonical_line > 0 then 'TAMPERED' when torn_tail > 0 then 'TORN_TAIL'
  when head_missing + head_mismatch > 0 then 'HEAD_MISMATCH' else 'OK' end status, n::bigint n, line_unparsable::bigint line_unparsable, bad_shape::bigint bad_shape, bad_index::bigint bad_index,
  sha_mismatch::bigint sha_mismatch, prev_mismatch::bigint prev_mismatch, noncanonical_line::bigint noncanonical_line, torn_tail::bigint torn_tail, head_missing, head_mismatch from h""",
)
def _(s, d):
    kept = _stored(s, d)
    ends = kept.groupBy("run").agg(F.max_by("sha", "i").alias("last"), F.max("i").alias("top"))
    at = lambda m, k, i: (F.col("run") % m == k) & (F.col("i") == i)
    cut = at(17, 5, F.col("top"))
    harm = F.when(at(7, 3, 4), F.expr("""replace(line, '"op":"', '"op":"x')""")).when(at(7, 4, 2), F.concat(F.lit("{ "), F.expr("substring(line, 2)")))
    harm = harm.when(at(17, 6, 3), "no row").when(at(17, 7, 3), '{"v":1}').when(cut, F.expr("left(line, 20)")).otherwise(F.col("line"))
    lost = (F.col("run") % 11 == 2) & (F.col("i") >= 5)
    number = F.when(lost, F.col("i") - 1).otherwise(F.col("i"))
    lines = kept.join(ends, "run").where(~at(11, 2, 5)).select("run", number.alias("i"), harm.alias("line"))
    head = F.when(F.col("run") % 13 == 1, "other").when(F.col("run") % 13 != 2, F.col("last"))
    # the last line is gone where it was the sixth of a run that lost it
    torn = (F.col("run") % 17 == 5) & ~((F.col("run") % 11 == 2) & (F.col("top") == 5))
    return ledger.stored_status(ledger.stored_lines(lines), ends.select("run", torn.alias("torn"), head.alias("head")))


@query("l6_replay_difference", f"with {_CHAIN} select run, i, sha from chain where (run % 7 = 3 and i = 4) or (run % 11 = 2 and i = 5)")
def _(s, d):
    chain = _chain(s, d)
    return chain.select("run", "i", "body", "sha").exceptAll(_tampered(chain).select("run", "i", "body", "sha")).select("run", "i", "sha")


@query("x12_prefix", f"with {_CHAIN} select run, i, sha from chain where sha like '00%'")
def _(s, d):
    return ledger.find_by_prefix(_chain(s, d), "00").select("run", "i", "sha")


@query("j17_corrections", f"with {_CHAIN} select run, i, case when run % 5 = 0 and i < 3 then 2 else 0 end n from chain")
def _(s, d):
    chain = _chain(s, d)
    fixes = chain.where("run % 5 = 0 and i < 3").select("sha", F.explode(F.array(F.lit(1), F.lit(2))).alias("i")).withColumn("text", F.lit("see"))
    return ledger.with_corrections(chain, fixes).select("run", "i", F.when(F.col("corrections").isNull(), 0).otherwise(F.size("corrections")).alias("n"))


@query("w8_runaway_caps")
def _(s, d):
    c = src.calls(s, d)
    return ledger.capped_calls(c, "run", "seq", F.col("op"), F.col("op") == "error", repeat=2, status=10).select("run", "seq", F.coalesce("refused", F.lit("")).alias("refused"))


@query("w9_turn_budget", """with b as (select conv_id, turn, length(text) "full", least(coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0), 600) used from conversations)
select conv_id, turn, "full", cast(least("full", 600 - used) as bigint) kept from b""")
def _(s, d):
    return ledger.budget(table(s, d, "conversations"), "conv_id", "turn", F.length("text").cast(long), 600)


@query("w10_counted_caps", f"with {CALLS} select run, seq, op, row_number() over (partition by run, op order by seq) > case op when 'click' then 3 when 'view' then 5 else 1000000 end refused from calls")
def _(s, d):
    return ledger.counted_caps(src.calls(s, d), "run", "seq", "op", {"click": 3, "view": 5}).select("run", "seq", "op", "refused")


@query("w11_last_before", f"with {CALLS} select run, seq, last_value(case when refused then seq end ignore nulls) over (partition by run order by seq rows between unbounded preceding and 1 preceding) last_refused from calls")
def _(s, d):
    return src.calls(s, d).select("run", "seq", ledger.last_before(None, "run", "seq", F.col("refused"), F.col("seq")).alias("last_refused"))


@query("l17_settle", f"with {CALLS} select run, arg_max(op, seq) last_op, count(*) ops, count(*) filter (refused) refused, coalesce(arg_max(op, seq) filter (refused), '') last_refused from calls group by run")
def _(s, d):
    return ledger.settle(src.calls(s, d), "run", "seq")


_LINES = "occ as (select l_orderkey sid, l_partkey unit, l_linenumber pos from lineitem), placed as (select sid, unit, min(pos) pos from occ group by all)"


@query("k3_group_order", f"""with {_LINES}, c as (select a.unit seed, b.unit, count(*) n, min((sid, b.pos)) f from placed a join placed b using (sid) where a.unit % 100 = 0 and a.unit <> b.unit group by all)
select seed, unit, f[1] sid, f[2] pos, row_number() over (partition by seed order by f, unit) rank from c where n = 1""")
def _(s, d):
    """Seeds are parts whose key is divisible by 100; the tie is of the parts that share one order with them."""
    occ = table(s, d, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_partkey").alias("unit"), F.col("l_linenumber").alias("pos"))
    once = occ.select("sid", "unit").distinct()
    near = once.where("unit % 100 = 0").withColumnRenamed("unit", "seed").join(once, "sid").where("seed <> unit").groupBy("seed", "unit").agg(F.count(F.lit(1)).alias("n"))
    return units.group_order(occ, near.where("n = 1"))


@query("o5_merge_parts", """select l_orderkey, l_partkey, array_to_string(list_sort(list_distinct(flatten(list([l_suppkey, l_linenumber])))), ',') entries from lineitem group by all""")
def _(s, d):
    parts = table(s, d, "lineitem").withColumn("entries", F.array(F.col("l_suppkey").cast(long), F.col("l_linenumber").cast(long)))
    return units.merge_parts(parts, ["l_orderkey", "l_partkey"], "entries").withColumn("entries", F.array_join("entries", ","))


@query("l14_redaction", r"""select doc_id, sha256(regexp_replace(text, '((?i:api[_-]?key|token|secret|password)["'']?\s*[=:]\s*["'']?)[^\s"'']{8,}', '\1[REDACTED:kv_secret]', 'g')) sha from documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(docs.redact(F.col("text")), 256).alias("sha"))


def _hidden_sql(text: str) -> tuple[str, str]:
    """(redacted, hidden) of a text whose secrets neither overlap nor are disguised."""
    hidden = []
    for name, pattern in redaction.REDACT + redaction.REDACT_AFTER:
        key = (name, pattern.replace("(?!\\[REDACTED)", "").replace("'", "''"))
        hidden.append(f"len(regexp_extract_all({text}, '{key[1]}'))")
        text = f"regexp_replace({text}, '{key[1]}', '{chr(92) + '1' if (name, pattern) in redaction.REDACT_AFTER else ''}[REDACTED:{key[0]}]', 'g')"
    return text, " + ".join(hidden)


_L14 = _hidden_sql("coalesce(text, '')")


@query("l14_redaction_full", f"""with t as (select doc_id, text, ['[REDACTED:sk_ant]', '[REDACTED:sk_ant:b64]', '[REDACTED:sk_ant:pct]', 'plain'][1 + doc_id % 4] mark from documents)
  select doc_id, sha256(concat_ws(' ', case when text is not null then {_L14[0]} end, mark)) sha, case when doc_id % 4 < 3 then 1 else 0 end + {_L14[1]} hidden from t""")
def _(s, d):
    """Every text with a planted secret, most of them disguised."""
    key = F.concat(F.lit("sk-ant-abcdefgh"), F.col("doc_id").cast("string"))
    n = F.col("doc_id") % 4
    planted = F.when(n == 0, key).when(n == 1, F.base64(key.cast("binary"))).when(n == 2, F.replace(key, F.lit("-"), F.lit("%2D"))).otherwise("plain")
    red = redaction.redact_fully(F.concat_ws(" ", "text", planted))
    return table(s, d, "documents").select("doc_id", red.alias("r")).select("doc_id", F.sha2("r.text", 256).alias("sha"), "r.hidden")


@query("l14_redaction_json", r"""select event_id, sha256('{"api_key":' || case when user_id % 3 = 0 then '"[REDACTED:kv_secret]"' else '"short"' end || ',"nested":{"notes":["' || event_type || '",' || case when user_id % 2 = 0 then '"[REDACTED:sk_ant]"' else '"none"' end || ']}}') sha,
  (user_id % 3 = 0)::int + (user_id % 2 = 0)::int hidden from events""")
def _(s, d):
    """JSON rows with secrets by key name and by form."""
    by_key = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("value-"), F.col("user_id").cast("string"), F.lit("-long"))).otherwise("short")
    by_form = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("sk-ant-abcdefgh"), F.col("user_id").cast("string"))).otherwise("none")
    row = F.to_json(F.struct(by_key.alias("api_key"), F.struct(F.array("event_type", by_form).alias("notes")).alias("nested")))
    return table(s, d, "events").select("event_id", redaction.redact_json(row).alias("r")).select("event_id", F.sha2("r.text", 256).alias("sha"), "r.hidden")


# ---------------------------------------------------------------- audits, gate, scores

_SAID = f"""turns as (select conv_id * 100000 + turn doc_id, text from conversations),
  {SENTS.replace("from documents", "from turns").strip()},
  said as (select conv_id "session", turn, role, sent from sents join conversations on doc_id = conv_id * 100000 + turn)"""


def _said(s, d):
    """Every sentence of every turn."""
    c = table(s, d, "conversations").withColumn("doc_id", F.col("conv_id") * 100000 + F.col("turn"))
    return docs.split_sentences(c.select("doc_id", "text")).join(c.select("doc_id", F.col("conv_id").alias("session"), "turn", "role"), "doc_id")


@query("l10_unsourced_writes", f"""with {_SAID}, u as (select "session", sent, min(turn) t from said where role = 'user' group by all)
select f."session", f.turn, f.sent from said f left join u on u."session" = f."session" and u.sent = f.sent where u.t is null or u.t > f.turn""")
def _(s, d):
    said = _said(s, d)
    return audit.unsourced_writes(said.select("session", "turn", "sent"), said.where("role = 'user'"))


@query("j13_unrecorded", """with f as (select user_id "session", event_id turn, cast(props->>'$.k' as bigint) % 10 "position", event_type "value" from events), a as (select range "position", 'view' v from range(10)),
st as (select distinct "session", turn, "position" from f where turn % 3 = 0)
select f."session", f.turn, f."position", f."value" from f join a on a."position" = f."position" where f."value" <> v and turn % 3 <> 0""")
def _(s, d):
    f = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), (F.get_json_object("props", "$.k").cast(long) % 10).alias("position"), F.col("event_type").alias("value"))
    return audit.unrecorded_statements(f, f.where("turn % 3 = 0"), s.range(10).select(F.col("id").alias("position"), F.lit("view").alias("value")))


@query("j14_lossy_blocks", """with l as (select user_id, max(event_id) m from events where event_type = 'error' group by user_id) select e.user_id "session", event_id turn from events e join l on l.user_id = e.user_id where event_id <= m""")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), "event_type")
    return audit.lossy_blocked(e.drop("event_type"), e.where("event_type = 'error'"))


@query("l10_ambiguous_positions", """with r as (select user_id "session", event_id // 50 turn, event_id k, case when event_type <> 'error' then event_type end "position" from events),
x as (select *, lead("position") over w is null and lead(k) over w is not null nu from r window w as (partition by "session", turn order by k))
select "session", turn, "position", count(*) n, bool_or(nu) before_unread from x where "position" is not null group by "session", turn, "position" having count(*) > 1 or bool_or(nu)""")
def _(s, d):
    r = table(s, d, "events").select(F.col("user_id").alias("session"), F.expr("event_id div 50").alias("turn"), F.col("event_id").alias("k"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("position"))
    return audit.ambiguous_positions(r)


_FUNCTIONS = ", ".join(f"'{w}'" for w in READING.functions)


def _questions(s, d):
    """Benchmark items as read questions: the subject is the longest content word (the least of those), the
    word sought the one after it in that order; echo are all words. The form goes by the number."""
    told = F.filter(units.units(F.col("text")), lambda x: ~F.lower(x).isin(*READING.functions))
    d = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), told.alias("echo"))
    ranked = F.expr("array_sort(array_distinct(echo), (a, b) -> case when length(a) <> length(b) then length(b) - length(a) when a < b then -1 when a > b then 1 else 0 end)")
    d = d.withColumn("ranked", ranked).withColumn("n", F.pmod(F.col("qid").cast("long"), F.lit(21)))
    none = F.array().cast("array<string>")
    sought = F.get("ranked", F.lit(1))
    form = F.when(F.col("n") % 3 == 0, "slot").when(F.col("n") % 3 == 1, "predicate").otherwise("open")
    return d.select(
        "qid", form.alias("form"), F.slice("ranked", 1, 1).alias("subject"), F.slice("ranked", 1, 1).alias("chain"), none.alias("unread"), F.lit(False).alias("kind_only"),
        F.get(F.lit(list(PARTICLES)), (F.col("n") % 7).cast("int")).alias("particle"), F.when(form == "slot", sought).alias("head"),
        F.when((form == "predicate") & sought.isNotNull(), F.array(sought)).otherwise(none).alias("y_forms"), "echo",
    )


@query("p7_candidates", rf"""with {WORDS}, iw as (select item_id qid, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}]+')) w from benchmark),
q as (select qid, w from iw where lower(w) not in ({_FUNCTIONS}) qualify row_number() over (partition by qid order by length(w) desc, w) = 1) select qid, sid, min(pos) subject_pos from q join occ on unit = w group by qid, sid""")
def _(s, d):
    return gate.candidates(src.words(s, d), _questions(s, d)).withColumn("subject_pos", F.col("subject_pos").cast(long))


@query("a19_gate_score", """with v as (select "source" "set", l.doc_id id, quality = 1 a, n_chars > 1000 adm, toxic = 0 ok from labels l join documents d on d.doc_id = l.doc_id)
select "set", count(*) filter (a) answerable, count(*) filter (not a) unanswerable, count(*) filter (a and adm and ok) reach, count(*) filter (a and adm and not ok) wrong_admitting, count(*) filter (not a and adm) unans_admitted,
coalesce(sum(id) filter (a and adm and ok), 0)::bigint reach_sum from v group by "set" """)
def _(s, d):
    v = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return scores.gate_score(v.select(F.col("source").alias("set"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("answerable"), (F.col("n_chars") > 1000).alias("admitted"), (F.col("toxic") == 0).alias("correct")))


@query("a21_regressions", """with m as (select event_type "name", count(*) v from events where user_id % 2 = 0 and event_type <> 'view' group by 1), e as (select event_type "name", count(*) v from events where user_id % 2 = 1 and event_type <> 'click' group by 1)
select coalesce(m."name", e."name") "name", case when m.v is null then 'missing' when e.v is null then 'new' when coalesce(m."name", e."name") = 'error' and m.v > e.v or coalesce(m."name", e."name") <> 'error' and m.v < e.v then 'regressed' else 'ok' end status, m.v measured, e.v expected from m full join e on m."name" = e."name" """)
def _(s, d):
    e = table(s, d, "events")
    metric = lambda k, out: e.where((F.col("user_id") % 2 == k) & (F.col("event_type") != out)).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value")).withColumn("kind", F.when(F.col("name") == "error", "safety").otherwise("capability"))
    return scores.compare(metric(0, "view"), metric(1, "click"))


@query("a22_shares", "select lang kind, sum(length(text))::bigint chars, count(*) n from documents group by lang")
def _(s, d):
    return scores.shares(table(s, d, "documents").withColumnRenamed("lang", "kind"))


@query("a24_recovery", f"with {CALLS}, x as (select *, max(seq) filter (not refused) over (partition by run, op) ok_at from calls) select run, count(*) filter (ok_at > seq) num, count(*) den from x where refused group by run")
def _(s, d):
    return scores.recovery(src.calls(s, d), "run", "seq")


@query("a16_note_counts", f"""with {FACTS} select scope, e::bigint epoch, count(*) n from ep group by all""")
def _(s, d):
    return fx.note_counts(src.facts(s, d))


@query("k5_top_matches", """with h as (select conv_id, turn, contains(lower(text), ' the ')::int + contains(lower(text), ' of ')::int + contains(lower(text), ' de ')::int hits from conversations)
select conv_id, turn, hits from h where hits > 0 qualify row_number() over (partition by conv_id order by hits desc, turn desc) <= 2""")
def _(s, d):
    return scores.top_matches(table(s, d, "conversations"), "conv_id", "turn", "text", [" the ", " of ", " de "], 2).select("conv_id", "turn", "hits")


@query("k6_last_matches", "select user_id, event_id from events where event_type = 'error' qualify row_number() over (partition by user_id order by event_id desc) <= 30")
def _(s, d):
    return scores.last_matches(table(s, d, "events"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


@query("x10_capped_view", "select user_id, event_id, greatest(count(*) over (partition by user_id) - 40, 0) omitted from events qualify row_number() over (partition by user_id order by event_id) <= 40")
def _(s, d):
    return scores.capped_view(table(s, d, "events"), "user_id", [F.col("event_id")]).select("user_id", "event_id", "omitted")


# ---------------------------------------------------------------- crosses


_ROT = "rot as (select * from (values " + ", ".join(f"({r}, {a}, {p[a]})" for r, p in enumerate(geometry.PERMS) for a in range(geometry.ARMS)) + ") t(rotation, arm, image))"


@query("r1_rotations", f"""with {_ROT}, keys as (select rotation, string_agg(image::varchar, '' order by arm) p from rot group by rotation),
c as (select g.rotation g, h.rotation h, string_agg(g.image::varchar, '' order by h.arm) p from rot h join rot g on g.arm = h.image group by all) select g, h, rotation from c join keys using (p)""")
def _(s, d):
    return geometry.compositions(geometry.rotations(s))


@query("r2_r3_seats", f"""with {_ROT}, seat as (select a.range::int * 3 + k.range::int + 1 seat, k.range k from range(6) a, range(3) k),
apart as (select rotation, "section".range::int "section", (image - "section".range + 6) % 6 d from rot, range(6) "section")
select seat a, case k when 2 then 0 else seat + 1 end::int b, 'edge' "what" from seat union all select rotation, "section", 'sees ' || count(*) from apart where d <= 1 or d >= 5 group by rotation, "section" """)
def _(s, d):
    n = 3
    seats = geometry.seats(s, n)
    seen = geometry.visible(geometry.rotations(s)).groupBy("rotation", "section").agg(F.count(F.lit(1)).alias("arms"))
    return geometry.edges(seats, n).select(F.col("seat").alias("a"), F.col("towards").alias("b"), F.lit("edge").alias("what")).union(seen.select("rotation", "section", F.concat(F.lit("sees "), F.col("arms"))))


def _arm_contents(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.col("user_id").alias("cross"), (F.col("event_id") % 6).cast("int").alias("arm")).agg(F.count(F.lit(1)).cast("string").alias("content"))


@query("r4_canonical_keys", f"""with {_ROT}, c as (select user_id "cross", event_id % 6 arm, cast(count(*) as varchar) content from events group by all),
t as (select "cross", rotation, string_agg(content, '/' order by image) key from c join rot on rot.arm = c.arm group by "cross", rotation) select "cross", min(key) key from t group by "cross" """)
def _(s, d):
    return geometry.canonical(_arm_contents(s, d), geometry.rotations(s))


@query("r6_alignment", f"""with {_ROT}, c as (select user_id id, event_id % 6 arm, cast(props->>'$.k' as bigint) % 6 data_arm, count(*) c from events group by all),
x as (select id, rotation, sum(c)::bigint score from c join rot on rot.arm = c.arm and rot.image = c.data_arm group by id, rotation) select id, rotation, score from x qualify rank() over (partition by id order by score desc) = 1""")
def _(s, d):
    e = table(s, d, "events")
    counts = e.groupBy(F.col("user_id").alias("id"), (F.col("event_id") % 6).cast("int").alias("arm"), (F.get_json_object("props", "$.k").cast(long) % 6).cast("int").alias("data_arm")).agg(F.count(F.lit(1)).alias("c"))
    return geometry.align(counts, geometry.rotations(s))


def _pools(s, d):
    """Per asked part, its twelve closest parts (the pool is the feature) and their shared orders."""
    firsts, p, _ = _pairs(s, d)
    top = p.where("q <> unit").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("n"), "unit"))).where("r <= 12").select(F.col("q").alias("seed"), "unit")
    pool = top.union(top.select("seed", F.col("seed").alias("unit")).distinct())
    seated = pool.join(firsts.select("sid", "unit"), "unit")
    x, y = seated.select("seed", "sid", F.col("unit").alias("u")), seated.select("seed", "sid", F.col("unit").alias("v"))
    return x.join(y, ["seed", "sid"]).where("u < v").groupBy("seed", "u", "v").agg(F.count(F.lit(1)).alias("n"))


@query("r7_placement")
def _(s, d):
    return geometry.place(_pools(s, d), 2)


@query("r9_stability")
def _(s, d):
    weights = _pools(s, d)
    return geometry.improving_swaps(geometry.place(weights, 2), weights, geometry.edges(geometry.seats(s, 2), 2))


# ---------------------------------------------------------------- the store and its ledger

_LEDGER = """led as (
  select user_id "session", event_id i, case event_type when 'click' then 'write' when 'signup' then 'declare_topic' when 'purchase' then 'supersede' when 'view' then 'keep_unshaped' else 'commit' end op,
    cast(props->>'$.k' as bigint) % 4 <> 0 ok, event_type || ' ' || (props->>'$.k') txt, cast(props->>'$.k' as bigint) k from events where user_id % 5 <> 1 or event_type <> 'error')"""
_DONE = """done as (select distinct "session" from led where op = 'commit' and ok)"""


def _ledger_rows(s, d):
    e = table(s, d, "events").where("user_id % 5 <> 1 or event_type <> 'error'")
    k = F.get_json_object("props", "$.k")
    op = F.when(F.col("event_type") == "click", "write").when(F.col("event_type") == "signup", "declare_topic").when(F.col("event_type") == "purchase", "supersede").when(F.col("event_type") == "view", "keep_unshaped").otherwise("commit")
    args = F.to_json(F.struct(F.concat_ws(" ", "event_type", k).alias("text"), F.concat_ws("-", "user_id", "event_id").alias("turn"), k.alias("topic")))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("i"), op.alias("op"), (k.cast(long) % 4 != 0).alias("ok"), args.alias("args"))


@query("s12_memory_rows", f"""with {_LEDGER}, {_DONE} select "session", i, txt sent, "session" || '-' || i turn, op = 'keep_unshaped' unshaped from led where op in ('write', 'keep_unshaped') and ok and "session" in (select "session" from done)""")
def _(s, d):
    return store.memory_rows(_ledger_rows(s, d))


@query("s13_topics", f"""with {_LEDGER}, {_DONE} select "session", i, cast(k as varchar) topic from led where op = 'declare_topic' and ok and "session" in (select "session" from done)""")
def _(s, d):
    return store.side_table(_ledger_rows(s, d), "declare_topic", ("topic",))


@query("p13_rejects", f"""with {_LEDGER} select "session", i, op, 'oversize:text' reason from led where length(txt) > 8""")
def _(s, d):
    return store.rejects(_ledger_rows(s, d), {"text": 8})


@query("l18_session_events", f"""with {_LEDGER} select "session", op, count(*) n, count(*) filter (not ok) refused from led group by all""")
def _(s, d):
    return store.session_events(_ledger_rows(s, d))


@query("w12_self_corrections", f"""with {_LEDGER}, x as (select *, lead(i) over w ni, lead(txt) over w nt from led where op in ('write', 'keep_unshaped') window w as (partition by "session", k % 3 order by i))
select "session", i, ni next_i from x where not ok and ni is not null and nt <> txt""")
def _(s, d):
    return store.self_corrections(_ledger_rows(s, d), F.get_json_object("args", "$.topic").cast(long) % 3)


@query("m5_superseded", f"""with {_LEDGER}, {_DONE}, mem as (select "session", i from led where op in ('write', 'keep_unshaped') and ok and "session" in (select "session" from done)),
mk as (select m."session", m.i, min(l.i) "by" from mem m join led l on l."session" = m."session" and l.op = 'supersede' and l.k % 10 = m.i % 10 and l.i > m.i group by all)
select mem."session", mem.i, mk."by" from mem left join mk on mk."session" = mem."session" and mk.i = mem.i""")
def _(s, d):
    rows = _ledger_rows(s, d)
    mem = store.memory_rows(rows)
    sup = rows.where("op = 'supersede'").select("session", F.col("i").alias("at"), (F.get_json_object("args", "$.topic").cast(long) % 10).alias("r"))
    marks = mem.select("session", F.col("i").alias("old_i"), (F.col("i") % 10).alias("r")).join(sup, ["session", "r"]).where("at > old_i").select("session", "old_i", F.col("at").alias("i"), F.lit("newer").alias("reason"))
    return store.superseded(mem, marks).select("session", "i", "by")


@query("a17_statistics", f"""with {FACTS}, p as (select scope, "position", count(*) c from facts group by all) select scope, count(*) positions, sum(c)::bigint entries, max(c) longest from p group by scope""")
def _(s, d):
    return store.statistics(src.facts(s, d))


@query("v3_state_fold", """with r as (select user_id run, event_id i, event_id % 5 seat, case when event_type <> 'error' then event_type end unit from events),
l as (select run, seat, arg_max_null(unit, i) unit, max(i) i from r group by run, seat) select * from l where unit is not null""")
def _(s, d):
    e = table(s, d, "events")
    rows = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("i"), F.when(F.col("event_type") == "error", "drop").otherwise("put").alias("op"), (F.col("event_id") % 5).alias("seat"), F.col("event_type").alias("unit"))
    return store.fold_placements(rows)


@query("l8_replay", f"""with {_LEDGER}, {_DONE}, mem as (select "session", i, txt sent from led where op in ('write', 'keep_unshaped') and ok and "session" in (select "session" from done))
select "session", i, sent, 'derived' side from mem where "session" % 7 = 3 and i % 5 = 0 union all
select "session", i, sent, 'derived' from mem where "session" % 11 = 2 and not ("session" % 7 = 3 and i % 5 = 0) union all
select "session", i, sent || ' more', 'stored' from mem where "session" % 11 = 2 and not ("session" % 7 = 3 and i % 5 = 0)""")
def _(s, d):
    """A stored memory in which rows are missing and sentences differ, against the rows of its ledger."""
    derived = store.memory_rows(_ledger_rows(s, d)).select("session", "i", "sent")
    stored = derived.where("not (session % 7 = 3 and i % 5 = 0)").withColumn("sent", F.when(F.col("session") % 11 == 2, F.concat("sent", F.lit(" more"))).otherwise(F.col("sent")))
    return store.replayed(stored, derived)


@query("j10_event_match", """with w as (select 0 q, 'flag' arm, 'R' phrase union all select 0, 'status', 'F' union all select 1, 'status', 'O'), ev as (
  select l_orderkey * 10 + l_linenumber event, 'flag' arm, l_returnflag phrase from lineitem union all select l_orderkey * 10 + l_linenumber, 'status', l_linestatus from lineitem),
need as (select q, count(*) n from w group by q), hit as (select w.q, ev.event, count(distinct ev.arm) g from ev join w on w.arm = ev.arm and w.phrase = ev.phrase group by all)
select hit.q, event from hit join need on need.q = hit.q where g = n""")
def _(s, d):
    li = table(s, d, "lineitem").withColumn("event", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    ev = li.select("event", F.lit("flag").alias("arm"), F.col("l_returnflag").alias("phrase")).union(li.select("event", F.lit("status"), "l_linestatus"))
    wanted = s.createDataFrame([(0, "flag", "R"), (0, "status", "F"), (1, "status", "O")], "q int, arm string, phrase string")
    return matching.match_all(ev, wanted)


@query("j19_membership", """with c as (select event_id clause, event_type centre, user_id, cast(props->>'$.k' as bigint) k from events), h as (select 'view' head, 1 nest union all select 'p3', 2),
x as (select clause, nest, 1 r from c join h on head = centre union all select clause, nest, 2 from c join h on head = 'p' || (k % 5) union all select clause, 1, 3 from c where user_id % 2 = 0),
b as (select clause, nest, min(r) r from x group by all) select clause, nest, case r when 1 then 'centre' when 2 then 'path' else 'context' end why from b""")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast(long)
    c = table(s, d, "events").select(F.col("event_id").alias("clause"), F.col("event_type").alias("centre"), F.array(F.concat(F.lit("p"), (k % 5).cast("string"))).alias("path"), F.when(F.col("user_id") % 2 == 0, 1).alias("open_nest"))
    return matching.membership(c, s.createDataFrame([("view", 1), ("p3", 2)], "head string, nest int"))


@query("a8_agreement", f"""with {_PAIRS}, own as (select p.q, p.unit, p.n, "before", f.n + p.n e from pairs p join freq f on f.unit = p.unit where p.q <> p.unit),
x as (select q, unit, e v, 'a' k from own union all select q, unit, n, 'b' from own union all select q, unit, "before", 'c' from own),
top as (select *, max(v) over (partition by q, k) m from x), w as (select q, k, case when count(*) = 1 and m > 0 then min(unit) end win from top where v = m group by q, k, m),
t as (select q, max(win) filter (k = 'a') a, max(win) filter (k = 'b') b, max(win) filter (k = 'c') c from w group by q),
st as (select *, case when a is null or b is null or c is null then 'points_nowhere' when a = b and b = c then 'agree' else 'ratio_disagreement' end status from t)
select q, status, case status when 'agree' then a end unit from st""")
def _(s, d):
    _, p, freq = _pairs(s, d)
    own = p.where("q <> unit")
    e = own.select("q", "unit", F.col("n").alias("s")).join(freq, "unit").select("q", "unit", (F.col("n") + F.col("s")).alias("num"))
    return matching.agreement(*(pairs.unique_argmax(x, ["q"]) for x in (e, own.withColumnRenamed("n", "num"), own.withColumnRenamed("before", "num"))), by="q")


@query("k7_candidates", f"""with {_PAIRS}, sc as (select q, unit candidate, n score from pairs where q <> unit and n >= 2), x as (select *, max(score) over (partition by q) b, row_number() over (partition by q order by score desc, candidate) "rank" from sc),
y as (select *, sum((score = b)::int) over (partition by q) f from x) select q, candidate, score, "rank", score = b and f > 1 tied_with_best from y where "rank" <= 5""")
def _(s, d):
    p = _pairs(s, d)[1].where("q <> unit").select("q", F.col("unit").alias("candidate"), F.col("n").alias("score"))
    return matching.top_candidates(p, "q").withColumn("rank", F.col("rank").cast(long))


@query("a20_note_hits", f"""with {FACTS}, n as (select case when change then 'UPDATE' else 'SAME_SEAT' end kind, ord turn from facts where "value" > 3), p as (select case when "value" % 2 = 0 then 'UPDATE' else 'SAME_SEAT' end kind, ord turn from facts where "position" % 3 = 0)
select n.kind, count(*) firings, count(p.turn) hits, count(*) - count(p.turn) false_alarms, count(p.turn) found, (select count(*) from p q where q.kind = n.kind) plants from n left join p on p.kind = n.kind and p.turn = n.turn group by n.kind""")
def _(s, d):
    f = src.facts(s, d)
    notes = f.where("value > 3").select(F.when(F.col("change"), "UPDATE").otherwise("SAME_SEAT").alias("kind"), F.col("ord").alias("turn"))
    plants = f.where("position % 3 = 0").select(F.when(F.col("value") % 2 == 0, "UPDATE").otherwise("SAME_SEAT").alias("kind"), F.col("ord").alias("turn"))
    return matching.note_hits(notes, plants)


@query("m13_conflicts", """select 'T' tier, o_custkey centre, o_orderstatus arm, count(distinct o_orderpriority) n, min(o_orderpriority) "one", max(o_orderpriority) other from orders group by all having count(distinct o_orderpriority) >= 2""")
def _(s, d):
    return matching.conflicts(table(s, d, "orders").select(F.lit("T").alias("tier"), F.col("o_custkey").alias("centre"), F.col("o_orderstatus").alias("arm"), F.col("o_orderpriority").alias("content")))


@query("m12_unanchored", f"""{_ATT}, adh as (select unit, particle, sids adj from cnt), b as (select unit, max(adj) best from adh group by unit), seated as (select distinct unit, 'the' particle from cnt)
select s.unit, s.particle, best from seated s left join adh a on a.unit = s.unit and a.particle = s.particle join b on b.unit = s.unit where coalesce(adj, 0) = 0 and best >= 2""")
def _(s, d):
    a = followers.adhesion(_counts(s, d), PARTICLES)
    return matching.unanchored(a.select("unit").distinct().withColumn("particle", F.lit("the")), a)


@query("x4_read_sentences", f"""with {WORDS} select sid, 'WORD' tier, string_agg(unit, '/' order by pos) units from occ group by sid""")
def _(s, d):
    return matching.read_sentences({"WORD": src.words(s, d)})


@query("x6_tiers_holding", rf"""with {WORDS}, a as (select distinct regexp_extract(text, '[\p{{L}}\p{{N}}\p{{M}}]+') unit from benchmark union select 'a'), ch as (select distinct unnest(regexp_extract_all(sent, '[\p{{L}}\p{{N}}\p{{M}}]')) unit from sents),
h as (select unit, 'WORD' tier from a where unit in (select unit from occ) union all select unit, 'CHAR' from a where unit in (select unit from ch)) select unit, string_agg(tier, ',' order by tier) tiers from h group by unit""")
def _(s, d):
    sents = src.sentences(s, d)
    asked = table(s, d, "benchmark").select(F.regexp_extract("text", tx.LETTER + "+", 0).alias("unit")).union(s.createDataFrame([("a",)], "unit string"))
    return matching.tiers_holding({t: units.occurrences(sents, t) for t in units.TIERS}, asked)


@query("t16_owner_text", r"""select conv_id, turn, length(trim(regexp_replace(text, '(?s)<system-reminder>.*?(?:</system-reminder>|$)', '', 'g'))) n from conversations""")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.length(matching.owner_text(F.col("text"))).cast(long).alias("n"))


@query("t7_clauses")
def _(s, d):
    return clauses.accepted(clauses.exchange(src.sentences(s, d)))


@query("t1_runs", rf"""with {SENTS}, r as (select unnest(regexp_extract_all(sent, '[\p{{Han}}\p{{Katakana}}ー々]+|\p{{Hiragana}}+|[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{N}}\p{{M}}]+')) unit from sents) select unit, count(*) n from r group by unit""")
def _(s, d):
    return src.sentences(s, d).select(F.explode(units.runs(F.col("sent"))).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("p2_content_units", f"with {WORDS} select sid, count(*) n from occ where unit not in ({_P}) group by sid")
def _(s, d):
    return units.without(src.words(s, d), s.createDataFrame([(p,) for p in PARTICLES], "unit string")).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query("a12_arrangements", f"{_ATT}, adh as (select unit, particle, sids * {_W} num from cnt), seat as (select sid, unit, nxt particle from att where label = 'particle') select s.sid \"cross\", coalesce(sum(num), 0)::bigint a_num, count(*) seats from seat s left join adh a on a.unit = s.unit and a.particle = s.particle group by s.sid")
def _(s, d):
    att = followers.attachments(src.neighbours(s, d), PARTICLES).where("label = 'particle'")
    a = followers.adhesion(followers.counts(att), PARTICLES)
    return followers.arrangement(att.select(F.col("sid").alias("cross"), "unit", "particle"), a)


@query("x9_holding", f"""with {FACTS} select "value", "position", min(ord) since, count(*) times from facts where "value" in (select r_regionkey from region) group by all""")
def _(s, d):
    return fx.holding(src.facts(s, d), table(s, d, "region").select(F.col("r_regionkey").cast(long).alias("value")))


@query("o4_first_order", """with f as (select conv_id, role, min(turn) t from conversations group by all) select conv_id, string_agg(role, ',' order by t) "values" from f group by conv_id""")
def _(s, d):
    return scores.in_first_order(table(s, d, "conversations"), "conv_id", "turn", "role")


@query("k10_fixed_order", """select event_id, case event_type when 'error' then 1 when 'view' then 2 when 'click' then 3 else 4 end place from events""")
def _(s, d):
    return table(s, d, "events").select("event_id", scores.fixed_order("event_type", ("error", "view", "click")).cast("int").alias("place"))


@query("k11_newest_runs", "select user_id, max(event_id) last from events group by user_id order by last desc limit 200")
def _(s, d):
    return scores.newest(table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last")), "last")


@query("s9_extend", f"with {_CHAIN} select run, i, prev, sha from chain")
def _(s, d):
    e = table(s, d, "events")
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    start = e.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    old, new = start.where("k <= 20"), start.where("k > 20")
    first = ledger.seal(old, "user_id", "event_id", body)
    return first.union(ledger.extend(ledger.head(first), new, "user_id", "event_id", body)).drop("body")


# ---------------------------------------------------------------- event time (extension)


@query("ext_tumbling", """select time_bucket(interval '1 hour', ts) "start", event_type, count(*) n, sum(cast(round("value" * 100) as bigint))::bigint cents from events group by all""")
def _(s, d):
    return windows.tumbling(table(s, d, "events"), "1 hour")


@query("ext_sessions", """with f as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end nw from events window w as (partition by user_id order by ts)),
g as (select *, sum(nw) over (partition by user_id order by ts rows between unbounded preceding and current row) k from f)
select min(ts) "start", max(ts) + interval '30 minutes' "end", user_id, count(*) n from g group by user_id, k""")
def _(s, d):
    return windows.sessions(table(s, d, "events"), "30 minutes")
