"""Queries over the evidence gate. Benchmark items give questions: wherever two words stand around a
third with a particle on either side ("a of b the c"), the third is asked for
("a of quid the c?"), or asked by its predicate, or left out. The questions are read and judged like
any others; the SQL knows their reading from how they were made and walks over every stretch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.functions.text import LETTER
from factspan.operators import components, gate, questions, scores, units
from factspan.plans import inputs as src
from factspan.plans.inputs import PARTICLES, READING, SENTS
from factspan.plans.named import query
from factspan.session import table

GRAMMAR = questions.Grammar(READING, ("quid",), "the", ("in", "to", "de", "la", "and", "of"))
_WORD = r"[\p{L}\p{N}\p{M}]"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_PLAIN = _quoted(READING.functions)
_P = _quoted(PARTICLES)

#: (qid, a, p, b, r, c): the places of an item that its questions are made from.
ASKED = rf"""
toks as (select item_id qid, regexp_extract_all(text, '{_WORD}+') u, string_split_regex(text, '{_WORD}+') b from benchmark),
places as (select qid, u, b, unnest(range(1, len(u) - 3)) i from toks),
asked as (select qid * 100000 + i qid, u[i] a, lower(u[i + 1]) p, u[i + 2] b, lower(u[i + 3]) r, u[i + 4] c, i from places
  where lower(u[i + 1]) in ({_P}) and lower(u[i + 3]) in ({_P}) and lower(u[i]) not in ({_PLAIN}) and lower(u[i + 2]) not in ({_PLAIN}) and lower(u[i + 4]) not in ({_PLAIN})
    and b[i + 1] = ' ' and b[i + 2] = ' ' and b[i + 3] = ' ' and b[i + 4] = ' ')"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(qid, a, p, b, r, c) as in ASKED."""
    d_ = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), units.units(F.col("text")).alias("u"), F.split("text", f"{LETTER}+", -1).alias("b"))
    plain, particle = (lambda k: f"not array_contains(array({_PLAIN}), lower(get(u, i + {k})))"), (lambda k: f"array_contains(array({_P}), lower(get(u, i + {k})))")
    fits = " and ".join([plain(0), particle(1), plain(2), particle(3), plain(4), *(f"get(b, i + {k}) = ' '" for k in (1, 2, 3, 4))])
    d_ = d_.where("size(u) > 4").withColumn("at", F.expr(f"filter(sequence(0, greatest(size(u) - 5, 0)), i -> {fits})"))
    d_ = d_.select("qid", "u", F.explode("at").alias("i")).withColumn("qid", F.col("qid") * 100_000 + F.col("i") + 1)
    word = lambda k: F.get("u", F.col("i") + k)
    return d_.select("qid", word(0).alias("a"), F.lower(word(1)).alias("p"), word(2).alias("b"), F.lower(word(3)).alias("r"), word(4).alias("c"))


def asked_texts(spark: SparkSession, d: str) -> DataFrame:
    """(qid, text): by number a slot, a predicate or a question without a question word."""
    slot = F.concat_ws(" ", "a", "p", F.lit("quid"), "r", "c")
    predicate = F.concat_ws(" ", "a", F.lit(READING.genitive), "b", F.lit(READING.topic), F.lit("quid"))
    text = F.when(F.col("qid") % 4 == 3, F.concat_ws(" ", "b", "a")).when(F.col("qid") % 4 == 2, predicate).otherwise(slot)
    return asked(spark, d).select("qid", F.concat(text, F.lit("?")).alias("text"))


def read_questions(spark: SparkSession, d: str) -> DataFrame:
    return questions.read_questions(asked_texts(spark, d), GRAMMAR)


#: What the questions of ASKED read as.
READ = f"""{ASKED},
q as (select qid, case when qid % 4 = 3 then 'open' when qid % 4 = 2 then 'predicate' else 'slot' end form,
  case when qid % 4 < 3 then a end subject, case when qid % 4 < 2 then r end particle, case when qid % 4 < 2 then c end head, case when qid % 4 = 2 then b end y,
  case when qid % 4 < 2 then [a, c] when qid % 4 = 2 then [a, b] else [b, a] end echo from asked)"""


@query(
    "t9_questions",
    f"""with {READ} select qid, form, coalesce(subject, '') subject, coalesce(particle, '') particle, coalesce(head, '') head, coalesce(y, '') y,
  case when form = 'predicate' then 'chain' when form = 'open' then '' when (select p from asked where asked.qid = q.qid) = 'the' then 'subject' else 'case' end level,
  array_to_string(echo, '|') echo from (select qid, form, subject, particle, head, y, case when echo[1] = echo[2] then echo[1:1] else echo end echo from q) q""",
)
def _(s, d):
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return read_questions(s, d).select("qid", "form", F.array_join("subject", "|").alias("subject"), text("particle"), text("head"), text("y"), text("level"), F.array_join("echo", "|").alias("echo"))


def candidates(spark: SparkSession, d: str, q: DataFrame) -> DataFrame:
    """The sentences that may answer the questions, one row per question and sentence."""
    # the sentence goes along with its words, so texts are cut into sentences once
    return gate.candidates(units.occurrences(src.sentences(spark, d), keep=("sid", "sent")), q, keep=("sent",))


def held(cands: DataFrame, q: DataFrame) -> DataFrame:
    return gate.stretches(cands, gate.sentence_arrays(cands.select("sid", "sent").distinct(), READING), q)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of the candidates in which one can pass, with their codes."""
    q = read_questions(spark, d)
    return gate.judge(held(components.written(gate.promising(candidates(spark, d, q), q), "candidates"), q))


def _class(chars: str) -> str:
    return "[" + re.escape(chars).replace("'", "''") + "]"


_LINKS = _quoted((*PARTICLES, READING.topic))
_TOPICS = _quoted((READING.topic, READING.topic + ",", READING.topic + "、"))

#: Every stretch of every candidate sentence with its codes as a list in the fixed order, one rule at a time.
WALK = rf"""{SENTS}, {READ},
cand as (select qid, sid, sent from q join sents on list_contains(regexp_extract_all(sent, '{_WORD}+'), q.subject)),
cs as (select distinct sid, regexp_extract_all(sent, '{_WORD}+') u, string_split_regex(sent, '{_WORD}+') b from cand),
pos as (select sid, u, b, unnest(list_filter(range(0, len(u)), lambda i: lower(u[i + 1]) not in ({_PLAIN}))) i from cs),
nx as (select *, coalesce(lead(i) over w, len(u)) nxt, row_number() over w - 1 k, count(*) over (partition by sid) n from pos window w as (partition by sid order by i)),
gaps as (select sid, k, n, u[i + 1] unit, array_to_string(list_transform(range(i + 1, nxt + 1), lambda j: b[j + 1] || case when j < nxt then u[j + 1] else '' end), '') gap from nx),
told as (select *, regexp_replace(unit, '{_class(gate.IGNORE)}', '', 'g') spelt, lower(regexp_replace(gap, '{_class(gate.IGNORE)}', '', 'g')) bare, list_transform(regexp_extract_all(gap, '{_WORD}+'), lambda w: lower(w)) ws,
  regexp_replace(regexp_replace(gap, '{_WORD}+', '', 'g'), '{_class(gate.IGNORE)}', '', 'g') marks, regexp_matches(gap, '{_class(gate.CLAUSE_END)}') ended,
  list_has_any(list_transform(regexp_extract_all(regexp_extract(gap, '^[^{re.escape(gate.CLAUSE_END)}]*'), '{_WORD}+'), lambda w: lower(w)), [{_quoted(READING.negations)}]) negated from gaps),
holds as (select *, regexp_full_match(bare, '{_class(gate.JOINERS)}*') joined, bare in ({_TOPICS}) topic, bare = '' or bare in ({_P}) arm,
  bare = '' or bare in ({_TOPICS}) or (marks = '' and len(ws) > 0 and ws[1] in ({_LINKS}) and len(list_filter(ws, lambda w: w not in ({_LINKS}))) = 0) link from told),
un as (select sid, k, n, unit, spelt, topic, arm, ws[1] follows, negated,
  coalesce(sum((bare <> '')::int) over e, 0) piece, coalesce(sum((not joined)::int) over e, 0) word, coalesce(sum((not (joined or bare = '{READING.genitive}'))::int) over e, 0) inr,
  coalesce(sum((not link)::int) over e, 0) clause, coalesce(sum(ended::int) over e, 0) opn from holds window e as (partition by sid order by k rows between unbounded preceding and 1 preceding)),
cutd as (select *, coalesce(max(negated::int) over (partition by sid, opn order by k rows between current row and unbounded following), 0) = 1 cut from un),
spans as (select x.sid, x.k i, y.k j, string_agg(z.spelt, '' order by z.k) txt, min(x.clause) ci, max(y.clause) cj from cutd x join cutd y on x.sid = y.sid and x.piece = y.piece and y.k between x.k and x.k + 24
  join cutd z on z.sid = x.sid and z.k between x.k and y.k group by all),
st as (select c.qid, x.sid, x.k i0, y.k i1, x.n, x.clause c0, y.clause c1, x.inr <> y.inr crossed, coalesce(y.follows = q.particle, false) on_arm, y.cut, y.topic topic1,
  (x.k > 0 and p.word = x.word) or (y.k < x.n - 1 and f.word = y.word) glued, q.form, q.subject, q.head, q.y, q.echo, string_agg(z.unit, ' ' order by z.k) answer
  from cand c join q using (qid) join cutd x on x.sid = c.sid join cutd y on y.sid = x.sid and y.k between x.k and x.k + 3 join cutd z on z.sid = x.sid and z.k between x.k and y.k
  left join cutd p on p.sid = x.sid and p.k = x.k - 1 left join cutd f on f.sid = x.sid and f.k = y.k + 1 group by all),
beside as (select st.qid, st.sid, st.i0, st.i1, s.txt, s.i, s.j, t.topic topicj from st join spans s on s.sid = st.sid and s.ci >= st.c0 and s.cj <= st.c1 and (s.j < st.i0 or s.i > st.i1) join cutd t on t.sid = s.sid and t.k = s.j
  where s.txt = st.subject or s.txt = st.head or s.txt = st.y),
seen as (select st.*, bool_or(b.txt = st.subject) subj, bool_or(b.txt = st.head) hd, bool_or(b.txt = st.y) yy,
  bool_or(b.txt = st.y and ((b.topicj and st.i0 = b.j + 1) or (st.topic1 and b.i > st.i1 and not exists (select 1 from cutd a where a.sid = st.sid and a.k between st.i1 + 1 and b.j - 1 and not a.arm)))) cop
  from st left join beside b on b.qid = st.qid and b.sid = st.sid and b.i0 = st.i0 and b.i1 = st.i1 group by all),
echoed as (select distinct st.qid, st.sid, st.i0, st.i1 from st join spans s on s.sid = st.sid and s.i >= st.i0 and s.j <= st.i1 where list_contains(st.echo, s.txt)),
rules as (select s.*, list_filter([
  case when form = 'open' then 'question_form_open' end, case when subject is null and form <> 'open' then 'question_has_no_subject' end, case when subject is not null and not coalesce(subj, false) then 'no_subject' end,
  case when form = 'slot' and not on_arm then 'wrong_arm' end, case when (form = 'slot' and not coalesce(hd, false)) or (form = 'predicate' and not coalesce(yy, false)) then 'no_slot_head' end,
  case when form = 'predicate' and coalesce(yy, false) and not coalesce(cop, false) then 'not_copular' end, case when e.qid is not null then 'answer_holds_question_unit' end,
  case when glued then 'answer_glued' end, case when crossed then 'answer_crosses_break' end], lambda c: c is not null) codes0
  from seen s left join echoed e on e.qid = s.qid and e.sid = s.sid and e.i0 = s.i0 and e.i1 = s.i1),
judged as (select qid, sid, i0, i1, answer, case when len(codes0) = 0 and cut then ['answer_polarity_cut'] else codes0 end codes from rules),
passed as (select * from judged j where len(codes) = 0 and not exists (select 1 from judged o where len(o.codes) = 0 and o.qid = j.qid and o.sid = j.sid and o.i0 <= j.i0 and o.i1 >= j.i1 and (o.i0 < j.i0 or o.i1 > j.i1)))"""


@query(
    "j8_g4_gate",
    f"""with {WALK} select qid, count(distinct lower(answer)) forms, count(*) occurrences, min(sid) first_sid, case when count(distinct lower(answer)) = 1 then 'ANSWER' else 'CHOICE' end verdict from passed group by qid""",
)
def _(s, d):
    return gate.answer_verdicts(gate.maximal(judged(s, d).where(F.size("codes") == 0)))


@query("a18_code_histogram", f"with {WALK}, c as (select unnest(codes) code from judged union all select unnest(['multiple_answers']) from passed qualify row_number() over (partition by qid order by sid, i0, i1) > 1) select code, count(*) n from c group by code")
def _(s, d):
    """A18 over all stretches, and over the threads of those that pass. Questions that read alike have the
    same codes, so one of them is judged for all; only what can pass is judged by question."""
    q = components.written(read_questions(s, d), "questions")
    cands = components.written(candidates(s, d, q), "candidates")
    alike = q.groupBy(*(c for c in q.columns if c != "qid")).agg(F.min("qid").alias("qid"), F.count(F.lit(1)).alias("times"))
    one = cands.join(F.broadcast(alike.select("qid")) if q.count() <= gate.FEW_QUESTIONS else alike.select("qid"), "qid", "left_semi")
    late = gate.threads(gate.maximal(gate.judge(held(gate.promising(cands, q), q)).where(F.size("codes") == 0)))
    counts = gate.code_counts(held(one, alike), "times").union(scores.code_histogram(late.select("codes")))
    return counts.groupBy("code").agg(F.sum("n").alias("n"))


@query("g5_threads", f"with {WALK} select qid, sid, answer, case when row_number() over (partition by qid order by sid, i0, i1) > 1 then 'multiple_answers' else '' end code from passed")
def _(s, d):
    """The evidence of each question and what is refused beside it."""
    late = gate.threads(gate.maximal(judged(s, d).where(F.size("codes") == 0)))
    return late.select("qid", "sid", "answer", F.array_join("codes", ",").alias("code"))
