"""The evidence gate: which stretches of which sentences may answer a question (survey P6, P7, J8, G1, G4, G5, A14, A15, W13;
of G1 not the alignment code, for stretches are made of whole units, and of G5 the verdict without threads).

Questions are rows of what was read off them (QUESTION): the gate does not read questions itself. A
sentence is its content units and the gaps between them; function words stand in the gaps. Sentences
come in by an equi-join on the subject, never by a product, and what a question looks for is found
once per sentence, before its stretches are made."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.functions.text import LETTER
from factspan.operators.units import units

# Refusal codes in the order they are listed, characters that do not count, marks that
# join the pieces of one token, marks that end a clause.
CODES = (
    "not_quoted", "constructed_unit", "answer_not_word_aligned", "question_form_open", "question_has_no_subject", "no_subject",
    "wrong_arm", "no_slot_head", "not_copular", "answer_holds_question_unit",
    "answer_glued", "answer_crosses_break", "multiple_answers",
    "subject_unreadable",
    "answer_polarity_cut",
)
IGNORE = "「」『』“”\"'・· 　\t"
JOINERS = "-‐‑–—−,.:/+"
CLAUSE_END = "、，。．！？；,!?;"
BREAK = r"[,;:.!?、。！？；：]"
NEGATIONS = ("not", "no", "never", "nicht", "kein", "ne", "pas", "nunca")
#: Rows up to which questions are broadcast.
FEW_QUESTIONS = 100_000
QUESTION = "qid, form (slot, predicate or open), subject, chain, unread, y_forms and echo (arrays), kind_only, particle, head"


@dataclass(frozen=True)
class Reading:
    """The closed word lists a language is read with. The first particle is the topic's."""

    particles: tuple[str, ...]
    topic: str
    genitive: str
    also: tuple[str, ...] = ()
    negations: tuple[str, ...] = NEGATIONS

    @property
    def functions(self) -> tuple[str, ...]:
        return (*self.particles, self.topic, *self.also, *self.negations)


def _list(words: tuple[str, ...]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")" if words else "cast(array() as array<string>)"


def _any_of(chars: str) -> Column:
    return F.lit("[" + re.escape(chars) + "]")


def candidates(occ: DataFrame, questions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The sentences that hold a question's first subject (its first word), one row per question and
    sentence; `keep` are columns of the sentence that its occurrences carry along."""
    first = F.col("seek") if "seek" in questions.columns else F.get("subject", F.lit(0)) if dict(questions.dtypes)["subject"].startswith("array") else F.col("subject")
    asked = questions.select("qid", first.alias("unit"))
    asked = F.broadcast(asked) if keep and questions.count() <= FEW_QUESTIONS else asked
    return occ.join(asked, "unit").groupBy("qid", "sid").agg(F.min("pos").alias("subject_pos"), *(F.first(c).alias(c) for c in keep))


def promising(cands: DataFrame, questions: DataFrame) -> DataFrame:
    """The candidates (with their sent) in which a stretch can pass at all: the text holds the slot's head and particle,
    or the word of the predicate. What units spell together stands so in the text without the
    characters that do not count, so no passing stretch is lost; the codes of the others are not made."""
    few = questions.count() <= FEW_QUESTIONS
    q = questions.select("qid", "form", "particle", "head", "y_forms")
    text = F.regexp_replace("sent", _any_of(IGNORE), F.lit(""))
    d = cands.withColumn("_text", text).join(F.broadcast(q) if few else q, "qid")
    slot = (F.col("form") == "slot") & F.contains("_text", F.col("head")) & F.contains(F.lower("_text"), F.lower("particle"))
    predicate = (F.col("form") == "predicate") & F.exists("y_forms", lambda y: F.contains(F.col("_text"), y))
    return d.where(slot | predicate).select(*cands.columns)


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """The columns worked out once a row. A filter above a projection, or a loop that names a column
    once, would have its expression put in their place, and work it out for every element."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(F.array(F.struct(*columns))).alias("_x")).select(*others, "_x.*")


def sentence_arrays(sentences: DataFrame, reading: Reading) -> DataFrame:
    """(sid, sent, and title_words if there) as arrays over the content units: units, what is left of each
    gap after it without the ignorable characters, and running numbers that are equal for units with
    no break of a kind between them: piece (touching), word (joined), inner (may lie in an answer),
    clause. follows is the first word after a unit; cut tells whether a negation follows in its clause."""
    titles = [F.col("title_words")] if "title_words" in sentences.columns else [F.array().cast("array<string>").alias("title_words")]
    d = sentences.select("sid", *titles, units(F.col("sent")).alias("tokens"), F.split("sent", f"{LETTER}+", -1).alias("between"))
    d = _once(d, "tokens", "between").where(F.size("tokens") > 0)
    d = d.withColumn("at", F.expr(f"filter(sequence(0, size(tokens) - 1), i -> not array_contains({_list(reading.functions)}, lower(tokens[i])))")).where(F.size("at") > 0)
    d = d.withColumn("gap", F.expr("""transform(at, (i, k) -> array_join(flatten(transform(sequence(i + 1, coalesce(get(at, k + 1), size(tokens))),
        j -> if(j < coalesce(get(at, k + 1), size(tokens)), array(between[j], tokens[j]), array(between[j])))), ''))"""))
    d = d.select("sid", "title_words", F.expr("transform(at, i -> tokens[i])").alias("units"), "gap")
    d = _once(d, "units", "gap")
    letters = F.lit(f"{LETTER}+")
    d = d.withColumns({
        "bare": F.transform("gap", lambda g: F.lower(F.regexp_replace(g, _any_of(IGNORE), F.lit("")))),
        "words": F.transform("gap", lambda g: F.transform(F.regexp_extract_all(g, letters, F.lit(0)), F.lower)),
        "marks": F.transform("gap", lambda g: F.regexp_replace(F.regexp_replace(g, letters, F.lit("")), _any_of(IGNORE), F.lit(""))),
        "ended": F.transform("gap", lambda g: g.rlike("[" + re.escape(CLAUSE_END) + "]")),
        "negated": F.transform("gap", lambda g: F.arrays_overlap(F.transform(F.regexp_extract_all(F.regexp_extract(g, "^[^" + re.escape(CLAUSE_END) + "]*", 0), letters, F.lit(0)), F.lower), F.expr(_list(reading.negations)))),
    })
    d = _once(d, "bare", "words", "marks", "ended", "negated")
    topics = _list((reading.topic, reading.topic + ",", reading.topic + "、"))
    joined = F.transform("bare", lambda b: b.rlike("^[" + re.escape(JOINERS) + "]*$"))
    link = F.expr(f"""transform(bare, (b, k) -> b = '' or array_contains({topics}, b) or (marks[k] = '' and size(words[k]) > 0
        and array_contains({_list((*reading.particles, reading.topic))}, words[k][0]) and forall(words[k], w -> array_contains({_list((*reading.particles, reading.topic, *reading.also))}, w))))""")
    d = d.withColumns({"joined": joined, "link": link, "touch": F.transform("bare", lambda b: b == ""), "open": F.transform("ended", lambda e: ~e)})
    d = d.withColumn("within", F.expr(f"transform(joined, (x, k) -> x or bare[k] = '{reading.genitive}')"))
    # a letter per unit and a bar where a run ends: all numbers of a sentence in one walk
    runs = lambda letter, holds: f"split(array_join(transform({holds}, (y, k) -> {letter} || if(y or k = size(units) - 1, '', '|')), ''), '[|]')"
    number = lambda holds: F.expr(f"""flatten(transform({runs("'u'", holds)}, (r, n) -> array_repeat(n, length(r))))""")
    letter = "if(negated[k], 'n', 'u')"
    cut = f"flatten(transform({runs(letter, 'open')}, r -> concat(array_repeat(true, length(rtrim('u', r))), array_repeat(false, length(r) - length(rtrim('u', r))))))"
    return d.select(
        "sid", "title_words", "units", F.transform("units", lambda x: F.regexp_replace(x, _any_of(IGNORE), F.lit(""))).alias("spelt"), "bare",
        number("touch").alias("piece"), number("joined").alias("word"), number("within").alias("inner"), number("link").alias("clause"),
        F.transform("words", lambda w: F.get(w, F.lit(0))).alias("follows"),
        F.expr(cut).alias("cut"),
        F.transform("bare", lambda b: F.array_contains(F.expr(topics), b)).alias("topic"),
        F.transform("bare", lambda b: (b == "") | F.array_contains(F.expr(_list(reading.particles)), b)).alias("arm"),
    )


def _reads(target: str) -> str:
    """Where touching units spell the target: an array of (i, j). Only units that the target begins with are tried."""
    return f"""if(coalesce({target}, '') = '', cast(array() as array<struct<i: int, j: int>>), filter(flatten(transform(filter(sequence(0, size(units) - 1), i -> startswith({target}, spelt[i])),
        i -> transform(sequence(i, least(size(units) - 1, i + length({target}) - 1)), j -> struct(i, j)))),
        x -> piece[x.i] = piece[x.j] and array_join(slice(spelt, x.i + 1, x.j - x.i + 1), '') = {target}))"""


def stretches(cands: DataFrame, arrays: DataFrame, questions: DataFrame, longest: int = 4) -> DataFrame:
    """The candidate sentences, whose stretches of up to `longest` units will be judged, each with
    where it holds what the question looks for."""
    few = questions.count() <= FEW_QUESTIONS
    d = cands.select("qid", "sid").join(arrays, "sid").join(F.broadcast(questions) if few else questions, "qid")
    d = d.withColumns({
        "subject_at": F.expr(f"transform(subject, s -> {_reads('s')})"),
        "titled": F.expr("transform(subject, s -> array_contains(title_words, s))"),
        "chain_at": F.expr(f"transform(slice(chain, 2, greatest(size(chain) - 1, 0)), s -> {_reads('s')})"),
        "head_at": F.expr(_reads("head")),
        "y_at": F.expr(f"flatten(transform(y_forms, s -> {_reads('s')}))"),
        "echo_at": F.expr(f"flatten(transform(echo, s -> {_reads('s')}))"),
    }).drop("subject", "chain", "y_forms", "echo", "title_words", "spelt")
    d = _once(d, "subject_at", "titled", "chain_at", "head_at", "y_at", "echo_at")
    return d.withColumn("subjects", F.size("subject_at")).withColumn("longest", F.lit(longest))


# in the clause around the stretch, and not within it
_BESIDE = "x -> clause[x.i] >= clause[s.i0] and clause[x.j] <= clause[s.i1] and (x.j < s.i0 or x.i > s.i1)"
_Y = f"filter(y_at, {_BESIDE})"
#: The rules of G1 over a stretch s, and those of G4, which only refuse what passes all of the first.
_FIRST = {
    "question_form_open": "form = 'open'",
    "question_has_no_subject": "(subjects = 0 and form in ('slot', 'predicate')) or kind_only",
    "no_subject": f"exists(transform(subject_at, (p, k) -> not exists(p, {_BESIDE}) and not titled[k]), m -> m)",
    "wrong_arm": "form = 'slot' and not coalesce(follows[s.i1] = particle, false)",
    "no_slot_head": f"(form = 'slot' and not exists(head_at, {_BESIDE})) or (form = 'predicate' and size({_Y}) = 0)",
    "not_copular": f"form = 'predicate' and size({_Y}) > 0 and not exists({_Y}, x -> (topic[x.j] and s.i0 = x.j + 1) or (topic[s.i1] and x.i > s.i1 and forall(slice(arm, s.i1 + 2, greatest(x.j - s.i1 - 1, 0)), a -> a)))",
    "answer_holds_question_unit": "exists(echo_at, x -> x.i >= s.i0 and x.j <= s.i1)",
    "answer_glued": "(s.i0 > 0 and word[s.i0] = word[greatest(s.i0 - 1, 0)]) or (s.i1 < size(units) - 1 and word[s.i1] = word[least(s.i1 + 1, size(units) - 1)])",
    "answer_crosses_break": "inner[s.i0] <> inner[s.i1]",
    "subject_unreadable": "size(unread) > 0",
}
_LAST = {"no_subject": f"exists(chain_at, p -> not exists(p, {_BESIDE}))", "answer_polarity_cut": "cut[s.i1]"}
#: Where a rule of _FIRST holds for every stretch of a sentence, and where it can hold for any, read off the sentence alone.
_ALL = {
    "question_form_open": "form = 'open'", "question_has_no_subject": _FIRST["question_has_no_subject"], "subject_unreadable": "size(unread) > 0",
    "no_slot_head": "(form = 'slot' and size(head_at) = 0) or (form = 'predicate' and size(y_at) = 0)",
}
_ANY = {
    "question_form_open": "false", "question_has_no_subject": "false", "subject_unreadable": "false", "no_subject": "size(subject_at) > 0", "wrong_arm": "form = 'slot'",
    "no_slot_head": "form in ('slot', 'predicate')", "not_copular": "form = 'predicate' and size(y_at) > 0", "answer_holds_question_unit": "size(echo_at) > 0",
}
_EVERY = "flatten(transform(sequence(0, size(units) - 1), a -> transform(sequence(a, least(a + longest, size(units)) - 1), b -> struct(a as i0, b as i1))))"


def judge(held: DataFrame) -> DataFrame:
    """G1, then G4: all failing codes of every stretch (units i0 to i1, both included) in listed order; none
    means it passes. The rules of G4 only refuse: a negation cut off and a missing noun of the subject
    chain are looked for where everything else passes. Stretches are judged within the row of their
    sentence, so a long sentence is not copied for each of them."""
    listed = lambda rules: "array_compact(array(" + ", ".join(f"if({rules[c]}, '{c}', null)" for c in CODES if c in rules) + "))"
    found = held.withColumn("found", F.expr(f"transform({_EVERY}, s -> struct(s.i0 as i0, s.i1 as i1, array_join(slice(units, s.i0 + 1, s.i1 - s.i0 + 1), ' ') as answer, {listed(_FIRST)} as codes))"))
    done = F.expr(f"transform(found, s -> struct(s.i0 as i0, s.i1 as i1, s.answer as answer, if(size(s.codes) > 0, s.codes, {listed(_LAST)}) as codes))")
    return found.select("qid", "sid", F.explode(done).alias("s")).select("qid", "sid", "s.i0", "s.i1", "s.answer", "s.codes")


def code_counts(held: DataFrame, times: str | None = None) -> DataFrame:
    """A18 over what `judge` gives: (code, n), the number of stretches with each code, by the same rules.
    Stretches are counted within the row of their sentence and are no rows of their own; rules that
    the sentence alone decides are not asked for each. A row of `held` counts `times` times."""
    of = F.lit(1) if times is None else F.col(times)
    d = _once(held.withColumn("every", F.expr(_EVERY)), "every")
    counts = {c: f"if({_ALL.get(c, 'false')}, size(every), if({_ANY.get(c, 'true')}, size(filter(every, s -> {rule})), 0))" for c, rule in _FIRST.items()}
    fits = " and ".join(f"not coalesce({rule}, false)" for rule in _FIRST.values())
    none = " or ".join(f"({rule})" for rule in _ALL.values())
    d = d.withColumn("clean", F.expr(f"if({none}, cast(array() as array<struct<i0: int, i1: int>>), filter(every, s -> {fits}))"))
    sums = {c: F.expr(n) for c, n in counts.items()}
    for c, rule in _LAST.items():
        refused = F.expr(f"size(filter(clean, s -> {rule}))")
        sums[c] = sums[c] + refused if c in sums else refused
    total = d.agg(*(F.coalesce(F.sum(n * of), F.lit(0)).alias(c) for c, n in sums.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in sums)))
    return total.select(rows.alias("x")).select("x.code", "x.n").where("n > 0")


def maximal(passed: DataFrame) -> DataFrame:
    """A14 within a sentence: stretches not contained in another that passes."""
    w = W.partitionBy("qid", "sid").orderBy(F.asc("i0"), F.desc("i1")).rowsBetween(W.unboundedPreceding, -1)
    return passed.withColumn("_reach", F.max("i1").over(w)).where(F.col("_reach").isNull() | (F.col("i1") > F.col("_reach"))).drop("_reach")


def answer_verdicts(passed: DataFrame) -> DataFrame:
    """One answer form is an ANSWER, several are a CHOICE."""
    d = passed.groupBy("qid").agg(F.count_distinct(F.lower("answer")).alias("forms"), F.count(F.lit(1)).alias("occurrences"), F.min("sid").alias("first_sid"))
    return d.withColumn("verdict", F.when(F.col("forms") == 1, "ANSWER").otherwise("CHOICE"))


def threads(passed: DataFrame) -> DataFrame:
    """Of the stretches that pass for a question the first one is its evidence; several are not
    joined into one answer, so every later one is refused as multiple_answers."""
    first = passed.groupBy("qid").agg(F.min(F.struct("sid", "i0", "i1")).alias("first"))
    later = F.struct("sid", "i0", "i1") != F.col("first")
    codes = F.when(later, F.array(F.lit("multiple_answers"))).otherwise(F.array().cast("array<string>"))
    return passed.drop("codes").join(first, "qid").withColumn("codes", codes).drop("first")


def negated_after(text: Column, end: Column) -> Column:
    """Does a negation follow before the clause ends?"""
    rest = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[^,;:.!?、。！？；：]*", 0)
    return F.lower(rest).rlike(r"\b(" + "|".join(NEGATIONS) + r")\b")
