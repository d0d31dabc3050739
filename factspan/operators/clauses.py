"""Sentences to typed clauses (survey T6-T8, T10-T12, T14, T15, M1, M3, P10).

A piece is coded as a string, one letter per token: N for a run of content characters, a letter
per particle, x for any other kana between runs; what follows the last run is its tail. Shapes
are then patterns over that string. There is no dictionary here: content runs are kanji,
katakana, Latin letters and digits, function runs are hiragana, so parity is claimed for the
shapes, not for inflected verbs written in kana.

Shapes: F1 attribute of an owner, F2 plain attribute, F3 event with a subject, F4 event or change
without one, F0 unread with its reason."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.functions.text import ATTRIBUTION

# Particles and their letters, change predicates, negations, cuts, question words.
LETTERS = {"の": "n", "は": "w", "から": "f", "が": "g", "を": "o", "に": "i", "で": "d", "と": "t", "へ": "e"}
CHANGES = ("変更", "更新", "延期")
NEGATIONS = ("ない", "なかった", "ません", "ず")
VERBAL = ("する", "した", "して", "しました", "します", "され", "になった", "となった", "になる")
HARD_CUTS, SOFT_CUTS, LABEL_CUTS = "。！？!?\n", "、，,;；", ":："
QUESTION_WORDS = {"誰": "person", "どこ": "place", "いつ": "time", "何": "thing", "なに": "thing", "いくら": "money", "いくつ": "count", "どれ": "choice"}
READ_ORDER = "gwodite"

_RUN = re.compile(r"(?P<kana>[ぁ-ゖ]+)|(?P<word>[^\Wぁ-ゖ]+(?:[,:，：.](?<=\d.)(?=\d)[^\Wぁ-ゖ]+)*)")
_CHAIN = r"N(?:nN)*"
_SHAPES = (
    ("change", re.compile(rf"(?:(?P<slot>{_CHAIN})[wo])?(?P<old>{_CHAIN})f(?P<new>{_CHAIN})[ie](?P<pred>N)$")),
    ("change", re.compile(rf"(?:(?P<slot>{_CHAIN})[wo])?(?P<new>{_CHAIN})i(?P<pred>N)$")),
    ("change", re.compile(rf"(?P<slot>{_CHAIN})[wo](?P<old>{_CHAIN})f(?P<new>{_CHAIN})$")),
    ("event", re.compile(rf"(?:(?P<topic>{_CHAIN})w)?(?P<args>(?:{_CHAIN}[goidte])*)(?P<pred>N)$")),
    ("value", re.compile(rf"(?P<slot>{_CHAIN})w(?P<new>{_CHAIN})$")),
)


@dataclass(frozen=True)
class Clause:
    shape: str
    start: int
    end: int
    centre: str | None = None
    path: tuple[tuple[str, str], ...] = ()
    value: str | None = None
    old: str | None = None
    change: bool = False
    reason: str | None = None


def pieces(text: str) -> list[tuple[int, int, str]]:
    """(start, end, cut) between cuts; a soft or label cut between two digits is none."""
    out, begin = [], 0
    for i, c in enumerate(text):
        if c in HARD_CUTS or c in SOFT_CUTS + LABEL_CUTS and not (text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit()):
            out.append((begin, i, c))
            begin = i + 1
    return [*out, (begin, len(text), "")]


def _coded(text: str, lo: int, hi: int) -> tuple[str, list[tuple[int, int]], str]:
    """Code string, spans of the N's, tail."""
    code, words, tail = "", [], ""
    for m in _RUN.finditer(text, lo, hi):
        if m.lastgroup == "word":
            code += tail and (LETTERS.get(tail) or "x")
            tail = ""
            if code[-1:] == "N" and words[-1][1] == m.start():
                words[-1] = (words[-1][0], m.end())
            else:
                code += "N"
                words.append(m.span())
        elif words:
            tail += m.group()
    return code, words, tail


def read_piece(text: str, lo: int, hi: int, cut: str) -> Clause:
    code, words, tail = _coded(text, lo, hi)
    if not words:
        return Clause("F0", lo, hi, reason="no_unit")
    start, end = words[0][0], words[-1][1] + len(tail)
    no = lambda reason: Clause("F0", start, end, reason=reason)
    if "x" in code or "NN" in code:
        return no("gap_is_not_a_particle")
    if any(n in tail for n in NEGATIONS):
        return no("negated")
    if cut in ("?", "？") and cut or tail.endswith("か"):
        return no("question")
    if code.count("w") > 1:
        return no("two_topics")
    if any(code.count(c) > 1 for c in "goie"):
        return no("repeated_case_particle")
    if re.search("tN[gwo]", code):
        return no("coordination")
    at = [i for i, c in enumerate(code) if c == "N"]  # place in the code of each word

    def chain(m: re.Match, name: str) -> list[str]:
        a, b = m.span(name)
        return [text[slice(*words[k])] for k, i in enumerate(at) if a <= i < b] if a >= 0 else []

    def stretch(m: re.Match, name: str) -> str:
        a, b = m.span(name)
        inside = [words[k] for k, i in enumerate(at) if a <= i < b]
        return text[inside[0][0] : inside[-1][1]]

    owners = lambda names: tuple(("の", x) for x in reversed(names[:-1]))
    last = text[slice(*words[-1])]
    verbal = tail.startswith(VERBAL) or bool(re.search("[goidte]", code))
    for kind, pattern in _SHAPES:
        m = pattern.match(code)
        if not m:
            continue
        if kind == "change":
            named = "pred" in pattern.groupindex
            if named and last not in CHANGES or not named and not tail.startswith("へ"):
                continue
            slot, old = chain(m, "slot"), stretch(m, "old") if "old" in pattern.groupindex and m.group("old") else None
            if not slot:
                return Clause("F4", start, end, last, (), stretch(m, "new"), old, True)
            return Clause("F1" if len(slot) > 1 else "F2", start, end, slot[-1], owners(slot), stretch(m, "new"), old, True)
        if kind == "event":
            if not verbal:
                continue
            arms, mark = [], m.start("args")
            for a in re.finditer(rf"({_CHAIN})([goidte])", m.group("args")):
                names = [text[slice(*words[k])] for k, i in enumerate(at) if mark + a.start(1) <= i < mark + a.end(1)]
                particle = next(p for p, c in LETTERS.items() if c == a.group(2))
                arms.append((particle, names[-1]))
            topic = chain(m, "topic")
            arms += [("が", topic[-1])] if topic else []
            arms.sort(key=lambda x: READ_ORDER.index(LETTERS[x[0]]))
            return Clause("F3" if any(p == "が" for p, _ in arms) else "F4", start, end, last, tuple(arms))
        slot = chain(m, "slot")
        return Clause("F1" if len(slot) > 1 else "F2", start, end, slot[-1], owners(slot), stretch(m, "new"))
    return no("no_relation")


def read(sentence: str | None) -> list[Clause]:
    """The clauses of a sentence, attribution stripped; a label piece is skipped."""
    text = re.sub(ATTRIBUTION, "", unicodedata.normalize("NFC", sentence or "")).strip()
    return [read_piece(text, a, b, cut) for a, b, cut in pieces(text) if text[a:b].strip() and cut not in tuple(LABEL_CUTS)]


SCHEMA = T.StructType([
    T.StructField("sid", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("shape", T.StringType()), T.StructField("centre", T.StringType()),
    T.StructField("path", T.ArrayType(T.StructType([T.StructField("particle", T.StringType()), T.StructField("phrase", T.StringType())]))),
    T.StructField("value", T.StringType()), T.StructField("old", T.StringType()), T.StructField("change", T.BooleanType()), T.StructField("reason", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
])


def exchange(sentences: DataFrame) -> DataFrame:
    """T7 over (sid, sent): one row per clause."""
    import pyarrow as pa

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(SCHEMA)
        for b in batches:
            out = []
            for sid, sent in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += ((sid, k, c.shape, c.centre, [{"particle": p, "phrase": x} for p, x in c.path], c.value, c.old, c.change, c.reason, c.start, c.end) for k, c in enumerate(read(sent)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return sentences.select(F.col("sid").cast("long"), F.col("sent").cast("string")).mapInArrow(run, SCHEMA)


def accepted(clauses: DataFrame) -> DataFrame:
    """M1: a write is accepted if every clause is read; else its first reason is reported."""
    d = clauses.groupBy("sid").agg(F.bool_and(F.col("shape") != "F0").alias("accepted"), F.coalesce(F.min_by("reason", F.when(F.col("shape") == "F0", F.col("k"))), F.lit("")).alias("reason"))
    return d


def complete(clauses: DataFrame, topics: DataFrame) -> DataFrame:
    """M3: a subject-less F4 takes the topic open at its sentence as its subject."""
    d = clauses.join(topics.select("sid", "topic"), "sid", "left")
    takes = (F.col("shape") == "F4") & F.col("topic").isNotNull()
    arm = F.array(F.struct(F.lit("が").alias("particle"), F.col("topic").alias("phrase")))
    return d.withColumn("path", F.when(takes, F.concat(arm, "path")).otherwise(F.col("path"))).withColumn("shape", F.when(takes, "F3").otherwise(F.col("shape")))


def relations(clauses: DataFrame) -> DataFrame:
    """(kind, first, second, sid): possession chains and subject-object pairs of events."""
    owns = clauses.where("shape = 'F1'").select(F.lit("possessive").alias("kind"), F.col("path")[0]["phrase"].alias("first"), F.col("centre").alias("second"), "sid")
    arm = lambda p: F.get(F.filter("path", lambda x: x["particle"] == p), F.lit(0))["phrase"]
    acts = clauses.where("shape = 'F3'").select(F.concat(F.lit("event:"), "centre").alias("kind"), arm("が").alias("first"), arm("を").alias("second"), "sid").where("first is not null and second is not null")
    return owns.union(acts)


def question_word(c) -> object:
    """Class of the leftmost, then longest, question word."""
    best = F.lit(None).cast("struct<at: int, short: int, class: string>")
    for word, kind in QUESTION_WORDS.items():
        at = F.locate(word, c)
        best = F.least(best, F.when(at > 0, F.struct(at.alias("at"), F.lit(-len(word)).alias("short"), F.lit(kind).alias("class"))))
    return best["class"]


def read_question(sentence: str) -> tuple[str | None, Clause | None]:
    """The question word's class, and the clause with a placeholder in its place."""
    hits = sorted((sentence.find(w), -len(w), w) for w in QUESTION_WORDS if w in sentence)
    if not hits:
        return None, None
    word = hits[0][2]
    frame = re.sub("(です|でした)?か?[？?。]*$", "", sentence.replace(word, "ＸＸ", 1))
    got = read(frame)
    return QUESTION_WORDS[word], got[0] if len(got) == 1 else None


def weave_plan(stretch: str) -> list[tuple[str, str]] | str:
    """V1: the steps that seat a stretch: touch, attach by an arm particle, or mark the topic; or
    why it is refused."""
    code, words, _ = _coded(stretch, 0, len(stretch))
    if not words:
        return "no_unit"
    if "x" in code or "f" in code:
        return "gap_is_not_a_particle"
    gaps = ["" if code[i + 1] == "N" else code[i + 1] for i, c in enumerate(code[:-1]) if c == "N"]
    arms = [g not in ("", "w", "n") for g in gaps]
    if any(x and y for x, y in zip(arms, arms[1:])):
        return "nested_particle_chain"
    names = {c: p for p, c in LETTERS.items()}
    return [("touch", "") if not g else ("topic", names[g]) if g == "w" else ("attach", names[g]) for g in gaps]
