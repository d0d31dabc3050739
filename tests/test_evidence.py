"""Reading questions, and the gate's queries give rows of known kinds."""

import pytest

from factspan.operators import gate, questions
from factspan.operators.gate import Reading
from factspan.plans.catalogue import ORACLES, QUERIES
from tests.oracles import agree, connect

DIR = "/root/testdata/sf0.01"
JA = questions.Grammar(
    Reading(particles=("は", "が", "の", "を", "に", "で", "と"), topic="は", genitive="の", also=("です", "か", "した"), negations=("ない",)),
    ("誰", "何", "どこ"), "が", ("を", "に", "で", "と", "の"), spaced=False,
)
EN = questions.Grammar(Reading(particles=("of", "in", "to", "by"), topic="is", genitive="of", also=("the",), negations=("not",)), ("who", "what", "where"), "by", ("in", "to", "of"))


def read(text, grammar, *names):
    got = questions.read(text, grammar)
    return tuple(got[n] for n in names)


def test_questions_of_both_kinds_of_writing():
    names = ("form", "subject", "level", "particle", "head", "y", "chain")
    assert read("認証モジュールの担当は誰ですか", JA, *names) == ("predicate", ["認証モジュール"], "chain", None, None, "担当", ["認証モジュール"])
    assert read("東京本社の認証モジュールの担当は誰ですか", JA, *names) == ("predicate", ["東京本社"], "chain", None, None, "担当", ["東京本社", "認証モジュール"])
    assert read("誰が認証モジュールを担当した", JA, *names) == ("slot", ["認証モジュール"], "case", "が", "認証モジュール", None, [])
    assert read("会議は誰が司会", JA, *names) == ("slot", ["会議"], "topic", "が", "司会", None, [])
    assert read("会議は何の資料を配布", JA, *names, "noun") == ("slot", ["会議"], "topic", "を", "配布", None, [], "資料")
    assert read("認証モジュールを担当", JA, *names) == ("open", ["認証モジュール"], "case", None, None, None, [])
    assert read("Gate of Tower is what?", EN, *names) == ("predicate", ["Gate"], "chain", None, None, "Tower", ["Gate"])
    assert read("In Rome, Anna to what in Paris", EN, "form", "subject", "particle", "head") == ("slot", ["Anna"], "in", "Paris")
    assert read("", EN, *names) == ("open", [], None, None, None, None, [])
    assert read("who", EN, *names) == ("open", [], None, None, None, None, [])


def test_forms_and_echo():
    got = questions.read("red tower of old gate is what", EN)
    assert got["y"] == "oldgate" and got["y_forms"] == ["oldgate", "gate"] and got["subject"] == ["redtower"] and got["seek"] == "red"
    assert got["echo"] == ["red", "tower", "old", "gate", "redtower", "oldgate"]


def test_closed_words_are_leftmost_and_longest():
    grammar = questions.Grammar(Reading(particles=("か", "から", "は"), topic="は", genitive="の"), ("誰",), "が", ("から",), spaced=False)
    assert [(r.text, r.after) for r in questions.runs("東京から誰は", grammar)] == [("東京", ["から"]), ("誰", ["は"])]


def test_null_and_repeated_questions(spark):
    d = spark.createDataFrame([(1, None), (2, "Gate of Tower is what?"), (2, "Gate of Tower is what?")], "qid long, text string")
    rows = questions.read_questions(d, EN).orderBy("qid").collect()
    assert [(r.qid, r.form, r.y) for r in rows] == [(1, "open", None), (2, "predicate", "Tower"), (2, "predicate", "Tower")]


@pytest.mark.parametrize("name", ["t9_questions", "j8_g4_gate", "a18_code_histogram", "g5_threads"])
def test_gate_queries_match_the_walk(spark, name):
    agree(spark, connect(DIR), DIR, QUERIES[name], ORACLES[name])


def test_the_gate_admits_and_refuses(spark):
    codes = {r.code: r.n for r in QUERIES["a18_code_histogram"](spark, DIR).collect()}
    assert {"wrong_arm", "no_slot_head", "no_subject", "answer_holds_question_unit"} <= set(codes) <= set(gate.CODES)
    rows = QUERIES["j8_g4_gate"](spark, DIR).collect()
    assert rows and {r.verdict for r in rows} <= {"ANSWER", "CHOICE"} and all((r.forms == 1) == (r.verdict == "ANSWER") for r in rows)


def test_threads_refuse_all_but_the_first(spark):
    d = spark.createDataFrame([(1, 5, 0, 0, "a"), (1, 4, 2, 3, "b"), (1, 4, 1, 1, "c"), (2, 9, 0, 0, "d")], "qid long, sid long, i0 int, i1 int, answer string")
    got = {r.answer: list(r.codes) for r in gate.threads(d).collect()}
    assert got == {"a": ["multiple_answers"], "b": ["multiple_answers"], "c": [], "d": []}
