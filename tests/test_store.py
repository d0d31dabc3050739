"""Clauses, the store, snapshots and matching against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from factspan.operators import clauses, matching, store
from factspan.sources import code, snapshots


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("会議の場所は東京です。", [("F1", "場所", (("の", "会議"),), "東京", None, False)]),
        ("期限は金曜です", [("F2", "期限", (), "金曜", None, False)]),
        ("期限は金曜から月曜に変更しました。", [("F2", "期限", (), "月曜", "金曜", True)]),
        ("会議の場所を東京から大阪へ更新した", [("F1", "場所", (("の", "会議"),), "大阪", "東京", True)]),
        ("金曜から月曜に延期", [("F4", "延期", (), "月曜", "金曜", True)]),
        ("期限は金曜から月曜へ", [("F2", "期限", (), "月曜", "金曜", True)]),
        ("田中が資料を作成した", [("F3", "作成", (("が", "田中"), ("を", "資料")), None, None, False)]),
        ("東京で会議を開催する。", [("F4", "開催", (("を", "会議"), ("で", "東京")), None, None, False)]),
        ("担当は田中、期限は3,000日", [("F2", "担当", (), "田中", None, False), ("F2", "期限", (), "3,000日", None, False)]),
    ],
)
def test_shapes(sentence, want):
    assert [(c.shape, c.centre, c.path, c.value, c.old, c.change) for c in clauses.read(sentence)] == want


@pytest.mark.parametrize("sentence, reason", [("期限は金曜ではない", "negated"), ("期限は金曜ですか", "question"), ("AはBはC", "two_topics"), ("です", "no_unit"), ("東京", "no_relation"), ("AをBをC", "repeated_case_particle")])
def test_unread(sentence, reason):
    assert [(c.shape, c.reason) for c in clauses.read(sentence)] == [("F0", reason)]


def test_clause_tables(spark):
    d = spark.createDataFrame([(1, "会議の場所は東京。資料を作成した。"), (2, "期限は金曜ですか？"), (3, None)], "sid long, sent string")
    got = clauses.exchange(d)
    assert sorted((r.sid, r.accepted, r.reason) for r in clauses.accepted(got).collect()) == [(1, True, ""), (2, False, "question")]
    done = clauses.complete(got, spark.createDataFrame([(1, "田中")], "sid long, topic string")).where("sid = 1 and k = 1").first()
    assert done.shape == "F3" and done.path[0].phrase == "田中"
    assert [tuple(r) for r in clauses.relations(got).collect()] == [("possessive", "会議", "場所", 1)]
    q = spark.createDataFrame([("会議の場所はどこですか",), ("誰がいつ",), ("x",)], "q string").select(clauses.question_word(F.col("q")).alias("c"))
    assert [r.c for r in q.collect()] == ["place", "person", None]
    kind, frame = clauses.read_question("会議の場所はどこですか？")
    assert kind == "place" and (frame.shape, frame.centre) == ("F1", "場所")


def test_only_committed_accepted_writes_are_memory(spark):
    rows = [("a", 0, "write", True, '{"text":"x","turn":"1"}'), ("a", 1, "write", False, '{"text":"y"}'), ("a", 2, "keep_unshaped", True, '{"text":"z"}'), ("a", 3, "commit", True, "{}"), ("b", 0, "write", True, '{"text":"lost"}'), ("b", 1, "write", True, "{}")]
    d = spark.createDataFrame(rows, "session string, i long, op string, ok boolean, args string")
    assert sorted((r.i, r.sent, r.unshaped) for r in store.memory_rows(d).collect()) == [(0, "x", False), (2, "z", True)]
    assert [(r.session, r.reason) for r in store.rejects(d).collect()] == [("b", "missing:text")]
    assert store.replayed(d, d.limit(5)).count() == 1


@pytest.mark.parametrize("text, value, want", [("期限は金曜です。", "金曜", "clean"), ("前金曜です", "金曜", "boundary"), ("期限は金曜、時刻は五時", "金曜", "multi_clause_write"), ("期限は金曜！", "金曜", "not_asserted"), ("期限は金曜かもしれない", "金曜", "not_asserted")])
def test_value_status(spark, text, value, want):
    a = text.index(value)
    d = spark.createDataFrame([(text, a, a + len(value), value)], "t string, a int, b int, v string")
    r = d.select(store.clean_value(F.col("t"), F.col("a"), F.col("b")).alias("s"), store.verbatim(F.col("t"), F.col("a"), F.col("b"), F.col("v")).alias("q")).first()
    assert r.s == want and r.q


def test_snapshots_are_named_by_content(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "i long, t string")
    name = snapshots.write_snapshot(d, str(tmp_path))
    assert name == snapshots.write_snapshot(d.orderBy(F.desc("i")), str(tmp_path)) and snapshots.read_snapshot(spark, name).count() == 2
    d.limit(1).write.mode("overwrite").parquet(name)
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, name)


def test_code_tokens(spark):
    d = spark.createDataFrame([("a.py", "def f(x):\n    return x + 1\n"), ("bad.py", "def (")], "path string, text string")
    got = code.code_units(d).collect()
    assert {r.path for r in got} == {"a.py"} and [r.unit for r in got if r.defines] == ["f"]


def test_matching_edges(spark):
    t = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("no",), (None,)], "t string")
    assert [r.c for r in t.select(matching.canonical_json(F.col("t")).alias("c")).collect()] == ['{"a":"é","b":1}', None, None]
    p = spark.createDataFrame([("hi <system-reminder>x</system-reminder> there <system-reminder>open",)], "p string")
    assert p.select(matching.owner_text(F.col("p")).alias("o")).first().o == "hi  there"
    f = matching.question_forms(spark.createDataFrame([(1, "場所は", ["会議"])], "qid int, question string, topics array<string>"))
    assert [(r.stage, r.form) for r in f.collect()] == [(1, "場所は"), (2, "会議の場所は")]


def test_weave_plans():
    assert clauses.weave_plan("会議の場所は東京") == [("attach", "の"), ("topic", "は")]
    assert clauses.weave_plan("会議を東京で開催") == "nested_particle_chain"
    assert clauses.weave_plan("東京から大阪") == "gap_is_not_a_particle" and clauses.weave_plan("です") == "no_unit"
