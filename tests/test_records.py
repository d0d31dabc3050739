"""Replay, recorder and late rule: planted differences, two writers, streams against batches."""

import json
import random
import zlib

import duckdb
import pytest

from factspan.operators import ledger, recorder, replay
from factspan.plans.catalogue import ORACLES, QUERIES
from factspan.streaming import windows
from tests.oracles import agree

DIR = "/root/testdata/sf0.001"

ROW = "run string, i long, op string, args string, result string, state string"


def recorded(rng, run, n):
    held, out = {}, []
    for i in range(n):
        op, key, value = rng.choice(["put", "drop", "get", "count"]), f"k{rng.randrange(3)}", f"v{rng.randrange(3)}"
        was = held.get(key)
        if op == "put":
            held[key] = value
        elif op == "drop":
            held.pop(key, None)
        result = {"n": len(held)} if op == "count" else {"value" if op == "get" else "was": was}
        args = {"put": {"key": key, "value": value}, "count": {}}.get(op, {"key": key})
        state = f"{len(held)}:{sum(zlib.crc32(f'{k}={v}'.encode()) for k, v in held.items())}"
        out.append([run, i, op, json.dumps(args), replay.canonical(result), state])
    return out


@pytest.mark.parametrize("field, at, change", [
    (None, None, lambda r: r), ("i", 4, lambda r: [r[0], r[1] + 90, *r[2:]]), ("op", 5, lambda r: [*r[:2], "no", *r[3:]]), ("args", 6, lambda r: [*r[:3], "[", *r[4:]]),
    ("args", 6, lambda r: [*r[:2], "put", "{}", *r[4:]]), ("result", 7, lambda r: [*r[:4], r[4] + " ", r[5]]), ("state", 8, lambda r: [*r[:5], "9:9"]),
])
def test_planted_differences_are_found(spark, field, at, change):
    rng = random.Random(4)
    sound, planted = recorded(rng, "sound", 40), recorded(rng, "planted", 30)
    if at is not None:
        planted[at] = change(planted[at])
    got = {r.run: r for r in replay.replay(spark.createDataFrame(sound + planted, ROW).repartition(3)).collect()}
    assert got["sound"].status == "REPLAYS" and got["sound"].output == sound[-1][5] and got["sound"].n == 40
    r = got["planted"]
    assert (r.status, r.field, r.at) == (("DIFFERS", field, at) if field else ("REPLAYS", None, None)) and r.n == 30


def test_replay_of_nothing(spark):
    assert replay.replay(spark.createDataFrame([], ROW)).count() == 0


ROWS = "run string, ord long, kind string, actor string, data string"


def test_preflight_reasons(spark):
    cases = [
        ("approval", "owner", "{}", None), ("nothing", "owner", "{}", "UNKNOWN_KIND"), (None, "owner", "{}", "UNKNOWN_KIND"), ("system_message", "owner", "{}", "BAD_ACTOR"),
        ("approval", None, "{}", "BAD_ACTOR"), ("approval", "owner", "[]", "BAD_DATA"), ("approval", "owner", None, "BAD_DATA"), ("approval", "owner", "{", "BAD_DATA"),
        ("approval", "owner", '{"token":"long enough value"}', "UNREDACTED_SECRET_REFUSED"), ("approval", "owner", '{"a":["sk-ant-abcdefgh12"]}', "UNREDACTED_SECRET_REFUSED"),
    ]
    d = spark.createDataFrame([("r", i, *c[:3]) for i, c in enumerate(cases)], ROWS)
    assert [r.reason for r in recorder.preflight(d).orderBy("ord").collect()] == [c[3] for c in cases]


def rows(spark, run, n, first=0):
    return spark.createDataFrame([(run, i, "approval", "owner", f'{{"n":{i}}}') for i in range(first, first + n)], ROWS)


def test_two_writers_make_one_chain(spark, tmp_path):
    folder = str(tmp_path / "recorder")
    recorder.append(spark, folder, rows(spark, "a", 3))

    def other(tries):
        if tries == 1:  # another writer commits between this one's reading and its commit
            recorder.append(spark, folder, rows(spark, "a", 2, 100).union(rows(spark, "b", 1)))

    assert recorder.append(spark, folder, rows(spark, "a", 4, 50), before_commit=other) == 2
    events = recorder.read_events(spark, folder)
    bad = ledger.problems(events).where("sha_mismatch or prev_mismatch or bad_index")
    assert bad.count() == 0 and {(r.run, r.n) for r in ledger.head(events).collect()} == {("a", 9), ("b", 1)}
    told = [json.loads(json.loads(r.body)["data"])["n"] for r in events.where("run = 'a'").orderBy("i").collect()]
    assert told == [0, 1, 2, 100, 101, 50, 51, 52, 53]
    assert recorder.rejects(spark, folder).count() == 0 and len(recorder.commits(spark, folder)) == 3


@pytest.fixture
def late_broadcasts(spark):
    """Joins are planned by shuffle and turned into broadcasts at run time, as happens on large tables."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in changed.items():
        spark.conf.set(name, value)
    yield
    for name in changed:
        spark.conf.unset(name)


def test_runs_stay_whole_over_a_join_that_becomes_a_broadcast(spark, tmp_path, late_broadcasts):
    folder, columns = str(tmp_path / "recorder"), ("concat('r', id % 50) run", "id ord", "'approval' kind", "'owner' actor", "concat('{\"n\":', id, '}') data")
    for lo in (0, 1000):
        recorder.append(spark, folder, spark.range(lo, lo + 1000, 1, 7).selectExpr(*columns))
    events = recorder.read_events(spark, folder)
    assert ledger.problems(events).where("sha_mismatch or prev_mismatch or bad_index").count() == 0
    assert {r.n for r in ledger.head(events).collect()} == {40}


def in_many_files(spark, folder):
    spark.read.parquet(f"{DIR}/events.parquet").repartition(7).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["s10_recorded_heads", "l19_corrections"])
def test_recorder_queries_equal_their_sql_over_late_broadcasts(spark, tmp_path, late_broadcasts, name):
    agree(spark, in_many_files(spark, tmp_path), str(tmp_path), QUERIES[name], ORACLES[name])


def test_data_without_a_commit_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "recorder")
    assert recorder.read_events(spark, folder) is None

    def dies(tries):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        recorder.append(spark, folder, rows(spark, "a", 3), before_commit=dies)
    assert recorder.read_events(spark, folder) is None
    recorder.append(spark, folder, rows(spark, "a", 2))
    assert recorder.read_events(spark, folder).count() == 2


def test_corrections_are_rows_of_their_own(spark, tmp_path):
    folder = str(tmp_path / "recorder")
    first = spark.createDataFrame([("a", 0, "owner_utterance", "owner", "{}"), ("a", 1, "tool_call", "agent", "{}")], ROWS)
    recorder.append(spark, folder, first)
    events = recorder.read_events(spark, folder)
    said, called = (r.sha for r in events.orderBy("i").collect())
    asks = [
        (1, said[:12], "system_message", "not the owner", "owner", None), (2, said[:7], "system_message", "n", "owner", "PREFIX_TOO_SHORT"), (3, None, "system_message", "n", "owner", "PREFIX_TOO_SHORT"),
        (4, "0" * 10, "system_message", "n", "owner", "NOT_FOUND"), (5, called, "system_message", "n", "owner", "NOT_AN_ATTRIBUTION_ROW"), (6, said, "approval", "n", "owner", "UNKNOWN_KIND"),
        (7, said, "owner_utterance", "n", "owner", "NO_CHANGE"), (8, said, "system_message", "  ", "owner", "NOTE_REQUIRED"), (9, said, "system_message", "n", "process", "BAD_ACTOR"),
    ]
    d = recorder.corrections(events, spark.createDataFrame([a[:5] for a in asks], "id long, refers string, kind_should_be string, note string, actor string"))
    got = {r.id: r for r in d.collect()}
    assert {i: r.code for i, r in got.items()} == {a[0]: a[5] for a in asks}
    data = json.loads(got[1].data)
    assert data["refers"] == said and data["actor_should_be"] == "system" and got[1].run == "a"
    recorder.append(spark, folder, d.where("code is null").selectExpr("run", "2L ord", "kind", "actor", "data"))
    assert ledger.problems(recorder.read_events(spark, folder)).where("sha_mismatch or prev_mismatch or bad_index").count() == 0


def test_late_rule_on_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(6)
    updates = [(rng.randrange(5), i, rng.choice([None, rng.randrange(30)]), f"v{i}") for i in range(120)]
    schema = "position long, seq long, turn long, value string"
    source = tmp_path / "in"
    for n in range(4):
        spark.createDataFrame(updates[30 * n : 30 * n + 30], schema).coalesce(1).write.parquet(str(source / f"{n}"))
        stream = windows.read_appended(spark, f"{source}/*", spark.createDataFrame([], schema).schema)
        windows.retire_late(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    whole = windows.strictly_later(spark.createDataFrame(updates, schema), spark.createDataFrame([], "position long, turn long"))
    for part, late in (("accepted", False), ("late", True)):
        got = {r.seq for r in spark.read.parquet(f"{tmp_path}/out/{part}").collect()}
        assert got == {r.seq for r in whole.where(f"late = {late}").collect()}
    assert whole.where("late").count() > 10
