"""Replay that executes (survey L6, L9): recorded rows are run again and compared field by field.

A machine is a start state and a function from (state, op, args) to (state, result, check). Runs are
dealt over tasks and streamed in order, so a task holds one state at a time, whatever the length of
a run. The first field that differs, in the order of FIELDS, ends a run's replay; a run that replays
to its end also gives its output, made again from nothing but the ops."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.operators.folds import ordered_fold

#: Fixed value: the fields in the order in which they are compared.
FIELDS = ("i", "op", "args", "result", "state")


class Refused(Exception):
    """An op that the machine does not have, or args that it cannot read; names the field."""


@dataclass(frozen=True)
class Machine:
    start: Callable[[], object]
    execute: Callable[[object, str, dict], tuple[object, dict, str]]
    output: Callable[[object], str]


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _weight(key: str, value: str) -> int:
    return zlib.crc32(f"{key}={value}".encode())


def _store(state: tuple[dict, int], op: str, args: dict) -> tuple[tuple[dict, int], dict, str]:
    """A store of keys: put, drop, get, count. Its check is kept up with each op, not made anew."""
    held, total = state
    if op not in ("put", "drop", "get", "count"):
        raise Refused("op")
    try:
        key = args["key"] if op != "count" else None
        value = args["value"] if op == "put" else None
    except (KeyError, TypeError) as e:
        raise Refused("args") from e
    was = held.get(key)
    if op == "put":
        held[key] = value
        total += _weight(key, value) - (_weight(key, was) if was is not None else 0)
        result = {"was": was}
    elif op == "drop":
        held.pop(key, None)
        total -= _weight(key, was) if was is not None else 0
        result = {"was": was}
    elif op == "get":
        result = {"value": was}
    else:
        result = {"n": len(held)}
    return (held, total), result, f"{len(held)}:{total}"


STORE = Machine(lambda: ({}, 0), _store, lambda state: f"{len(state[0])}:{state[1]}")

_OUT = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("n", T.LongType()), T.StructField("at", T.LongType()), T.StructField("field", T.StringType()),
    T.StructField("expected", T.StringType()), T.StructField("recorded", T.StringType()), T.StructField("output", T.StringType()),
])


def replay(rows: DataFrame, machine: Machine = STORE) -> DataFrame:
    """For rows(run, i, op, args, result, state), args and result JSON texts, per run: REPLAYS or
    DIFFERS, how many rows it has, and where, in which field and how it differs first."""
    schema = T.StructType([rows.schema["run"], *_OUT])

    def differs(i: int, state: object, op: str, args: str, result: str, check: str) -> tuple[object, tuple[str, str | None, str | None] | None]:
        try:
            told = json.loads(args)
        except (TypeError, ValueError):
            return state, ("args", None, args)
        try:
            state, made, now = machine.execute(state, op, told)
        except Refused as e:
            return state, (str(e), None, op if str(e) == "op" else args)
        for field, expected, recorded in (("result", canonical(made), result), ("state", now, check)):
            if expected != recorded:
                return state, (field, expected, recorded)
        return state, None

    def step(kept, row):
        state, n, found = kept
        _, i, op, args, result, check = row
        if found is None and i != n:
            found = (n, "i", str(n), str(i))
        elif found is None:
            state, field = differs(i, state, op, args, result, check)
            found = field and (n, *field)
        return (state, n + 1, found), []

    def end(key, kept):
        state, n, found = kept
        if found is None:
            return [(*key, "REPLAYS", n, None, None, None, None, machine.output(state))]
        return [(*key, "DIFFERS", n, *found, None)]

    return ordered_fold(rows.select("run", "i", "op", "args", "result", "state"), ["run"], "i", schema, lambda: (machine.start(), 0, None), step, end)


def explain(replayed: DataFrame) -> DataFrame:
    """How many runs replay, and how many differ by each field."""
    return replayed.groupBy("status", F.coalesce("field", F.lit("")).alias("field")).agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("rows"))
