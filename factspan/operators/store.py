"""The fact store as projections of its ledger (survey S11-S13, L8, L12, L18, M5, M6, P11-P13, A17, W12, V3).

A ledger row is (session, i, op, ok, args, result) with args and result as JSON text; every
table here is derived from it and can be derived again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Ops that store a sentence, and the classes of caps.
WRITES = ("write", "keep_unshaped")
SIZES = {"text": 2000, "turn": 64, "topic": 200}


def _arg(name: str) -> Column:
    return F.get_json_object("args", f"$.{name}")


def committed_sessions(rows: DataFrame) -> DataFrame:
    return rows.where("op = 'commit' and ok").select("session").distinct()


def memory_rows(rows: DataFrame) -> DataFrame:
    """The accepted writes of committed sessions, in order."""
    d = rows.where(F.col("op").isin(*WRITES) & F.col("ok")).join(committed_sessions(rows), "session", "left_semi")
    return d.select("session", "i", _arg("text").alias("sent"), _arg("turn").alias("turn"), (F.col("op") == "keep_unshaped").alias("unshaped"))


def side_table(rows: DataFrame, op: str, fields: tuple[str, ...]) -> DataFrame:
    """Declarations, bridges, supersedes, reports: one table per op."""
    return rows.where((F.col("op") == op) & F.col("ok")).join(committed_sessions(rows), "session", "left_semi").select("session", "i", *(_arg(f).alias(f) for f in fields))


def rejects(rows: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Rows whose arguments are missing or too long, with the reason."""
    reason = F.lit(None).cast("string")
    for name, most in (sizes or SIZES).items():
        reason = F.coalesce(reason, F.when(F.length(_arg(name)) > most, F.lit(f"oversize:{name}")))
    reason = F.coalesce(F.when(F.col("op").isin(*WRITES) & _arg("text").isNull(), "missing:text"), reason)
    return rows.withColumn("reason", reason).where("reason is not null").select("session", "i", "op", "reason")


def replayed(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows in one of two tables only; none if the store replays."""
    return stored.exceptAll(derived).withColumn("side", F.lit("stored")).union(derived.exceptAll(stored).withColumn("side", F.lit("derived")))


def session_events(rows: DataFrame) -> DataFrame:
    """Per session and op, how often it ran and how often it was refused."""
    return rows.groupBy("session", "op").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("refused"))


def self_corrections(rows: DataFrame, key: Column) -> DataFrame:
    """A refused or noted write and the next write to the same place, when its text differs."""
    w = W.partitionBy("session", "_key").orderBy("i")
    d = rows.where(F.col("op").isin(*WRITES)).withColumn("_key", key)
    d = d.withColumn("next_i", F.lead("i").over(w)).withColumn("next_text", F.lead(_arg("text")).over(w))
    return d.where(~F.col("ok") & F.col("next_i").isNotNull() & (F.col("next_text") != _arg("text"))).select("session", "i", "next_i")


def superseded(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """M5: memory rows with the mark that retired them, if any: the first one counts."""
    first = marks.groupBy("session", "old_i").agg(F.min(F.struct("i", "reason")).alias("m")).select("session", F.col("old_i").alias("i"), F.col("m.i").alias("by"), F.col("m.reason").alias("reason"))
    return rows.join(first, ["session", "i"], "left")


def exit_state(chain_status: Column, replay_ok: Column, audits: Column, inputs_ok: Column) -> Column:
    """The first state that is not OK."""
    return F.when(chain_status != "OK", chain_status).when(~inputs_ok, "INPUTS_MISMATCH").when(~replay_ok, "REPLAY_DIFFERS").when(audits > 0, "AUDIT_FAILED").otherwise("OK")


def statistics(facts: DataFrame) -> DataFrame:
    """Positions, entries and the longest history per scope."""
    per = facts.groupBy("scope", "position").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("scope").agg(F.count(F.lit(1)).alias("positions"), F.sum("c").alias("entries"), F.max("c").alias("longest"))


def clean_value(text: Column, start: Column, end: Column) -> Column:
    """How a value stands in its write: boundary, multi_clause_write, not_asserted or clean.

    Its neighbours must be marks, spaces or particles; no other comma or full stop may stand in
    the write; and what follows it must be a closed tail."""
    left, right = F.substring(text, start, F.lit(1)), F.substring(text, end + 1, F.length(text))
    outside = F.concat(F.substring(text, F.lit(1), start), F.regexp_replace(right, "[。.]$", ""))
    return (
        F.when((start > 0) & left.rlike(r"[\p{L}\p{N}_・-]") & ~left.rlike("[はがをにでとへの]"), "boundary")
        .when(right.rlike("[!?！？]"), "not_asserted")
        .when(outside.rlike("[,、，.。]"), "multi_clause_write")
        .when(~right.rlike("^(です|でした|である|だ|に変更(した|しました)?|に更新(した|しました)?)?[。.]?$"), "not_asserted")
        .otherwise("clean")
    )


def verbatim(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Is the quote the stretch itself?"""
    return F.substring(text, start + 1, end - start) == quote


def fold_placements(rows: DataFrame) -> DataFrame:
    """V3: the state of a run after put, drop and swap rows (run, i, op, seat, unit): the last word
    on every seat, drops empty it, and a swap is two puts."""
    puts = rows.where("op in ('put', 'drop')").select("run", "i", "seat", F.when(F.col("op") == "put", F.col("unit")).alias("unit"))
    last = puts.groupBy("run", "seat").agg(F.max_by("unit", "i").alias("unit"), F.max("i").alias("i"))
    return last.where("unit is not null")
