"""Audits of what was written, said and retired (survey P9, J13, J14, L10, L11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def unsourced_writes(writes: DataFrame, said: DataFrame) -> DataFrame:
    """Writes whose sentence the user has not said in the session before or at that turn.
    Both sides are (session, turn, sent); the earliest saying decides, so no pairs are made."""
    earliest = said.groupBy("session", "sent").agg(F.min("turn").alias("said_at"))
    d = writes.join(earliest, ["session", "sent"], "left")
    return d.where(F.col("said_at").isNull() | (F.col("said_at") > F.col("turn"))).select("session", "turn", "sent")


def unrecorded_statements(said: DataFrame, stored: DataFrame, answers: DataFrame) -> DataFrame:
    """User statements at an answered position with another value that were never stored."""
    other = said.join(answers.select("position", F.col("value").alias("answer")), "position").where("value <> answer")
    return other.join(stored.select("session", "turn", "position").distinct(), ["session", "turn", "position"], "left_anti").select("session", "turn", "position", "value")


def lossy_blocked(rows: DataFrame, lossy: DataFrame) -> DataFrame:
    """Rows whose turn is not later than every lossy turn of their session: the last lossy
    turn decides."""
    last = lossy.groupBy("session").agg(F.max("turn").alias("last_lossy"))
    return rows.join(last, "session").where("turn <= last_lossy").drop("last_lossy")


def ambiguous_positions(sentences: DataFrame) -> DataFrame:
    """Positions read in two or more sentences of a message, or in one right before an unreadable
    sentence (position NULL)."""
    w = W.partitionBy("session", "turn").orderBy("k")
    d = sentences.withColumn("next_unread", F.lead("position").over(w).isNull() & F.lead("k").over(w).isNotNull())
    d = d.where(F.col("position").isNotNull()).groupBy("session", "turn", "position").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("next_unread").cast("int")).alias("cut"))
    return d.where("n > 1 or cut = 1").select("session", "turn", "position", "n", (F.col("cut") == 1).alias("before_unread"))
