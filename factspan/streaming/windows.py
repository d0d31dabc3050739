"""Streams: appended rows, incremental indexes, event-time windows (survey 2.17, S9, V3).

Event-time windows and watermarks are an extension; the rest mirrors append-only ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from factspan.operators import ledger, units


def read_appended(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet", **options: str) -> DataFrame:
    """Files appended to a folder, each once."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(folder)


def tumbling(events: DataFrame, every: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per type and window; rows later than the watermark are dropped by Spark."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    d = d.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return d.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    d = d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def committed(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of sessions with a commit row; the rest stay invisible."""
    return rows.join(commits.select("session").distinct(), "session", "left_semi")


def index_incrementally(sentences: DataFrame, path: str, checkpoint: str, tier: str = "WORD"):
    """An index that grows by micro-batches. A batch writes its postings under its own number, so a
    repeated batch overwrites itself; the union over batches equals a rebuild (units.append_postings)."""

    def write(batch: DataFrame, number: int) -> None:
        units.postings(units.once(batch, tier), tier).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sentences.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_index(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.parquet(path).drop("batch")
    return units.append_postings(d, d.limit(0))


STREAK_OUT = "run string, key string, streak long, refused boolean"


def streaks(calls: DataFrame, repeat: int = 8):
    """W8 on a stream of (run, seq, key): state is the last key and its streak; a call beyond
    `repeat` equal ones in a row is refused."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches, state: GroupState):
        last, n = state.get if state.exists else (None, 0)
        rows = sorted((int(s), k) for pdf in batches for s, k in zip(pdf["seq"], pdf["key"]))
        out = []
        for _, k in rows:
            n = n + 1 if k == last else 1
            last = k
            out.append((key[0], k, n, n > repeat))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["run", "key", "streak", "refused"])

    return calls.groupBy("run").applyInPandasWithState(fold, STREAK_OUT, "last string, n long", "append", GroupStateTimeout.NoTimeout)


def seal_batches(rows: DataFrame, path: str, checkpoint: str, run: str, order: str, body):
    """S9 as a stream: every micro-batch extends the chains written by the ones before it, under its
    own number, so a repeated batch writes the same rows again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        heads = spark.createDataFrame([], f"run {rows.schema[run].dataType.simpleString()}, head string, n long")
        if number:
            heads = ledger.head(spark.read.parquet(path).where(F.col("batch") < number).drop("batch"))
        ledger.extend(heads, batch, run, order, body).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def strictly_later(updates: DataFrame, known: DataFrame) -> DataFrame:
    """The late rule over updates(position, seq, turn, value): an update retires what stands only if its
    turn is strictly later than every turn that came before it, here or in known(position, turn)."""
    before = W.partitionBy("position").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    d = updates.join(known.groupBy("position").agg(F.max("turn").alias("latest")), "position", "left")
    latest = F.greatest(F.max("turn").over(before), F.col("latest"))
    return d.withColumn("late", F.coalesce(F.col("turn") <= latest, F.lit(False))).drop("latest")


def retire_late(updates: DataFrame, path: str, checkpoint: str):
    """The late rule on a stream: accepted updates go to `path/accepted`, late ones to the side table
    `path/late`, each batch under its number. What a batch compares with are the batches before it,
    so a batch that is repeated after a crash writes the same rows again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.createDataFrame([], batch.select("position", "turn").schema)
        if number:
            known = spark.read.parquet(f"{path}/accepted").where(F.col("batch") < number).select("position", "turn")
        split = strictly_later(batch, known)
        split.where("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        split.where("not late").drop("late").write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
