"""Scores and reports (survey A13, A16-A22, A24, K5-K9, X10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def gate_score(verdicts: DataFrame) -> DataFrame:
    """Per set, over rows (set, id, answerable, admitted, correct). The ids behind a count are
    named by their sum; gate_ids lists them as rows."""
    reach = F.col("answerable") & F.col("admitted") & F.col("correct")
    wrong = F.col("answerable") & F.col("admitted") & ~F.col("correct")
    unans = ~F.col("answerable") & F.col("admitted")
    return verdicts.groupBy("set").agg(
        F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"),
        F.count_if(reach).alias("reach"), F.count_if(wrong).alias("wrong_admitting"), F.count_if(unans).alias("unans_admitted"),
        F.coalesce(F.sum(F.when(reach, F.col("id"))), F.lit(0)).alias("reach_sum"),
    )


def gate_ids(verdicts: DataFrame) -> DataFrame:
    """The ids of each outcome, one row each."""
    outcome = F.when(~F.col("admitted"), None).when(~F.col("answerable"), "unans_admitted").when(F.col("correct"), "reach").otherwise("wrong_admitting")
    return verdicts.withColumn("outcome", outcome).where("outcome is not null").select("set", "outcome", "id")


def compare(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """Metrics (name, kind, value): safety may not rise, capability may not fall."""
    d = measured.alias("m").join(expected.alias("e"), "name", "full_outer")
    kind = F.coalesce("m.kind", "e.kind")
    worse = F.when(kind == "safety", F.col("m.value") > F.col("e.value")).otherwise(F.col("m.value") < F.col("e.value"))
    status = F.when(F.col("m.value").isNull(), "missing").when(F.col("e.value").isNull(), "new").when(worse, "regressed").otherwise("ok")
    return d.select("name", status.alias("status"), F.col("m.value").alias("measured"), F.col("e.value").alias("expected"))


def code_histogram(rows: DataFrame, codes: str = "codes") -> DataFrame:
    """How often each refusal code is given."""
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def top_matches(lines: DataFrame, by: str, order: str, text: str, terms: list[str], k: int) -> DataFrame:
    """K5: lines by number of terms they hold, later lines first among equals; k per group, given
    back in line order. Every group keeps k rows, so the limit is the feature."""
    hits = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0))
    d = lines.withColumn("hits", hits).where("hits > 0")
    return d.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("hits"), F.desc(order)))).where(F.col("_r") <= k).drop("_r")


def last_matches(lines: DataFrame, by: str, order: str, where: Column, k: int = 30) -> DataFrame:
    """K6: the last k matching lines of each group."""
    return lines.where(where).withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= k).drop("_r")


def recovery(events: DataFrame, run: str, order: str) -> DataFrame:
    """Refused ops after which the same op later succeeds in the run, as an exact ratio."""
    ok = F.max(F.when(~F.col("refused"), F.col(order))).over(W.partitionBy(run, "op"))
    d = events.withColumn("ok_at", ok).where("refused")
    return d.groupBy(run).agg(F.count_if(F.col("ok_at") > F.col(order)).alias("num"), F.count(F.lit(1)).alias("den"))


def shares(segments: DataFrame) -> DataFrame:
    """Characters per kind of segment."""
    return segments.groupBy("kind").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))


def capped_view(rows: DataFrame, by: str, order: list[Column], lines: int = 40) -> DataFrame:
    """The first lines of each group and how many were left out."""
    w = W.partitionBy(by)
    d = rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(w) - lines, F.lit(0)))
    return d.where(F.col("_r") <= lines).drop("_r")


def fixed_order(column: str, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed list; others last."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column))
    return F.when(at == 0, len(order) + 1).otherwise(at)


def newest(runs: DataFrame, by: str, limit: int = 200) -> DataFrame:
    """A listing of the newest runs; the limit is the feature."""
    return runs.orderBy(F.desc(by)).limit(limit)


def in_first_order(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The values of a group in the order they came first."""
    firsts = rows.groupBy(by, value).agg(F.min(order).alias("_at"))
    return firsts.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]), ",").alias("values"))
