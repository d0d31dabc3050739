"""Connected components over tables, and agreement of answers across sentences (survey A14)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.session import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that lineage ends and a lost executor costs little."""
    path = f"{shared_folder(df.sparkSession)}/factspan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of nodes(node) under links(a, b): the root is the least node that can be reached.

    Each round hands every node the least label around it and then the label of that label, so
    chains halve; labels only fall, and a round without a fall ends it."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(nodes.select("node", F.col("node").alias("root")).distinct(), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
        # a node also draws its old root down with it
        drawn = low.where("root < was").groupBy(F.col("was").alias("node")).agg(F.min("root").alias("drawn"))
        now = low.join(jump, "root", "left").join(drawn, "node", "left").select("node", "was", F.least("root", F.coalesce("next", "root"), F.coalesce("drawn", "root")).alias("root"))
        now = written(now, "labels")
        labels = now.select("node", "root")
        if not now.where("root < was").head(1):
            return labels


def norm(c):
    return F.lower(F.regexp_replace(c, r"[\s\p{P}]+", ""))


def statements(answers: DataFrame) -> DataFrame:
    """answers(qid, sid, start, end, text) that no other answer of their question and sentence
    contains, each form once with its longest text: (qid, sid, form, text)."""
    w = W.partitionBy("qid", "sid").orderBy(F.asc("start"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    d = answers.withColumn("form", norm(F.col("text"))).where("form <> ''").select("qid", "sid", "start", "end", "text", "form")
    d = d.withColumn("reach", F.max("end").over(w)).withColumn("same", F.max(F.struct("end", "start")).over(w))
    inside = F.coalesce((F.col("end") <= F.col("reach")) & ~((F.col("same.start") == F.col("start")) & (F.col("same.end") == F.col("end"))), F.lit(False))
    return d.where(~inside).groupBy("qid", "sid", "form").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))


def agreement(told: DataFrame) -> DataFrame:
    """(qid, sid, group) of told(qid, sid, form): sentences that share a form agree, and groups
    are what agreement connects, named by their least sid. Sentences of one form hang on its first
    one, so a form that many sentences state makes as many links, not their square."""
    first = told.groupBy("qid", "form").agg(F.min("sid").alias("least"))
    name = lambda sid: F.struct("qid", F.col(sid).alias("sid"))
    links = told.join(first, ["qid", "form"]).where("sid <> least").select(name("sid").alias("a"), name("least").alias("b"))
    nodes = told.select(name("sid").alias("node")).distinct()
    return components(nodes, links).select("node.qid", "node.sid", F.col("root.sid").alias("group"))
