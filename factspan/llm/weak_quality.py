"""Quality classifier from weak labels.

The overlapping heuristic labellers of ``rules`` vote on every document; expectation-
maximisation over the counted vote patterns of the whole corpus estimates their accuracies and
gives each pattern a posterior. The posteriors label a bounded sample (TRAIN_ROWS, and TRAIN_CHARACTERS of it) that trains
a linear scorer over hashed features: shares of lower-cased words, of word shapes, and of
words that repeat their neighbour. The scorer, not the votes, decides: it generalises to junk
no labeller saw, and it needs one pass over the texts.

Because features are shares of words, a document's score is the mean of its words' weights; a
worker looks a known word's weight up instead of hashing it again.

Defined results: a null text, or one without words, scores 0 and is not kept; null ids keep
their row; repeated rows each get the same result; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm import rules
from factspan.llm.common import documents, id_text, keep, map_texts, materialise

TRAIN_ROWS = 6_000
#: A sample of longer texts has fewer rows: what is learnt from stays this small.
TRAIN_CHARACTERS = 32_000_000
BITS = 16
STEPS = 150
LEAST = 0.5
_CACHE = 250_000
_SHAPES = ((re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[^\\W\\d_A]+"), "a"), (re.compile("[0-9]+"), "0"))


def shape_of(word: str) -> str:
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:12]


def buckets(word: str) -> tuple[int, int]:
    half = 1 << (BITS - 1)
    code = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % half
    return code(word.lower()), half + code(shape_of(word))


def stutter(words: list[str]) -> float:
    return sum(map(eq, words, words[1:])) / len(words)


_FEATURES = T.StructType([T.StructField("posterior", T.DoubleType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("share", T.ArrayType(T.FloatType())), T.StructField("stutter", T.DoubleType())])


def _features():
    def step(posteriors, texts):
        out: list[list] = [[], [], [], []]
        for p, text in zip(posteriors, texts):
            words = (text or "").split()
            if not words:
                continue
            counts: Counter = Counter()
            for w, c in Counter(words).items():
                for b in buckets(w):
                    counts[b] += c
            for col, v in zip(out, (p, list(counts), [c / len(words) for c in counts.values()], stutter(words))):
                col.append(v)
        return out

    return step


def train_linear(y: np.ndarray, doc: np.ndarray, at: np.ndarray, x: np.ndarray, stutters: np.ndarray, steps: int = STEPS) -> dict:
    """Logistic regression on soft labels, both classes weighing the same; adaptive full-batch steps.
    Features are flat: document doc[i] has the share x[i] of bucket at[i], once a bucket."""
    w, tail = np.zeros(1 << BITS), np.zeros(2)  # tail: bias and stutter
    if len(y):
        x = x.astype(np.float64)
        weight = y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1)
        rare = np.bincount(at, minlength=len(w)) < 3  # a bucket of one or two documents only remembers them
        g2w, g2t = np.full(len(w), 1e-8), np.full(2, 1e-8)
        for _ in range(steps):
            z = np.bincount(doc, x * w[at], len(y)) + tail[0] + tail[1] * stutters
            err = (1 / (1 + np.exp(-z)) - y) * weight
            gw = np.bincount(at, x * err[doc], len(w)) + 1e-5 * w
            gw[rare] = 0
            gt = np.array([err.sum(), (err * stutters).sum()])
            g2w += gw * gw
            g2t += gt * gt
            w -= 0.5 * gw / np.sqrt(g2w)
            tail -= 0.5 * gt / np.sqrt(g2t)
    return {"w": w.astype(np.float32), "tail": tail.tolist()}


def fit(df: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Weak labels over the whole table, then the scorer on a bounded sample of them. Every text is
    measured once; the sample meets its votes by the hash of id and text."""
    names = [f"vote_{k}" for k in rules.votes()]
    docs = id_text(df).select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    measured = rules.measure(docs, exact=False)
    cast = materialise(measured.select(F.col("doc_id").alias("h"), "word_chars", *(v.cast("tinyint").alias(f"vote_{k}") for k, v in rules.votes().items())), "votes")
    counted = cast.groupBy(*names).agg(F.count(F.lit(1)).alias("c")).collect()  # at most 3 ** 10 rows
    prior, accuracy = rules.estimate(sorted((tuple(r[k] for k in names), r.c) for r in counted))
    z = F.lit(math.log(prior / (1 - prior)))
    for k, a in zip(names, accuracy):
        up, down = rules.evidence(a)
        z = z + F.when(F.col(k) > 0, up).when(F.col(k) < 0, down).otherwise(0.0)
    total, characters = cast.agg(F.count(F.lit(1)), F.coalesce(F.sum("word_chars"), F.lit(0))).first()
    share = min(1.0, rows / max(total, 1), TRAIN_CHARACTERS / max(characters, 1))
    drawn = F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(1 << 30)) < math.ceil(share * 2**30)
    labels = cast.where(drawn).select("h", (1 / (1 + F.exp(-z))).alias("posterior")).dropDuplicates(["h"])
    sample = docs.withColumnRenamed("doc_id", "h").where(drawn).join(labels, "h").select("posterior", "text")
    got = map_texts(sample, _features, _FEATURES).toArrow().combine_chunks()
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(got.num_rows), got["at"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)) if got.num_rows else np.empty(0, dtype=np.int64)
    model = train_linear(got["posterior"].to_numpy(), doc, flat("at"), flat("share"), got["stutter"].to_numpy()) if got.num_rows else train_linear(np.empty(0), doc, doc, doc, doc)
    return model | {"prior": prior, "accuracy": accuracy}


class Scorer:
    def __init__(self, model: dict):
        self.w, self.tail, self.weights = model["w"], model["tail"], {}

    def __call__(self, text: str | None) -> tuple[int, float]:
        words = text.split() if text else []
        if not words:
            return 0, 0.0
        known = self.weights
        got = list(map(known.get, words))
        if None in got:
            if len(known) > _CACHE:
                known.clear()
            for i, w in enumerate(words):
                if got[i] is None:
                    a, b = buckets(w)
                    got[i] = known[w] = float(self.w[a] + self.w[b])
        z = sum(got) / len(words) + self.tail[0] + self.tail[1] * stutter(words)
        return len(words), 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def scorer_of(model: dict) -> Scorer:
    """The scorer of the model in use: a worker's next task finds it with the weights it has looked up."""
    return keep("quality", model, lambda: Scorer(model))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def classify(df: DataFrame, model: dict | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, score and kept of every document."""
    model = fit(df) if model is None else model
    sent = df.sparkSession.sparkContext.broadcast({"w": model["w"], "tail": model["tail"]})

    def make():
        score = scorer_of(sent.value)

        def step(ids, texts):
            got = [score(t) for t in texts]
            return [ids, [n for n, _ in got], [s for _, s in got], [n > 0 and s >= least for n, s in got]]

        return step

    return map_texts(id_text(df), make, SCHEMA, "quality")


def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))
