"""Language identification: word first, backing off to shorter character n-grams.

Words are runs of letters (Unicode category L) of the lower-cased text. A word seen in training
scores its log frequency in each language. An unseen word is wrapped in boundary marks and
scored by the mean log frequency of its 4-grams; if none of them was seen, by its 3-grams, then
2-grams, then single characters; a word of wholly unknown characters says nothing. The
document's language has the largest sum; `score` is its posterior, with the evidence of long
texts scaled down to TEMPER words.

The model is a classifier fitted on a bounded sample of labelled rows (TRAIN_ROWS) outside the
held-out fold. Every word and n-gram of the sample is known, however rare. Tables are sorted
64-bit hashes beside a matrix of log frequencies; words are found in them a slice of documents
at a time. Every document is predicted from its whole text.

Defined results: null text or a text without letters gives ``und`` with score 0, as does a
corpus without any labelled row; equal sums give the alphabetically first language; a null id
counts as the empty text for the fold; repeated rows each get the same result; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm.common import bounded_sample, documents, fold, id_text, map_batches, map_texts
from factspan.llm.words import LetterWords, found, summed

TRAIN_ROWS = 20_000
ORDERS = (4, 3, 2, 1)
#: Stands for whole words among the orders.
WORD = 0
SMOOTHING = 0.1
TEMPER = 30
UNDETERMINED = "und"
_FLUSH = 1 << 20

_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("c", T.LongType())])


class _Count:
    """Counts by (lang, n, hash) of a task, summed in place and handed out when they are many and at the end."""

    def __init__(self):
        self.held: dict[tuple[str, int], list] = {}
        self.rows = 0

    def _add(self, lang: str, n: int, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.setdefault((lang, n), []).append((keys, counts))
        self.rows += len(keys)

    def __call__(self, langs, texts):
        for lang in sorted(set(langs)):
            words = LetterWords([t for t, own in zip(texts, langs) if own == lang])
            keys, first, times = np.unique(words.hashes, return_index=True, return_counts=True)
            if not len(keys):
                continue
            self._add(lang, WORD, keys, times)
            order = np.argsort(first)
            for n, word, grams in words.grams(first[order], ORDERS):
                self._add(lang, n, *summed(grams, times[order][word]))
        if self.rows > _FLUSH:
            self._sum()
        return self.drain() if self.rows > _FLUSH // 2 else None

    def _sum(self) -> None:
        self.held = {k: [summed(*map(np.concatenate, zip(*v)))] for k, v in self.held.items()}
        self.rows = sum(len(v[0][0]) for v in self.held.values())

    def drain(self):
        self._sum()
        out = [(lang, n, keys, counts) for (lang, n), [(keys, counts)] in self.held.items()]
        self.held, self.rows = {}, 0
        if not out:
            return [[], [], [], []]
        size = [len(x[2]) for x in out]
        langs = np.repeat(np.array([x[0] for x in out], dtype=object), size)
        return [langs, np.repeat([x[1] for x in out], size).astype(np.int32), np.concatenate([x[2] for x in out]).view(np.int64), np.concatenate([x[3] for x in out])]

    def finish(self):
        yield self.drain()


def fit(df: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Per order the sorted hashes and their log frequencies by language, from a bounded sample."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    counts = map_texts(bounded_sample(docs, rows).select("lang", "text"), _Count, _COUNTS, "language").groupBy("lang", "n", "key").agg(F.sum("c").alias("c"))
    got = counts.toArrow().combine_chunks()
    lang = got["lang"].combine_chunks().dictionary_encode()
    langs = sorted(lang.dictionary.to_pylist())
    column = np.array([langs.index(x) for x in lang.dictionary.to_pylist()], dtype=np.int64)[lang.indices.to_numpy()] if langs else np.zeros(0, dtype=np.int64)
    order, keys, times = got["n"].to_numpy(), got["key"].to_numpy().view(np.uint64), got["c"].to_numpy()
    model: dict = {"langs": langs, "keys": {}, "logs": {}}
    for n in (WORD, *ORDERS):
        at = np.flatnonzero(order == n)
        known, row = np.unique(keys[at], return_inverse=True)
        m = np.zeros((len(known), len(langs)))
        m[row, column[at]] = times[at]
        model["keys"][n] = known
        model["logs"][n] = np.log((m + SMOOTHING) / (m.sum(0) + SMOOTHING * (len(known) + 1))).astype(np.float32)
    return model


class Scorer:
    """Language and score of every text of a slice."""

    def __init__(self, model: dict):
        self.langs, self.keys, self.logs = model["langs"], model["keys"], model["logs"]

    def _rows(self, words: LetterWords, first: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Log scores by language of distinct words, given where each occurs first."""
        at, known = found(self.keys[WORD], keys)
        rows = np.zeros((len(keys), len(self.langs)))
        rows[known] = self.logs[WORD][at[known]]
        open_ = np.flatnonzero(~known)
        open_ = open_[np.argsort(first[open_])]
        for n in ORDERS:
            if not len(open_):
                break
            number = np.zeros(len(open_), dtype=np.int64)
            total = np.zeros((len(open_), len(self.langs)))
            for _, word, grams in words.grams(first[open_], (n,)):
                at, seen = found(self.keys[n], grams)
                word, at = word[seen], at[seen]
                number += np.bincount(word, minlength=len(open_))
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(word, self.logs[n][at, k], len(open_))
            done = number > 0
            rows[open_[done]] = total[done] / number[done, None]
            open_ = open_[~done]
        return rows

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = LetterWords(texts)
        if not self.langs or not len(words.starts):
            return [(UNDETERMINED, 0.0)] * len(texts)
        keys, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        rows = self._rows(words, first, keys)
        total = np.stack([np.bincount(words.owner, rows[which, k], len(texts)) for k in range(len(self.langs))], axis=1)
        z = total * np.minimum(1.0, TEMPER / np.maximum(words.counts, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        score = p.max(1) / p.sum(1)
        return [(self.langs[k], float(s)) if c else (UNDETERMINED, 0.0) for c, k, s in zip(words.counts, total.argmax(1), score)]


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType()),
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def predict(df: DataFrame, model: dict | None = None) -> DataFrame:
    model = fit(df) if model is None else model
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        score = Scorer(sent.value)

        def step(ids, texts, held):
            got = score(texts)
            return [ids, held, [g[0] for g in got], [g[1] for g in got]]

        return step

    return map_texts(id_text(df).withColumn("held_out", fold() == 0), make, SCHEMA, "language")


def keep_identified(df: DataFrame, least: float = 0.5, model: dict | None = None) -> DataFrame:
    """The rows of df whose language is determined with a score of at least `least`, unchanged."""
    model = fit(df) if model is None else model
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def make():
        score = Scorer(sent.value)

        def step(batch):
            got = score(batch.column(at).cast("string").to_pylist())
            return batch.filter([lang != UNDETERMINED and s >= least for lang, s in got])

        return step

    return map_batches(df, make, "language")


def op8_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(documents(spark, sf_dir))
