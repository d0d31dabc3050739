"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

Words are handled as 64-bit hashes, a slice of documents at a time. Word counts of all training
documents come from one aggregation and stay a table. The most frequent words (at most HEAVY,
chosen by a count threshold so that the bound is proven) travel to the workers; the counts of all
other words reach the documents through a join.

The model has two levels. It predicts one of a set of symbols from the two before: the end, the most
frequent words (VOCABULARY at least, more with each doubling of the training tokens, up to
MOST_VOCABULARY), and CLASSES classes of all other words, by their spelling and their last
characters, each with vectors of its own as context and as target. A word of a class is its class
times its smoothed share of the class's tokens, unseen words included, so every word has a
proper probability from the model and a text has one too. The context vector is a sum of
position-weighted symbol vectors, its products with all output vectors are taken in batches and
normalised for every pair of context symbols once, so that scoring a token is two table look-ups
minus a stored log normaliser. The three tables take 60 MB in a worker at most, whatever the corpus.

Symbols are trained on the counts of all (two before, one before, symbol) triples of all training
documents, a distributed table. Each epoch takes every triple once, at its count: triples are
spread by hash over groups of about GROUP_ROWS, which are sorted and packed once, every group descends from the common parameters
and their token-weighted mean begins the next epoch. Triples counted above the mean are split
into equal shares, so that no step is ruled by one of them.

Defined results: a null text is empty and holds its end token alone; null ids count as the
empty text for the fold and keep their row; repeated rows each get the same result; without
training documents all words are unseen and the base score is that of the formula; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm.common import documents, fold, id_text, map_texts, materialise
from factspan.llm.words import Directory, SpaceWords, mix, summed

HEAVY = 300_000
VOCABULARY, MOST_VOCABULARY = 1024, 1456
#: Words more for each doubling of the training tokens beyond a million.
VOCABULARY_GROWTH = 24
DIMENSION = 32
GROUP_ROWS = 1 << 20
#: Triples of a group that make one row of the table that the epochs read.
PACKED_ROWS = 1 << 14
EPOCHS = 3
NOISE = 64
BATCH = 1024
_FLUSH = 1 << 20
_FLUSH_TOKENS = 4_000_000
#: Classes of words without a symbol of their own: how they are spelt, times how they end.
SPELLINGS, ENDINGS = 8, 96
CLASSES = SPELLINGS * ENDINGS
#: Stands for a class where the end tokens are counted; their word is 0.
END = -1


def _bytes(within: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(within.encode())] = True
    return out


_STOP, _PAUSE, _DIGIT, _LETTER = _bytes(".!?"), _bytes(",;:"), _bytes("0123456789"), _bytes("abcdefghijklmnopqrstuvwxyz")
_BEYOND = np.arange(256) > 127


def classes_of(words: SpaceWords, which: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Class of each word, or of those asked for: its spelling (how it ends, and whether it has digits or is
    not ASCII) and its last two characters before a mark, which tell languages and forms apart, by a hash of them."""
    starts, ends = words.starts[which], words.ends[which]
    last = words.bytes[ends - 1]
    mark = np.where(_STOP[last], 0, np.where(_PAUSE[last], 1, 2))
    plain = 2 * mark + words.having(_BEYOND, which)
    odd = (mark == 2) & ~_LETTER[last] & (last <= 127)
    spelling = np.where(words.having(_DIGIT, which), 6, np.where(odd, 7, plain))
    end = ends - 1 - (mark < 2)
    one, two = (np.where(end - k >= starts, words.bytes[np.maximum(end - k, 0)], 0).astype(np.uint64) for k in (0, 1))
    ending = mix(one * np.uint64(257) + two) % np.uint64(ENDINGS)
    return (spelling * ENDINGS + ending.astype(np.int64)).astype(np.int32)


_COUNT_SCHEMA = T.StructType([T.StructField("word", T.LongType()), T.StructField("class", T.IntegerType()), T.StructField("c", T.LongType())])


def _count_words():
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows, ends = [0], [0]

    def merged():
        if not held:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        words, kinds, counts = map(np.concatenate, zip(*held))
        keys, first = np.unique(words, return_index=True)
        return keys, kinds[first], summed(words, counts)[1]

    def drain():
        words, kinds, counts = merged()
        held.clear()
        rows[0], end = 0, ends[0]
        ends[0] = 0
        return [np.append(words.view(np.int64), 0), np.append(kinds, np.int32(END)), np.append(counts, end)]

    def step(texts):
        w = SpaceWords(texts)
        ends[0] += len(texts)
        keys, first, counts = np.unique(w.hashes, return_index=True, return_counts=True)
        held.append((keys, classes_of(w, first), counts))
        rows[0] += len(keys)
        if rows[0] > _FLUSH:
            held[:] = [merged()]
            rows[0] = len(held[0][0])
        return drain() if rows[0] > _FLUSH // 2 else None

    step.finish = lambda: [drain()]
    return step


def count_words(df: DataFrame) -> DataFrame:
    """(word, class, c) over the training documents; class END counts the ends."""
    train = id_text(df).where(fold() != 1).select("text")
    return map_texts(train, _count_words, _COUNT_SCHEMA).groupBy("word", "class").agg(F.sum("c").alias("c")).where("c > 0")


class Heavy:
    """The frequent words: sorted hashes with their counts and symbols. Symbols: 0 the end,
    1..CLASSES the spelling classes, then the most frequent words."""

    def __init__(self, words: np.ndarray, kinds: np.ndarray, counts: np.ndarray, vocabulary: int):
        by_count = np.lexsort((words, -counts))[:vocabulary]
        symbols = 1 + kinds.astype(np.int32)
        symbols[by_count] = 1 + CLASSES + np.arange(len(by_count))
        order = np.argsort(words)
        self.words, self.counts, self.symbols = words[order], counts[order], symbols[order]
        self.size = 1 + CLASSES + len(by_count)
        self.directory = Directory(self.words)

    def symbols_of(self, w: SpaceWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the texts one after the other, each with its end; where the words are among
        the frequent ones, and whether they are."""
        at, known = self.directory.found(w.hashes)
        out = np.zeros(len(w.owner) + len(w.counts), dtype=np.int64)
        own = self.symbols[at] if len(self.words) else np.zeros(len(at), dtype=np.int32)
        unknown = np.flatnonzero(~known)
        own[unknown] = 1 + classes_of(w, unknown)
        out[np.arange(len(w.owner)) + w.owner] = own
        return out, at, known


def vocabulary_size(tokens: int) -> int:
    """Words with a symbol of their own, for a number of training tokens."""
    return min(MOST_VOCABULARY, VOCABULARY + int(VOCABULARY_GROWTH * math.log2(max(1.0, tokens / 1e6))))


def contexts(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two back and one back, over sequences one after the other that each end with 0."""
    one = np.concatenate(([0], symbols[:-1]))
    two = np.concatenate(([0], one[:-1]))
    two[one == 0] = 0
    return two, one


_TRIPLES = T.StructType([T.StructField("key", T.LongType()), T.StructField("c", T.LongType())])


def count_triples(df: DataFrame, heavy: Heavy) -> DataFrame:
    """(key, c): how often each symbol follows each pair, over all training documents. The key is
    (two back * size + one back) * size + symbol."""
    sent = df.sparkSession.sparkContext.broadcast(heavy)

    def make():
        v = sent.value
        held: list[np.ndarray] = []
        tokens = [0]

        def drain():
            if not held:
                return [[], []]
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            tokens[0] = 0
            return [keys, c]

        def step(texts):
            s = v.symbols_of(SpaceWords(texts))[0]
            two, one = contexts(s)
            held.append((two * v.size + one) * v.size + s)
            tokens[0] += len(s)
            return drain() if tokens[0] > _FLUSH_TOKENS else None

        step.finish = lambda: [drain()]
        return step

    train = id_text(df).where(fold() != 1).select("text")
    return map_texts(train, make, _TRIPLES).groupBy("key").agg(F.sum("c").alias("c"))


def start(size: int, seed: int, freq: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Parameters r, q, c1, c2, b before training, their squared gradients, and the noise distribution."""
    rng = np.random.default_rng(seed)
    scale = 0.1
    r, q = rng.normal(0, scale, (size, DIMENSION)).astype(np.float32), rng.normal(0, scale, (size, DIMENSION)).astype(np.float32)
    c1, c2 = np.ones(DIMENSION, dtype=np.float32), np.full(DIMENSION, 0.5, dtype=np.float32)
    noise = (freq / freq.sum()).astype(np.float64)
    params = [r, q, c1, c2, np.log(noise).astype(np.float32)]
    return params, [np.full_like(p, 1e-6) for p in params], noise


def _move(p: np.ndarray, m: np.ndarray, g: np.ndarray) -> None:
    """A step against the gradient g, at a rate by its squares so far (m)."""
    m += g * g
    p -= np.float32(0.1) * g / np.sqrt(m)


def _move_rows(p: np.ndarray, m: np.ndarray, rows: np.ndarray, values: np.ndarray, scale: np.float32) -> None:
    """The same for rows of a parameter, each by the sum of its values; a row without any stays as it is.
    Two numbers are added as one complex one, which halves the additions (a row has an even number)."""
    by = rows.argsort(kind="stable")
    rows = rows.take(by)
    first = np.concatenate(([0], np.flatnonzero(rows[1:] != rows[:-1]) + 1))
    rows = rows.take(first)
    g = np.add.reduceat(values.take(by, axis=0).view(np.complex64), first, axis=0).view(np.float32)
    g *= scale
    now, squares = p.take(rows, axis=0), m.take(rows, axis=0)
    _move(now, squares, g)
    p[rows], m[rows] = now, squares


def descend(params: list, grow: list, noise: np.ndarray, rng, prev2: np.ndarray, prev1: np.ndarray, now: np.ndarray, weight: np.ndarray) -> None:
    """One epoch over weighted triples in random order; params and grow are changed in place.

    A batch touches the rows of its own symbols and of its noise alone. A symbol's bias, less its log
    noise, stands beside its output vector, against a 1 beside the context vector, so that
    scores, and gradients of both, are single products."""
    r, q, c1, c2, b = params
    m_r, m_q, m_c1, m_c2, m_b = grow
    size, width = q.shape
    total = len(now)
    log_k_noise = np.log(NOISE * noise).astype(np.float32)
    small = np.min_scalar_type(size)
    order = rng.permutation(total)
    prev2, prev1, now = (x.astype(small)[order] for x in (prev2, prev1, now))
    weight = weight[order]
    upto = noise.cumsum()
    fakes = (upto / upto[-1]).searchsorted(rng.random((-(-total // BATCH), NOISE)), side="right")

    def beside(vectors: np.ndarray, biases: np.ndarray, filled: float) -> np.ndarray:
        return np.concatenate((vectors, biases[:, None], np.full((size, 1 + width % 2), filled, dtype=np.float32)), axis=1)

    out, m_out = beside(q, b - log_k_noise, 0), beside(m_q, m_b, 1)
    most = min(BATCH, total)
    contexts_, steps, context_steps, scores = (np.zeros(x, dtype=np.float32) for x in ((most, out.shape[1]), (most + NOISE, out.shape[1]), (2 * most, width), (most, NOISE)))
    contexts_[:, width] = 1
    for lo, fake in zip(range(0, total, BATCH), fakes):
        w, x1, x2, times = (x[lo : lo + BATCH] for x in (now, prev1, prev2, weight))
        k = len(w)
        h, g_out, g_r, false = contexts_[:k], steps[: k + NOISE], context_steps[: 2 * k], scores[:k]
        r1, r2, true, noisy = r.take(x1, axis=0), r.take(x2, axis=0), out.take(w, axis=0), out.take(fake, axis=0)
        np.add(np.multiply(r1, c1, out=g_r[:k]), np.multiply(r2, c2, out=g_r[k:]), out=h[:, :width])
        # gradients of the loss by the scores
        g_true = (-times / (1 + np.exp(np.einsum("ij,ij->i", h, true))))[:, None]
        np.exp(np.matmul(h, -noisy.T, out=false), out=false)
        false += 1
        np.divide(times[:, None], false, out=false)
        n = np.float32(1 / k)
        gh = false @ noisy[:, :width]
        gh += g_true * true[:, :width]
        np.multiply(g_true, h, out=g_out[:k])
        np.matmul(false.T, h, out=g_out[k:])
        np.multiply(gh, c1, out=g_r[:k])
        np.multiply(gh, c2, out=g_r[k:])
        g_c1, g_c2 = (np.einsum("ij,ij->j", gh, x) * n for x in (r1, r2))
        _move_rows(r, m_r, np.concatenate((x1, x2)), g_r, n)
        _move_rows(out, m_out, np.concatenate((w, fake.astype(small))), g_out, n)
        _move(c1, m_c1, g_c1)
        _move(c2, m_c2, g_c2)
    q[:], b[:], m_q[:], m_b[:] = out[:, :width], out[:, width] + log_k_noise, m_out[:, :width], m_out[:, width]


def _named(params: list[np.ndarray]) -> dict[str, np.ndarray]:
    return dict(zip(("r", "q", "c1", "c2", "b"), params))


def train(sequences: list[np.ndarray], size: int, seed: int = 5, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Noise-contrastive estimation of a log-bilinear model over two context symbols."""
    freq = np.ones(size)
    for s in sequences:
        freq += np.bincount(s, minlength=size)
    params, grow, noise = start(size, seed, freq)
    if sequences:
        now = np.concatenate(sequences)
        two, one = contexts(now)
        rng = np.random.default_rng(seed + 1)
        for _ in range(epochs):
            descend(params, grow, noise, rng, two, one, now, np.ones(len(now), dtype=np.float32))
    return _named(params)


_MODELS = T.StructType([T.StructField("part", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("state", T.BinaryType())])


_PACKED = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("run", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()),
])


def _packed(table: pa.Table) -> pa.Table:
    """A group's triples in order of their keys, PACKED_ROWS to a row: sorted once, and cheap to shuffle in each epoch."""
    part, key, c = (table.column(x).to_numpy() for x in ("part", "key", "c"))
    order = np.argsort(key)  # the same model whatever order the rows come in
    key, c = key[order], c[order]
    runs = range(0, len(key), PACKED_ROWS)
    keys, counts = (pa.array([x[lo : lo + PACKED_ROWS].tobytes() for lo in runs], pa.binary()) for x in (key, c))
    return pa.table({"part": pa.array(part[: len(runs)], pa.int64()), "run": pa.array(range(len(runs)), pa.int32()), "keys": keys, "counts": counts})


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    """The keys and counts of a group, in order."""
    order = np.argsort(table.column("run").to_numpy())
    return [np.frombuffer(b"".join(map(table.column(x).to_pylist().__getitem__, order)), dtype=np.int64) for x in ("keys", "counts")]


def train_counts(triples: DataFrame, size: int, seed: int = 5, epochs: int = EPOCHS) -> tuple[dict[str, np.ndarray], int]:
    """The model of a whole table of triples, and the number of tokens it was trained on."""
    freq, rows, tokens = np.ones(size), 0, 0
    for r in triples.groupBy((F.col("key") % size).alias("symbol")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        freq[r.symbol] += r.c
        rows, tokens = rows + r.n, tokens + r.c
    params, grow, noise = start(size, seed, freq)
    if not rows:
        return _named(params), 0
    shapes, share = [p.shape for p in params], tokens / rows
    cuts = np.cumsum([p.size for p in params + grow])[:-1]
    parts = triples.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(-(-rows // GROUP_ROWS))))
    packed = materialise(parts.groupBy("part").applyInArrow(_packed, _PACKED), "packed-triples")
    sc = triples.sparkSession.sparkContext

    def one_epoch(epoch: int, sent):
        def run(table):
            part, (key, c) = table.column("part"), _unpacked(table)
            copies = np.ceil(c / share).astype(np.int64)
            weight = np.repeat((c / copies / share).astype(np.float32), copies)
            key = np.repeat(key, copies)
            flat = [x.copy().reshape(s) for x, s in zip(np.split(sent.value, cuts), shapes * 2)]
            rng = np.random.default_rng([seed, epoch, part[0].as_py()])
            descend(flat[:5], flat[5:], noise, rng, key // size // size, key // size % size, key % size, weight)
            state = np.concatenate([x.ravel() for x in flat]).tobytes()
            return pa.table({"part": part.slice(0, 1), "weight": pa.array([float(c.sum())]), "state": pa.array([state], pa.binary())})

        return run

    for epoch in range(epochs):
        sent = sc.broadcast(np.concatenate([x.ravel() for x in params + grow]))
        models = materialise(packed.groupBy("part").applyInArrow(one_epoch(epoch, sent), _MODELS), "models")
        total, mean = 0.0, np.zeros(cuts[-1] + grow[-1].size)
        for m in models.orderBy("part").toLocalIterator():
            total += m.weight
            mean += m.weight * np.frombuffer(m.state, dtype=np.float32)
        state = [x.astype(np.float32).reshape(s) for x, s in zip(np.split(mean / total, cuts), shapes * 2)]
        params, grow = state[:5], state[5:]
        sent.unpersist()
    return _named(params), tokens


def tables(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Scores of a symbol by each context symbol, and the log normaliser of every context pair,
    from batched matrix products."""
    r, q, b = model["r"], model["q"], model["b"]
    one, two = (r * model["c1"]) @ q.T + b, (r * model["c2"]) @ q.T
    size = len(b)
    z = np.empty((size, size), dtype=np.float32)  # by the symbol two back, then one back
    e_one = np.exp(one.T - one.max(1))
    for lo in range(0, size, 64):
        part = two[lo : lo + 64]
        top = part.max(1, keepdims=True)
        z[lo : lo + 64] = np.log(np.maximum(np.exp(part - top) @ e_one, 1e-30)) + top + one.max(1)
    return {"one": one.astype(np.float32), "two": two.astype(np.float32), "z": z}


def log10_probabilities(t: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of every symbol of sequences that each end with 0."""
    p2, p1 = contexts(symbols)
    return (t["one"][p1, symbols] + t["two"][p2, symbols] - t["z"][p2, p1]) / math.log(10)


def fit(df: DataFrame, counts: DataFrame) -> dict:
    """Counts the workers need, corpus totals and the trained tables."""
    word = F.col("class") != END
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(~word, F.col("c"))).alias("ends")).first()
    n, v = int(total.n or 0), int(total.v)
    # the least count that leaves at most HEAVY words: counts in steps of an eighth of a doubling
    level = F.floor(8 * F.log2(F.col("c")))
    by_level = sorted(((r.level, r.words) for r in counts.where(word).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, taken = float("inf"), 0
    for at, words in by_level:
        if taken + words > HEAVY:
            break
        least, taken = at, taken + words
    got = counts.where(word & (level >= F.lit(least))).select("word", "class", "c").toArrow()
    heavy = Heavy(got["word"].to_numpy().view(np.uint64), got["class"].to_numpy(), got["c"].to_numpy(), vocabulary_size(n))
    outside = np.full(CLASSES, 0.5)  # half a count for unseen words of the class
    for r in counts.where(word).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        outside[r["class"]] += r.c + 0.5 * r.v
    inside = heavy.symbols > CLASSES
    kinds = dict(zip(got["word"].to_numpy().view(np.uint64).tolist(), got["class"].to_numpy().tolist()))
    for w, c in zip(heavy.words[inside].tolist(), heavy.counts[inside].tolist()):
        outside[kinds[w]] -= c + 0.5
    trained, trained_tokens = train_counts(materialise(count_triples(df, heavy), "triples"), heavy.size)
    return {"n": n, "v": v, "ends": int(total.ends or 0), "heavy": heavy, "outside": np.log10(np.maximum(outside, 0.5)), "model": tables(trained), "trained_tokens": trained_tokens}


_ROWS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("lm", T.DoubleType()),
    T.StructField("word", T.LongType()), T.StructField("times", T.LongType()),
])


def _stacked(above: Sequence, below: Sequence) -> list[pa.Array]:
    """Columns of rows above rows; a number stands for so many nulls."""
    pair = lambda x, other: pa.nulls(x, other.type) if isinstance(x, int) else x
    arrow = [[x if isinstance(x, int) else pa.array(x) for x in xs] for xs in zip(above, below)]
    return [pa.concat_arrays([pair(x, y), pair(y, x)]) for x, y in arrow]


def score(df: DataFrame) -> DataFrame:
    """held_out, token counts, base score and model score of every document."""
    counts = materialise(count_words(df), "word-counts")
    fitted = fit(df, counts)
    n, v = fitted["n"], fitted["v"]
    sent = df.sparkSession.sparkContext.broadcast(fitted)

    def make():
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        f = sent.value
        heavy, outside, model = f["heavy"], f["outside"], f["model"]
        unit = math.log10(f["n"] + 0.5 * (f["v"] + 1))
        end = math.log10(f["ends"] + 0.5)
        logs = np.log10(heavy.counts + 0.5)
        seen = [0]

        def step(ids, held, texts):
            w = SpaceWords(texts)
            size = len(texts)
            row = (task << 40) + seen[0] + np.arange(size)
            seen[0] += size
            symbols, at, known = heavy.symbols_of(w)
            log = np.zeros(len(w.owner))
            log[known] = logs[at[known]]
            tokens = w.counts + 1
            base = np.bincount(w.owner, log, size) + end - tokens * unit
            n_known = np.bincount(w.owner, known, size).astype(np.int64) + (f["ends"] > 0)
            # a word outside the vocabulary: its class, then its share of the class
            lm = np.add.reduceat(log10_probabilities(model, symbols).astype(np.float64), np.cumsum(tokens) - tokens)
            own = symbols[np.arange(len(w.owner)) + w.owner]
            out = own <= CLASSES
            lm += np.bincount(w.owner[out], log[out] - outside[own[out] - 1], size)
            # words whose counts come by the join
            rest, owner = w.hashes[~known], w.owner[~known]
            order = np.lexsort((rest, owner))
            rest, owner = rest[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])))) if len(rest) else np.zeros(0, dtype=np.int64)
            k = len(first)
            times = np.diff(np.append(first, len(rest)))
            docs = (row, pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), tokens, n_known, base, lm, size, size)
            return _stacked(docs, (row[owner[first]], k, k, k, k, k, k, rest[first].view(np.int64), times))

        return step

    table = materialise(map_texts(id_text(df).withColumn("held_out", fold() == 1).select("doc_id", "held_out", "text"), make, _ROWS), "scored")
    light = table.where(F.col("word").isNotNull()).select("row", "word", "times").join(counts.where(F.col("class") != END).select("word", "c"), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")
    light = light.groupBy("row").agg(F.sum(log).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    out = table.where(F.col("word").isNull()).join(light, "row", "left")
    rest = F.coalesce("rest", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"), (F.col("lm") + rest).alias("score"),
    )


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
