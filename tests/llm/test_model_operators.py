"""Weak-label quality, preference formatting and language-model scoring."""

import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factspan.llm import lbl, preferences, weak_quality
from factspan.llm.common import materialise
from factspan.llm.words import Directory, SpaceWords

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "x" * 50_000), (None, "no id here"), (5, "same row"), (5, "same row"), (6, "The THE the ÉÉ é.   a\u0085b")]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA + ", word string, c int")


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    got = {r.doc_id: r for r in weak_quality.classify(docs).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    good = [got[i].kept for i, q in labels.items() if q]
    bad = [got[i].kept for i, q in labels.items() if not q]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def plain_quality(rows, posteriors):
    """Scores by logistic regression with dictionaries, one document after the other."""
    docs = []
    for (_, text), p in zip(rows, posteriors):
        words = (text or "").split()
        if words:
            share = {}
            for w in words:
                for b in weak_quality.buckets(w):
                    share[b] = share.get(b, 0) + 1 / len(words)
            docs.append((share, sum(a == b for a, b in zip(words, words[1:])) / len(words), p))
    held = {}
    for share, _, _ in docs:
        for b in share:
            held[b] = held.get(b, 0) + 1
    up, down = sum(p for *_, p in docs), sum(1 - p for *_, p in docs)
    w, squares, tail, tails = dict.fromkeys(held, 0.0), dict.fromkeys(held, 1e-8), [0.0, 0.0], [1e-8, 1e-8]
    for _ in range(weak_quality.STEPS):
        g, gt = {b: 1e-5 * x for b, x in w.items()}, [0.0, 0.0]
        for share, stutter, p in docs:
            z = sum(x * w[b] for b, x in share.items()) + tail[0] + tail[1] * stutter
            err = (1 / (1 + math.exp(-z)) - p) * (p / max(up, 1) + (1 - p) / max(down, 1))
            for b, x in share.items():
                g[b] += x * err
            gt = [gt[0] + err, gt[1] + err * stutter]
        for b, x in g.items():
            if held[b] >= 3:
                squares[b] += x * x
                w[b] -= 0.5 * x / math.sqrt(squares[b])
        for k in (0, 1):
            tails[k] += gt[k] ** 2
            tail[k] -= 0.5 * gt[k] / math.sqrt(tails[k])
    out = []
    for _, text in rows:
        words = (text or "").split()
        z = sum(w.get(b, 0.0) for x in words for b in weak_quality.buckets(x)) / max(len(words), 1) + tail[0] + (tail[1] * sum(map(str.__eq__, words, words[1:])) / len(words) if words else 0)
        out.append(1 / (1 + math.exp(-z)) if words else 0.0)
    return out


def test_quality_matches_plain_computation(spark):
    from factspan.llm import rules

    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60").select("doc_id", "text").union(spark.createDataFrame([(900, None), (901, "  "), (902, "a a a b")], SCHEMA)).coalesce(2)
    cast = rules.measure(docs).select("doc_id", F.struct(*(v.alias(k) for k, v in rules.votes().items())).alias("v")).collect()
    votes = {r.doc_id: tuple(r.v) for r in cast}
    patterns = {}
    for v in votes.values():
        patterns[v] = patterns.get(v, 0) + 1
    prior, accuracy = rules.estimate(sorted(patterns.items()))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_quality(rows, [rules.posterior(votes[i], prior, accuracy) for i, _ in rows])
    got = {r.doc_id: r for r in weak_quality.classify(docs).collect()}
    for (i, text), score in zip(rows, want):
        assert abs(got[i].score - score) < 2e-3 and got[i].n_words == len((text or "").split())
        assert got[i].kept == (got[i].n_words > 0 and got[i].score >= 0.5)


def test_quality_edge_cases(spark):
    got = weak_quality.classify(frame(spark)).collect()
    assert len(got) == len(ODD)
    assert all(r.score == 0 and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert weak_quality.classify(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = [n, "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in chosen[:n])]
    for rest in (chosen[n:], rejected[n:]):
        text, spans = "", []
        for r, t in rest:
            text += f"<|im_start|>{r}\n"
            at = len(text)
            text += f"{t}<|im_end|>\n"
            if r == "assistant":
                spans.append(f"{at}:{len(text)}")
        out += [text, ",".join(spans)]
    return tuple(out)


def conversations():
    rng = random.Random(2)
    rows = []
    for k in range(60):
        shared = [(rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "é\n", None, "a <|im_end|> b", ""])) for _ in range(rng.randint(0, 4))]
        for side in (0, 1):
            if rng.random() < 0.9:
                turns = shared + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "ü" * 5])) for _ in range(rng.randint(0, 3))]
                rows += [(2 * k + side, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    return rows + [(None, 0, "user", "lost", "x"), (0, 0, "user", "again", "x"), (0, 0, "user", "again", "x"), (999, 0, "user", "alone", "x")]


def test_preferences_match_brute_force_and_oracle(spark, tmp_path):
    rows = conversations()
    safe = lambda x: (x or "").replace("<|", "< |")
    by = {}
    for c, i, r, t, _ in rows:
        if c is not None:
            by.setdefault(c, []).append((i, safe(r), safe(t)))
    plain = {c: [(r, t) for _, r, t in sorted(v)] for c, v in by.items()}
    want = {c // 2: plain_pair(plain[c], plain[c + 1]) for c in plain if c % 2 == 0 and c + 1 in plain}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prefix string")
    got = preferences.format_pairs(preferences.pair_neighbours(df)).collect()
    assert {r.pair_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    con = duckdb.connect()
    df.write.parquet(str(tmp_path / "c"))
    con.sql(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.sql(preferences.ORACLE).fetchall()} == want
    assert preferences.format_pairs(preferences.pair_neighbours(df.limit(0))).count() == 0


@pytest.fixture
def small_heavy(monkeypatch):
    """So few heavy words that both ways of looking counts up are taken."""
    monkeypatch.setattr(lbl, "HEAVY", 200)
    monkeypatch.setattr(lbl, "VOCABULARY", 64)
    monkeypatch.setattr(lbl, "VOCABULARY_GROWTH", 0)


def test_base_score_matches_brute_force(spark, small_heavy):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(frame(spark).select("doc_id", "text"))
    rows = docs.collect()
    words = lambda t: re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    counts = Counter()
    for r in rows:
        if fold(r.doc_id) != 1:
            counts.update([*words(r.text), None])
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        tokens = [*words(r.text), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        want[(r.doc_id, fold(r.doc_id) == 1, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6))] += 1
    got = lbl.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_normalised_and_uses_context():
    rng = np.random.default_rng(0)
    seqs = []
    for _ in range(300):  # symbol x is followed by x + 1
        s = [int(rng.integers(1, 12))]
        while s[-1] < 12:
            s.append(s[-1] + 1 if rng.random() < 0.9 else int(rng.integers(1, 13)))
        seqs.append(np.array(s + [0]))
    t = lbl.tables(lbl.train(seqs, 14, epochs=40))
    for a, b in ((0, 0), (3, 4), (13, 2)):
        p = np.exp(t["one"][b].astype(float) + t["two"][a] - t["z"][a, b])
        assert abs(p.sum() - 1) < 1e-4
    assert lbl.log10_probabilities(t, np.array([4, 5, 6, 0])).sum() > lbl.log10_probabilities(t, np.array([6, 4, 5, 0])).sum() + 1


def test_scoring_edge_cases(spark):
    assert lbl.score(spark.createDataFrame([], SCHEMA)).count() == 0
    got = lbl.score(spark.createDataFrame([(i, "only held out") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], SCHEMA)).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 and math.isfinite(r.score) for r in got)


def test_model_is_trained_on_every_training_token(spark, monkeypatch):
    """More training documents than any sample of 8,000, in several groups: every triple is counted and used."""
    monkeypatch.setattr(lbl, "GROUP_ROWS", 40)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "Dd", "x9"]) for _ in range(i % 4))) for i in range(12_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = lbl.fit(df, lbl.count_words(df))
    v = fitted["heavy"]
    want = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            s = [0, 0, *v.symbols_of(SpaceWords([t]))[0].tolist()]
            want.update((a * v.size + b) * v.size + c for a, b, c in zip(s, s[1:], s[2:]))
    triples = lbl.count_triples(df, v)
    assert {r.key: r.c for r in triples.collect()} == want
    assert fitted["trained_tokens"] == fitted["n"] == sum(want.values())
    again = lbl.train_counts(triples.repartition(7), v.size)[0]
    assert all(np.array_equal(x, y) for x, y in zip(again.values(), lbl.train_counts(triples, v.size)[0].values()))


def plain_mix(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * factor % 2**64
    return h ^ (h >> 33)


def plain_class(word):
    last = word[-1]
    mark = 0 if last in ".!?" else 1 if last in ",;:" else 2
    raw = (word[:-1] if mark < 2 else word).encode()
    one, two = (raw[-k] if len(raw) >= k else 0 for k in (1, 2))
    spelling = 7 if mark == 2 and last.isascii() and not last.isalpha() else 2 * mark + (not word.isascii())
    spelling = 6 if any(c in "0123456789" for c in word) else spelling
    return spelling * lbl.ENDINGS + plain_mix(257 * one + two) % lbl.ENDINGS


def test_scores_match_brute_force(spark, small_heavy):
    """Every token by its own softmax over all symbols, and its share of the class outside the vocabulary."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).union(frame(spark).select("doc_id", "text"))
    rows = docs.collect()
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = lbl.count_words(docs)
    fitted = lbl.fit(docs, counts)
    table, m = fitted["model"], {}
    split = lambda t: re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    times = Counter(w for r in rows if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 1 for w in split(r.text))
    known = dict(zip(fitted["heavy"].words.tolist(), fitted["heavy"].symbols.tolist()))
    symbol = {w: known.get(int(SpaceWords([w]).hashes[0]), 1 + plain_class(w)) for w in {w for r in rows for w in split(r.text)}}
    assert all(symbol[w] > lbl.CLASSES or symbol[w] == 1 + plain_class(w) for w in symbol) and sum(x > lbl.CLASSES for x in symbol.values()) == 64
    share = Counter()
    for w, c in times.items():
        if symbol[w] <= lbl.CLASSES:
            share[symbol[w]] += c + 0.5
    want = Counter()
    for r in rows:
        total, two, one = 0.0, 0, 0
        for w in [*split(r.text), None]:
            s = symbol[w] if w else 0
            if (two, one) not in m:
                z = table["one"][one].astype(float) + table["two"][two]
                m[two, one] = z - math.log(np.exp(z).sum())
            total += m[two, one][s] / math.log(10)
            if 0 < s <= lbl.CLASSES:
                total += math.log10((times[w] + 0.5) / (share[s] + 0.5))
            two, one = one, s
        want[r.doc_id, round(total, 1)] += 1
    again = lbl.score(docs).collect()
    assert Counter((r.doc_id, round(r.score, 1)) for r in again) == want


def test_clashing_columns_do_not_reach_the_model(spark):
    rows = [(1, "a b", 5, "x", 2), (2, None, None, None, None)]
    got = lbl.score(spark.createDataFrame(rows, SCHEMA + ", word long, row string, times int")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_vocabulary_grows_with_the_corpus():
    assert lbl.vocabulary_size(0) == lbl.VOCABULARY < lbl.vocabulary_size(10**8) < lbl.vocabulary_size(10**9) < lbl.vocabulary_size(10**13) == lbl.MOST_VOCABULARY


def plain_descent(params, grow, noise, rng, prev2, prev1, now, weight):
    """An epoch with gradients over all rows of all parameters."""
    r, q, c1, c2, b = params
    log_k_noise = np.log(lbl.NOISE * noise).astype(np.float32)
    order = rng.permutation(len(now))
    lane = np.arange(lbl.DIMENSION)

    def gathered(rows, values):
        return np.bincount((rows[:, None] * lbl.DIMENSION + lane).ravel(), values.ravel(), r.size).astype(np.float32).reshape(r.shape)

    for lo in range(0, len(order), lbl.BATCH):
        at = order[lo : lo + lbl.BATCH]
        w, x1, x2, times = now[at], prev1[at], prev2[at], weight[at]
        fake = rng.choice(len(b), lbl.NOISE, p=noise)
        h = r[x1] * c1 + r[x2] * c2
        g_true = times * (1 / (1 + np.exp(-((h * q[w]).sum(1) + b[w] - log_k_noise[w]))) - 1)
        g_false = times[:, None] / (1 + np.exp(-(h @ q[fake].T + b[fake] - log_k_noise[fake])))
        gh = g_true[:, None] * q[w] + g_false @ q[fake]
        gq = gathered(np.concatenate((w, fake)), np.concatenate((g_true[:, None] * h, g_false.T @ h)))
        gb = np.bincount(np.concatenate((w, fake)), np.concatenate((g_true, g_false.sum(0))), len(b)).astype(np.float32)
        gr = gathered(np.concatenate((x1, x2)), np.concatenate((gh * c1, gh * c2)))
        for p, g, m in zip(params, (gr, gq, (gh * r[x1]).sum(0), (gh * r[x2]).sum(0), gb), grow):
            g = g * np.float32(1 / len(at))
            m += g * g
            p -= np.float32(0.1) * g / np.sqrt(m)


@pytest.mark.parametrize("size,rows", [(900, 300), (1900, 40 * 1024 + 77)])
def test_descent_touches_the_rows_of_a_batch_alone(size, rows):
    """The same parameters as by gradients over all rows; a long epoch takes at most nine tenths of the time."""
    rng = np.random.default_rng(0)
    x2, x1, now = (np.minimum(rng.zipf(1.4, rows) - 1, size - 1) for _ in range(3))
    weight = rng.choice([0.5, 1.0], rows).astype(np.float32)
    freq, took, states = np.ones(size) + np.bincount(now, minlength=size), {}, {}
    for f in (plain_descent, lbl.descend) * 3:
        params, grow, noise = lbl.start(size, 5, freq)
        began = time.process_time()
        f(params, grow, noise, np.random.default_rng(3), x2, x1, now, weight)
        took[f], states[f] = min(took.get(f, math.inf), time.process_time() - began), params + grow
    for want, got in zip(states[plain_descent], states[lbl.descend]):
        assert want.shape == got.shape and np.allclose(want, got, rtol=1e-3, atol=1e-4)
    assert rows < 1024 or took[lbl.descend] < 0.9 * took[plain_descent]


def test_epochs_read_packed_rows(spark, monkeypatch):
    """Triples are grouped and sorted once; each epoch shuffles a row for many of them."""
    made = {}
    monkeypatch.setattr(lbl, "materialise", lambda df, name: made.setdefault(name, materialise(df, name)) if name != "models" else materialise(df, name))
    monkeypatch.setattr(lbl, "GROUP_ROWS", 500)
    monkeypatch.setattr(lbl, "PACKED_ROWS", 64)
    keys = np.random.default_rng(1).permutation(20**3)[:1500].tolist()
    triples = spark.createDataFrame([(k, 1 + k % 7) for k in keys], "key long, c long")
    assert lbl.train_counts(triples, 20)[1] == sum(1 + k % 7 for k in keys)
    rows = made["packed-triples"].collect()
    assert {r.part for r in rows} == {0, 1, 2} and len(rows) <= 1500 // 64 + 3
    got = [(k, c) for r in rows for k, c in zip(np.frombuffer(r.keys, dtype=np.int64).tolist(), np.frombuffer(r["counts"], dtype=np.int64).tolist())]
    assert sorted(got) == sorted((k, 1 + k % 7) for k in keys)


def test_directory_finds_what_a_search_finds():
    rng = np.random.default_rng(2)
    spread = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    crowded = np.unique(rng.integers(0, 1 << 20, 5000, dtype=np.uint64))
    for table in (spread, crowded, crowded[:1], crowded[:0], np.array([0, (1 << 64) - 1], dtype=np.uint64)):
        keys = np.concatenate((table, table + np.uint64(1), np.array([0, 5, (1 << 64) - 1], dtype=np.uint64)))
        at, known = Directory(table).found(keys)
        assert known.tolist() == np.isin(keys, table).tolist() and (not len(table) or (table[at[known]] == keys[known]).all())


def test_classes_of_some_words_are_those_of_all():
    w = SpaceWords(["Ab1 céd. x, ééé *** 77", None, "the end?"])
    every = lbl.classes_of(w)
    assert every.tolist() == [plain_class(x) for x in "ab1 céd. x, ééé *** 77 the end?".split()]
    for which in ([], [4, 1], [7, 0, 3]):
        assert lbl.classes_of(w, np.array(which, dtype=np.int64)).tolist() == every[which].tolist()
