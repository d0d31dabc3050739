"""Rules, decontamination and the Jaccard join against brute force and edge cases."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factspan.llm import decontaminate, ngram_join, rules

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
WORD = "[^\\x20\\x09-\\x0D]+"
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a b c a b c a b c"), (5, "a a a a a a"), (6, "one two"), (7, "One TWO"), (8, "x" * 50_000), (9, "É é   z\nÉ é   z\n\nz"),
    (None, "one two"), (10, "same row of words here"), (10, "same row of words here"), (11, "w " * 3000), (12, "# $ % & | < > *"),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA + ", words string, n int")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def plain_counts(text):
    words = re.findall(WORD, text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rule_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").union(frame(spark).select("doc_id", "text"))
    rows = docs.collect()
    got = Counter(tuple(r) for r in rules.judge(docs).select("doc_id", *rules.COUNTS[:5], "base_failed").collect())
    want = Counter()
    for r in rows:
        c = plain_counts(r.text)
        want[(r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_are_exact_whatever_the_hashes(spark, monkeypatch):
    monkeypatch.setattr(rules, "_hashed", lambda *words: F.shiftleft(F.xxhash64(*words) % 5, 40))
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) for n, k in ((0, 1), (3, 9), (60, 4), (400, 12), (900, 10**9))] + ["a b c d a b c d"]
    got = rules.measure(frame(spark, list(enumerate(texts)))).select("doc_id", "n_repeat_words").collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: plain_counts(t)[-1] for i, t in enumerate(texts)}


def test_rules_weigh_votes_by_the_posterior_of_the_model(spark):
    """kept, document by document, from plain expectation-maximisation over single documents."""
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    voted = rules.measure(df).select("doc_id", *(v.alias(k) for k, v in rules.votes().items())).collect()
    names = list(rules.votes())
    v = {r.doc_id: [r[k] for k in names] for r in voted}
    good = {i: 0.97 * 0.35 ** sum(x < 0 for x in vs) for i, vs in v.items()}
    for _ in range(rules.ROUNDS):
        prior = (sum(good.values()) + 1) / (len(v) + 2)
        prior = min(0.99, max(0.01, prior))
        acc = []
        for j in range(len(names)):
            cast = [(good[i], vs[j]) for i, vs in v.items() if vs[j]]
            a = (sum(g for g, x in cast if x > 0) + 9) / (sum(g for g, _ in cast) + 10)
            b = (sum(1 - g for g, x in cast if x < 0) + 3) / (sum(1 - g for g, _ in cast) + 10)
            a = min(0.999, max(0.6, a))
            acc.append((a, max(1 - a, min(0.99, max(0.02, b)))))
        for i, vs in v.items():
            p, q = prior, 1 - prior
            for (a, b), x in zip(acc, vs):
                p *= a if x > 0 else 1 - a if x < 0 else 1
                q *= 1 - b if x > 0 else b if x < 0 else 1
            good[i] = p / (p + q)
    got = rules.judge(df).collect()
    assert all(abs(r.posterior - good[r.doc_id]) < 1e-6 and r.kept == (not r.base_failed and good[r.doc_id] >= 0.5) for r in got)


def test_rule_accuracies_are_learnt():
    rng = random.Random(1)
    true = [(0.97, 0.7), (0.95, 0.6), (0.96, 0.5), (0.9, 0.6)]
    seen = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        seen[tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a[not good]) == good else -1) for a in true)] += 1
    prior, got = rules.estimate(sorted(seen.items()))
    assert abs(prior - 0.8) < 0.06 and all(abs(x - y) < 0.08 for a, b in zip(got, true) for x, y in zip(a, b))
    assert rules.posterior((1, 1, 1, 1), prior, got) > 0.95 > 0.2 > rules.posterior((-1, -1, 0, 0), prior, got)
    assert rules.estimate([]) == (0.5, [])


def test_rules_keep_clean_and_drop_junk(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = rules.judge(rows).join(rows.select("doc_id", "quality"), "doc_id").where("n_words >= 50").select("kept", "quality").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def plain_hits(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    bench = {}
    for i, t in items:
        w = split(t)
        if w and i is not None:
            k = min(13, len(w))
            bench.setdefault(str(i), set()).update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    out = Counter()
    for i, t in docs:
        w, hit, found = split(t), set(), []
        for item, windows in sorted(bench.items()):
            at = [j for win in windows for j in range(len(w) - len(win) + 1) if tuple(w[j : j + len(win)]) == win]
            if at:
                found.append(item)
            for win in windows:
                for j in range(len(w) - len(win) + 1):
                    if tuple(w[j : j + len(win)]) == win:
                        hit.update(range(j, j + len(win)))
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([13, 14, 20, 40, 90, 5, 1, 12, 13, 2])] + [(5, say(5)), (None, say(20)), (20, None), (21, ""), (22, "the the " * 15), (3, say(30))]
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            lo = rng.randint(0, max(0, len(w) - 13))
            parts += [" ".join(w[lo : lo + rng.choice([5, 12, 13, 14, 90])]), say(rng.randint(0, 9))]
        docs.append((i, rng.choice([" ", ", ", "-\n"]).join(parts).title()))
    docs += [(70, None), (71, ""), (72, "the " * 200), (None, items[3][1]), (5, docs[5][1]), (73, "Ä" + items[2][1])]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], SCHEMA + ", place int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = decontaminate.hits(d, b).drop("row").collect()
    assert Counter(tuple(r) for r in got) == plain_hits(docs, items)
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not r.contaminated for r in got)


def test_decontamination_of_periodic_text(spark):
    """Repeated words, lines and alternations on both sides, broken at random places."""
    rng = random.Random(12)

    def periodic(n):
        motif = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 7]))]
        w = [motif[k % len(motif)] for k in range(n)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(n)] = rng.choice("abcx")
        return " ".join(w)

    items = [(i, periodic(rng.choice([1, 2, 12, 13, 20, 60, 150]))) for i in range(25)]
    docs = [(i, " ".join(periodic(rng.randint(5, 120)) for _ in range(rng.randint(1, 3)))) for i in range(60)]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontaminate.hits(d, b).drop("row").collect()) == plain_hits(docs, items)


def test_decontamination_is_linear_in_a_repeated_word(spark):
    docs = spark.createDataFrame([(i, "same " * 5000) for i in range(4)] + [(4, "a b " * 2500)], SCHEMA)
    b = spark.createDataFrame([(1, "same " * 5000), (2, "a b " * 2500), (3, "same same")], "item_id long, text string")
    decontaminate.hits(docs.limit(1), b).count()
    began = time.time()
    got = decontaminate.hits(docs, b).collect()
    assert {(r.n_hit, r.n_items) for r in got} == {(5000, 2), (5000, 1)} and time.time() - began < 60


def test_decontamination_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(none, items).count() == 0
    got = decontaminate.hits(frame(spark), items).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)


def shingles(text):
    w = re.findall(WORD, lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(sets))


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("long_list", [4096, 4])
def test_jaccard_classes_match_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(ngram_join, "LONG_LIST", long_list)
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for share in [0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06]:
            docs.append((len(docs) * 7 % 101, " ".join(edited(rng, base, share))))
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    docs += [(200 + i, f"{common} {' '.join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))}") for i in range(25)]
    docs += ODD + [(300, "one  two "), (301, "two one"), (302, "W " * 2000)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], SCHEMA + ", node int, n int")
    assert Counter(tuple(r) for r in ngram_join.join_classes(df).collect()) == plain_classes(docs)


def test_jaccard_sets_that_share_much_but_not_enough(spark):
    """Every document shares 82 of its 100 shingles with all others; the work is linear in them."""
    common = " ".join(f"c{i}" for i in range(86))

    def took(n):
        docs = spark.createDataFrame([(i, common + " " + " ".join(f"u{i}x{j}" for j in range(18))) for i in range(n)] + [(n, "alone here " * 9)], SCHEMA).repartition(8)
        began = time.perf_counter()
        got = ngram_join.join_classes(docs).collect()
        assert all(r.component_id == r.doc_id and (r.n_shingles == 100 or r.doc_id == n) for r in got)
        return time.perf_counter() - began

    took(100)
    assert took(8000) < 4 * took(2000)


def test_keep_first_keeps_any_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, {"k": 1}), (2, "a b c d e f", 1, 2, None), (1, "a b", 1, 2, None), (None, "x", 0, 0, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", _own0 int, _n int, m map<string,int>")
    got = ngram_join.keep_first(df)
    assert got.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "x"), (1, "a b c d e f")]
    assert decontaminate.drop_contaminated(df, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 1


def test_jaccard_empty_and_chains(spark):
    assert ngram_join.join_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(50)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert len(got) == 351 and {r for n, r in got.items() if n < 900} == {0} and {r for n, r in got.items() if n > 900} == {1000}
