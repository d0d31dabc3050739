"""Quality rules by weak supervision, in DataFrame functions alone.

Rules look at whole texts and vote good (1), bad (-1) or abstain (0). The votes of all documents
are counted by pattern (at most 3**10 patterns whatever the corpus), expectation-maximisation
over those counts estimates every rule's accuracy and the share of good documents, and the
posterior probability of good decides, in place of all rules having to pass. A document that
fails the two fixed base conditions is never kept.

Repeated words are found inside the row: hashes of the three-word windows are sorted with their
position in the low bits, so equal windows become neighbours. Windows that have such a neighbour
are then sorted by their words, and only equal words count: the result is exact whatever the
hashes. The space is linear in the text and nothing is exploded or shuffled.

Defined results: null text, or one without words, has zeros and fails the base; null ids keep
their row; repeated rows each get the same result; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.llm.common import documents, id_text, materialise

ROUNDS = 50
LEAST = 0.5
#: Accuracies an estimate may take on good and on bad documents: no rule is trusted blindly, and
#: one that flags many good documents loses its say.
ON_GOOD, ON_BAD = (0.6, 0.999), (0.02, 0.99)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops", "n_shouts", "n_odd", "n_runs", "n_stutter")


def _hashed(*words: Column) -> Column:
    return F.xxhash64(*words)


def measure(df: DataFrame, exact: bool = True) -> DataFrame:
    """doc_id and the counts the rules look at. Votes only compare shares, so for them repeated
    windows may be told by their hashes alone (exact=False); n_repeat_words is then an estimate."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = id_text(df).select("doc_id", text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    d = d.withColumn("n", F.size("words"))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # (hash, position): the low bits, as many as positions need, hold the position
    bits = F.length(F.bin(F.col("n").cast("long")))
    window = F.transform("words", lambda x, i: _hashed(x, F.get("words", i + 1), F.get("words", i + 2)))
    d = d.withColumn("bits", bits).withColumn("hashes", F.slice(window, 1, F.greatest(F.col("n") - 2, F.lit(0))))
    packed = F.expr("transform(hashes, (h, i) -> shiftleft(shiftright(h, bits), bits) | cast(i as bigint))")
    d = d.withColumn("sorted", F.sort_array(packed))
    same = F.expr("filter(sorted, (x, i) -> shiftright(x, bits) = shiftright(get(sorted, i - 1), bits) or shiftright(x, bits) = shiftright(get(sorted, i + 1), bits))")
    d = d.withColumn("twice", same)
    if not exact:
        d = d.withColumn("at", F.expr("sort_array(transform(twice, x -> x & (shiftleft(1L, bits) - 1)))"))
        return _counts(d)
    spelt = F.expr("sort_array(transform(twice, x -> struct(concat_ws(' ', slice(words, cast(x & (shiftleft(1L, bits) - 1) as int) + 1, 3)) as w, x & (shiftleft(1L, bits) - 1) as p)))")
    d = d.withColumn("spelt", spelt)
    equal = F.expr("filter(spelt, (x, i) -> x.w <=> get(spelt, i - 1).w or x.w <=> get(spelt, i + 1).w)")
    d = d.withColumn("equal", equal).withColumn("at", F.expr("sort_array(equal.p)"))
    return _counts(d)


def _counts(d: DataFrame) -> DataFrame:
    covered = F.expr("aggregate(transform(at, (p, i) -> least(3L, coalesce(get(at, i + 1) - p, 3L))), 0L, (t, x) -> t + x)")
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("at") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[.?](?=\s|$)")).cast("long").alias("n_stops"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s.,]")).cast("long").alias("n_odd"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]++")).cast("long").alias("n_runs"),
        F.size(F.filter("words", lambda x, i: x == F.get("words", i + 1))).cast("long").alias("n_stutter"),
    )


def votes() -> dict[str, Column]:
    """Each rule as a column of 1, -1 or 0."""
    n, chars, c = F.col("n_words"), F.col("word_chars"), F.col

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "shouts": rule(c("n_shouts") * 12 > n, c("n_shouts") * 50 <= n),
        "odd": rule(c("n_odd") * 16 > chars, c("n_odd") * 60 <= chars),
        "symbols": rule(c("n_symbols") * 25 > chars, c("n_symbols") * 200 <= chars),
        "runs": rule(c("n_runs") * 8 > n, c("n_runs") * 50 <= n),
        "stutter": rule(c("n_stutter") * 8 > n, c("n_stutter") * 25 <= n),
        "lines": rule(c("n_dup_lines") * 2 > c("n_lines"), c("n_dup_lines") * 20 <= c("n_lines")),
        "repeats": rule(c("n_repeat_words") * 5 > 2 * n, c("n_repeat_words") * 20 <= n),
        "words": rule((chars < 2 * n) | (chars > 12 * n), (chars >= 3 * n) & (chars <= 9 * n)),
        "capitals": rule(c("n_upper") * 4 > chars, c("n_upper") * 10 <= chars),
        "sentences": rule((c("n_stops") == 0) | (c("n_stops") * 3 > n), (c("n_stops") * 50 >= n) & (c("n_stops") * 4 <= n)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over counted vote patterns: the share of good documents, and per
    rule its accuracy on good and on bad ones, among the votes it casts. A rule that spots one
    kind of junk lets the others through, so the two differ. Starts from the bad votes cast."""
    if not patterns:
        return 0.5, []
    rules = len(patterns[0][0])
    total = sum(c for _, c in patterns)
    good = [0.97 * 0.35 ** sum(x < 0 for x in v) for v, _ in patterns]
    prior, accuracy = 0.5, [(0.8, 0.8)] * rules
    for _ in range(rounds):
        prior = _within((sum(g * c for g, (_, c) in zip(good, patterns)) + 1) / (total + 2), (0.01, 0.99))
        for j in range(rules):
            on_good = sum(g * c for g, (v, c) in zip(good, patterns) if v[j])
            on_bad = sum((1 - g) * c for g, (v, c) in zip(good, patterns) if v[j])
            up = sum(g * c for g, (v, c) in zip(good, patterns) if v[j] > 0)
            down = sum((1 - g) * c for g, (v, c) in zip(good, patterns) if v[j] < 0)
            right = _within((up + 9) / (on_good + 10), ON_GOOD)
            # a rule is no worse than chance: its votes never speak against what they say
            accuracy[j] = right, max(1 - right, _within((down + 3) / (on_bad + 10), ON_BAD))
        good = [posterior(v, prior, accuracy) for v, _ in patterns]
    return prior, accuracy


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(bounds[1], max(bounds[0], x))


def evidence(accuracy: tuple[float, float]) -> tuple[float, float]:
    """Log odds of good that a good vote and a bad vote of a rule carry."""
    on_good, on_bad = accuracy
    return math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)


def posterior(v: tuple[int, ...], prior: float, accuracy: list[tuple[float, float]]) -> float:
    z = math.log(prior / (1 - prior)) + sum(evidence(a)[x < 0] for x, a in zip(v, accuracy) if x)
    return 1 / (1 + math.exp(-z))


def judge(df: DataFrame, least: float = LEAST) -> DataFrame:
    """Counts, base_failed, the posterior probability of good, and kept, for every document."""
    rules = votes()
    table = materialise(measure(df).select("doc_id", *COUNTS, *(v.cast("tinyint").alias(f"vote_{k}") for k, v in rules.items())), "votes")
    names = [f"vote_{k}" for k in rules]
    counted = table.groupBy(*names).agg(F.count(F.lit(1)).alias("c")).collect()  # at most 3 ** 10 rows
    prior, accuracy = estimate(sorted((tuple(r[k] for k in names), r.c) for r in counted))
    z = F.lit(math.log(prior / (1 - prior)))
    for k, a in zip(names, accuracy):
        up, down = evidence(a)
        z = z + F.when(F.col(k) > 0, up).when(F.col(k) < 0, down).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = table.withColumn("base_failed", failed).withColumn("posterior", F.round(1 / (1 + F.exp(-z)), 9))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop(*COUNTS[5:])


def op4_rules_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")
