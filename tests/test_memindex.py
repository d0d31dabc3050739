"""The memory index: a fold in plain Python, and batches against the whole."""

import random
from collections import Counter

import pytest

from factspan.operators import memindex as mi

CLAUSES = "array<struct<shape: string, centre: string, arms: array<struct<particle: string, phrase: string>>, value: string, change: boolean, old: string>>"


def ledger_of(spark, ops):
    rows = {k: [o[1:] for o in ops if o[0] == k] for k in ("declare", "row", "mark", "bridge")}
    return mi.Ledger(
        spark.createDataFrame(rows["declare"], "session string, ord long, topic string, centre string, arms array<struct<particle: string, phrase: string>>"),
        spark.createDataFrame(rows["row"], f"sid long, session string, clauses {CLAUSES}, words array<string>"),
        spark.createDataFrame(rows["mark"], "ord long, sid long, by long, reason string"),
        spark.createDataFrame(rows["bridge"], "ord long, qword string, phrase string"),
    )


def random_ops(rng, n):
    ops, sids = [], []
    for i in range(n):
        session, kind = rng.choice(["a", "b", "c"]), rng.random()
        if kind < 0.15:
            centre, owner = f"c{rng.randrange(3)}", f"o{rng.randrange(2)}"
            ops.append(("declare", session, i, f"{owner} of {centre}", centre, [("of", owner)]))
        elif kind < 0.25 and len(sids) > 2:
            old, new = sorted(rng.sample(sids, 2))
            ops.append(("mark", i, old, new, "r"))
        elif kind < 0.3:
            ops.append(("bridge", i, f"w{rng.randrange(2)}", f"c{rng.randrange(3)}"))
        else:
            clauses = []
            for _ in range(rng.randrange(1, 4)):
                shape = rng.choice(["F0", "F1", "F2", "F4"])
                value = f"v{rng.randrange(3)}" if shape in ("F1", "F2") else None
                arms = [("of", f"{rng.choice('oc')}{rng.randrange(3)}")] if shape == "F1" else [("in", "x y")] if shape == "F4" else []
                change = value is not None and rng.random() < 0.3
                clauses.append((shape, None if shape == "F0" else f"c{rng.randrange(3)}", arms, value, change, f"v{rng.randrange(3)}" if change and rng.random() < 0.8 else None))
            words = sorted({w for c in clauses for p in (c[1], c[3], *(a[1] for a in c[2])) if p for w in p.split(" ")})
            ops.append(("row", i, session, clauses, words))
            sids.append(i)
    return ops


def fold(ops):
    """The values, members and origins, by one walk over the ledger."""
    opened, clauses, topics, values, marks, seen, origins = {}, [], {}, {}, {}, set(), Counter()
    for op in ops:
        if op[0] == "declare":
            opened[op[1]] = op[3:]
            topics.setdefault(op[3], op[4:])
        elif op[0] == "mark":
            marks[op[2]] = (op[3], op[4])
        elif op[0] == "row":
            _, sid, session, told, words = op
            nest = opened.get(session)
            for k, (shape, centre, arms, value, change, old) in enumerate(told):
                if shape == "F0":
                    continue
                done = shape == "F4" and nest is not None
                arms = arms + ([("subject", nest[1]), *nest[2]] if done else [])
                tank = "F3" if done else shape
                clauses.append((sid, k, tank, centre, arms, nest and nest[0], done))
                for phrase in [centre, *(p for _, p in arms), *([value] if value else [])]:
                    origins[tank, all(w in seen for w in phrase.split(" "))] += 1
                if value:
                    position = (tank, centre, ">".join(f"{p}={ph}" for p, ph in arms))
                    values.setdefault(position, []).append((sid, k, value, change, old))
            seen |= set(words)
    members = set()
    for sid, k, tank, centre, arms, nest, done in clauses:
        for topic, (of, needs) in topics.items():
            exact = all(n in [*(p for _, p in arms), centre] for _, n in needs)
            if done and nest == topic:
                members.add((topic, sid, k, "completed", True))
            elif centre == of:
                members.add((topic, sid, k, "centre", exact))
            elif ("of", of) in arms:
                members.add((topic, sid, k, "path", exact))
            elif nest == topic:
                members.add((topic, sid, k, "context", False))
    entries = set()
    for position, told in values.items():
        replaced, before = set(), None
        for j, (sid, k, value, change, old) in enumerate(told):
            kind = "first" if j == 0 else "update" if change or sid in replaced else "other"
            entries.add((*position, sid, k, value, kind, old == before if change and old and j else None, marks.get(sid, (None, None))[0]))
            if sid in marks:
                replaced.add(marks[sid][0])
            before = value
    return entries, members, origins


def rows_of(df):
    return Counter(repr(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_index_is_the_fold_and_batches_make_the_whole(spark, tmp_path, seed):
    ops = random_ops(random.Random(seed), 150)
    whole = mi.build(ledger_of(spark, ops), bucket=7)
    entries, members, origins = fold(ops)
    cols = ("tank", "centre", "chain", "sid", "k", "value", "kind", "old_matches", "by")
    assert {tuple(r) for r in whole.values.select(*cols).collect()} == entries
    assert {tuple(r) for r in whole.members.select("topic", "sid", "k", "kind", "exact").collect()} == members
    got = Counter({(r.tank, r.origin == "record"): r["count"] for r in whole.seats.groupBy("tank", "origin").count().collect()})
    assert got == origins

    index = mi.saved(mi.build(ledger_of(spark, ops[:40]), bucket=7), str(tmp_path / "0"))
    for n, (lo, hi) in enumerate([(40, 95), (95, 96), (96, 150)], 1):
        index = mi.saved(mi.extend(index, ledger_of(spark, ops[lo:hi]), bucket=7), str(tmp_path / str(n)))
    for part in mi.PARTS:
        assert rows_of(getattr(index, part)) == rows_of(getattr(whole, part)), part


def test_empty_ledger(spark):
    index = mi.build(ledger_of(spark, []))
    assert all(getattr(index, part).count() == 0 for part in mi.PARTS) and mi.crosses(index).count() == 0


def test_carried_over_buckets_and_null_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), i * rng.choice([1, 1, 40]) + i, rng.choice([None, f"v{i}"])) for i in range(120)]
    rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])
    last, want = {}, []
    for g, i, v in rows:
        want.append((g, i, last.get(g)))
        last[g] = v or last.get(g)
    d = spark.createDataFrame(rows, "g string, ord long, v string")
    got = mi.carried(d, ["g"], ["ord"], "v", "before", bucket=5).select("g", "ord", "before").collect()
    assert Counter(map(tuple, got)) == Counter(want)
