"""Alignment, the Merkle manifest and embedding near-duplicates against brute force and edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factspan.llm import alignment, merkle, multi_index

DIR = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# alignment


def align_plainly(rows):
    """The contract read literally: one token after the other, one document after the other."""
    import public_tokenizers as tok
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a_side = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=tok.path("piece_bpe_32k.model"))
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD) and not 0x7F <= b <= 0xA0]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    assert set(letters) == set(pre_tokenizers.ByteLevel.alphabet())

    def a_bytes(i):
        return bytes(letters[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    def ends(tokens):
        return np.cumsum([len(t) for t in tokens]).tolist()

    out, count = [], Counter()
    for i, text in rows:
        raw = b" " + (text or "").encode()
        a, b = a_side.encode(" " + (text or ""), add_special_tokens=False).ids, b_side.encode(text or "")
        xs, ys = list(map(a_bytes, a)), list(map(b_bytes, b))
        if not text or b"".join(xs) != raw or b"".join(ys) != raw:
            out.append((i, 0, 0, 0, [], ""))
            continue
        ea, eb, groups = ends(xs), ends(ys), []
        lo = 0
        for e in sorted(set(ea) & set(eb)):
            groups.append(([t for t, k in zip(a, ea) if lo < k <= e], [t for t, k in zip(b, eb) if lo < k <= e]))
            lo = e
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(set(links))
        digest = sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
        out.append((i, len(a), len(b), len(groups), links, digest))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return Counter((i, a, b, g, len(k), sum(count[p] == top[p[0]] for p in k), sum(count[p] for p in k), h) for i, a, b, g, k, h in out)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeiouflmnrst") for _ in range(rng.randrange(1, 9))) for _ in range(n))


ODD = [
    (None, None), (1, ""), (1, " "), (2, "a b  c\t\n"), (3, "<|endoftext|> <s> </s> <unk> <0x41>"), (4, "before▁after"), (5, "é漢😀 x"), (6, "ﬁ ½ é   \x00"),
    (7, "same text"), (7, "same text"), (8, "a" * 3000), (9, " " * 700), (10, "".join(chr(0x4E00 + 7 * k % 3000) for k in range(900))),
]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 50])
def test_alignment_matches_brute_force(spark, broadcast_pairs):
    rng = random.Random(3)
    rows = ODD + [(100 + k, words(rng, 40) + rng.choice([".", "\n\n", " 漢字", "!?"])) for k in range(30)] + [(200, words(rng, 4000))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pairs string, row int").repartition(3)
    assert Counter(tuple(r) for r in alignment.align(docs, broadcast_pairs=broadcast_pairs).collect()) == align_plainly(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, broadcast_pairs=broadcast_pairs).count() == 0


def test_wide_groups_expand_by_number():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 700), rng.integers(0, 4, 500)
    sizes = np.array([699, 1]), np.array([499, 1])
    want = Counter(int(x) * 9 + int(y) for x in a[:699] for y in b[:499]) + Counter([int(a[699]) * 9 + int(b[499])])
    got = Counter()
    for key, links in zip(*(x.tolist() for x in alignment.pair_links(a, b, *sizes, 9))):
        got[key] += links
    assert got == want


def test_chunks_are_forgotten_and_learnt_again(monkeypatch):
    chunks = alignment.Chunks(alignment.vocabulary_paths())
    rng = random.Random(8)
    texts = [words(rng, 30) for _ in range(6)] + [t for _, t in ODD if t]

    def rows():
        for t in texts:
            sides = chunks([alignment.chunks_of(t)])[0]
            yield sides and [x.tolist() for x in sides]

    want = list(rows())
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    assert list(rows()) == want and len(chunks.known) + len(chunks.older) < 120


def test_both_forms_of_the_byte_vocabulary_agree(spark):
    import public_tokenizers as tok
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    encoders = alignment.Encoders(alignment.vocabulary_paths())
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r.text] + [t for _, t in ODD if t]
    for t in texts:
        assert encoders.a.encode_ordinary(" " + t) == whole.encode(" " + t, add_special_tokens=False).ids


# Merkle manifest


def leaf_of(row, text):
    fields = [b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in (row.doc_id, row.source, row.lang, row.n_chars, text)]
    return sha(b"".join(fields))


def tree_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way_up(tree, i):
    for nodes in tree[:-1]:
        run = nodes[i - i % 3 :][:3]
        yield run[: i % 3], run[i % 3 + 1 :]
        i //= 3


def manifest_plainly(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    trees = {s: tree_of([leaf_of(r, r.text) for r in by[s]]) for s in sources}
    top = tree_of([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            way = [*way_up(trees[s], i), *way_up(top, k)]
            tamper = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            at = leaf_of(r, r.text.replace("\n", "") if tamper else r.text)
            for left, right in way:
                at = sha("".join([*left, at, *right]))
            root = top[-1][0]
            yield r.doc_id, trees[s][0][i], trees[s][-1][0], root, sha("".join(x for left, right in way for x in (*left, *right))), at, at == root


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, tree string, size int"
ROWS = [
    (None, None, None, None, None), (None, "s", "en", 1, "a\n"), (1, None, "en", 0, ""), (2, None, "é", 3, "a\nb"), (2, "", "-", 3, "a\nb"), (3, "é", "en", -4, "漢\n\n"),
    (3, "z", "en", 1, "\n"), (3, "z", "en", 1, "\n"), (3, "z", "en", 1, "x"), (-5, "z", None, 9, "w " * 30_000), (12345678901, "z", "de", 2, "\n😀"),
]


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest_matches_brute_force(spark, height):
    rows = ROWS + [(k, "hot" if k % 3 else f"src{k % 7}", "en", k, f"text {k}\nline") for k in range(80)] + [(k, "one of many", "en", 0, "same") for k in [7] * 5]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], MANIFEST).repartition(5)
    got = Counter(tuple(r) for r in merkle.manifest(docs, height).collect())
    assert got == Counter(manifest_plainly(docs.collect()))


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(*ROWS[3], "x", 1)], MANIFEST)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == leaf_of(one.first(), "a\nb") and row.proof_sha256 == sha("")
    assert merkle.manifest(spark.createDataFrame([], MANIFEST)).count() == 0


def test_manifest_of_a_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = Counter(tuple(r) for r in merkle.manifest(docs, 2).collect())
    assert got == Counter(manifest_plainly(docs.collect())) and {r[-1] for r in got} == {True, False}


# embedding near-duplicates


def near_plainly(rows, threshold=0.95):
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and any(v) and all(x is not None and np.isfinite(x) for x in v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links, group = Counter(), {i: {i} for i in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                if group[a] is not group[b]:
                    group[a] |= group[b]
                    for x in group[b]:
                        group[x] = group[a]
    out = []
    for i, (k, _) in enumerate(rows):
        least = min((rows[x][0] for x in group[i] if rows[x][0] is not None), default=None)
        out.append((k, links[i], least, k is not None and k == least))
    return Counter(out)


def vectors(rng, free, hot, dim=16):
    """Unrelated vectors, chains of near ones, a hot group of near copies and a hot group of copies."""
    rows = [rng.standard_normal(dim) for _ in range(free)]
    for _ in range(10):
        v, step = rng.standard_normal(dim), rng.standard_normal(dim) * 0.25
        rows += [v + k * step for k in range(5)]
    base = rng.standard_normal(dim)
    rows += [base + 0.15 * rng.standard_normal(dim) for _ in range(hot)] + [base] * hot
    return [(int(k), [float(x) for x in v]) for k, v in zip(rng.permutation(len(rows)), rows)]


VECTORS = "vec_id long, embedding array<double>, home string, node int"


def embeddings(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("hot, block", [(multi_index.HOT, multi_index.BLOCK), (20, 16), (multi_index.HOT, 7)])
def test_near_duplicates_match_brute_force(spark, hot, block):
    rows = vectors(np.random.default_rng(5), 300, 90)
    got = Counter(tuple(r) for r in multi_index.near_duplicates(embeddings(spark, rows), recall=1.0, hot=hot, block=block).collect())
    assert got == near_plainly(rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    odd = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]),
        (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e-300]), (13, [5.0]), (14, [7.0]), (15, [-7.0]), (16, [0.95, (1 - 0.95**2) ** 0.5 - 1e-9]), (-3, [0.94, 0.35]),
    ]
    got = Counter(tuple(r) for r in multi_index.near_duplicates(embeddings(spark, odd)).collect())
    assert got == near_plainly(odd)
    assert multi_index.near_duplicates(embeddings(spark, [])).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs turned apart to just within the threshold are the hardest; at least nine in ten are found."""
    rng = np.random.default_rng(11)
    x = multi_index.units(rng.standard_normal((2500, 32)))
    away = rng.standard_normal(x.shape)
    away = multi_index.units(away - (away * x).sum(1)[:, None] * x)
    y = 0.9501 * x + (1 - 0.9501**2) ** 0.5 * away
    both = np.concatenate([x, y])
    rows = [(k, v.tolist()) for k, v in enumerate(both)]
    total = int((both @ both.T >= 0.95).sum()) - len(both)
    found = multi_index.near_duplicates(embeddings(spark, rows)).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * total <= found <= total


def test_traversal_is_in_order_and_whole():
    rng = np.random.default_rng(2)
    a, b = rng.random(9) - 0.1, rng.random(7)
    a, b = a - a.min(), b - b.min()
    got = list(multi_index.traverse(a, b, 0.8))
    costs = [a[i] + b[j] for i, j in got]
    assert costs == sorted(costs) and set(got) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.8} and len(set(got)) == len(got)
