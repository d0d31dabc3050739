"""N-gram Jaccard join: rare-first prefix filtering, one verification per pair.

Sets are the distinct 5-word shingles of a document as 64-bit hashes; a *node* is one distinct
set, so exact copies are one node however many they are. Two nodes link when
100 * intersection >= 75 * union.

1. Every task counts its shingles in a sketch of counters, about sixteen a document (at most
   2**MOST_BITS), over all documents; the summed sketch gives the global order: rare counters
   first, then the hash. Any fixed order makes prefix filtering exact; this one keeps common
   passages out of the prefixes and puts what is a document's own before what it shares.
2. A set of n shingles posts its first n - ceil(0.75 n) + 1 ones. Postings meet by shingle;
   lists the sketch calls long are salted into sub-lists. If the first shingle of a set that
   another set posted too stands at place e, the first e ones are in no set it may link with,
   so it shares at most n - e: sets for which that is under 0.75 n leave, and the same bound
   holds for every pair. It is taken twice, the second time among the sets that stayed.
3. First round: within each list every node is a candidate of the list's head only (the member
   with fewest shingles of its own in front, which in a group of edited copies is their original), so a
   list of m members gives m candidates, never m * m. The candidate that shares most prefix
   shingles is verified. Accepted links give components (alternating star contraction over
   tables, nothing on the driver).
4. Second round, which makes the result exact: in lists that still hold members of different
   components, each member has a largest partner that the length and positional filters and the
   bound of step 2 allow. Members that allow no length of their list leave; a pair is made only
   where the larger set lies within what the smaller one allows, met by bands of lengths, so
   documents that share much but not enough are not compared. Pairs across components then pass
   the suffix filter in the form of a partition (how many shingles two whole sets have in each of
   BINS ranges of hashes bounds what they share), and those left are verified once. A linked pair
   shares a prefix shingle, so it is either within one component already or verified here.

Defined results: null text, or a text without words, has an empty set, n_shingles 0 and is its
own component; fewer than five words are one shingle; rows with a null id come back with a
null component and link with nothing; repeated rows come back once each; an empty table gives
an empty result; extra columns are ignored. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factspan.llm.common import BROADCAST_ROWS, documents, fresh, id_text, map_texts, materialise
from factspan.llm.words import SpaceWords, chain, mix

WORDS = 5
LEAST_BITS, MOST_BITS = 16, 24
BLOCK = 4096
BINS = 64
#: Members of a posting list above which it is split.
LONG_LIST = 4096
#: Sets that a task remembers having posted.
_NODE_CACHE = 200_000
_SALT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = SpaceWords(texts)
    hashes = words.hashes
    whole = chain(hashes, k) if len(hashes) >= k else hashes[:0]
    out = []
    for hi, n in zip(np.cumsum(words.counts).tolist(), words.counts.tolist()):
        h = np.sort(whole[hi - n : hi - k + 1] if n >= k else chain(hashes[hi - n : hi], n) if n else hashes[:0])
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if n else h)
    return out


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


_FIRST = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("bundle", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType()), T.StructField("bins", T.ArrayType(T.IntegerType())),
])


def _digest(bits: int):
    """Rows (doc_id, node, n, bins) of every document, then the task's sketch in blocks."""
    from pyspark import TaskContext

    context = TaskContext.get()
    bundle = (context.partitionId() if context else 0) // 64
    sketch = np.zeros(1 << bits, dtype=np.int64)
    waiting: list[np.ndarray] = []

    def count():
        if waiting:
            sketch[:] += np.bincount((np.concatenate(waiting) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(sketch))
            waiting.clear()

    def step(ids, texts):
        sets = shingle_sets(texts)
        waiting.extend(s for s, i in zip(sets, ids) if len(s) and i is not None)
        if sum(map(len, waiting)) > 1 << 19:
            count()
        none = [None] * len(ids)
        bins = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS) if len(s) else None for s in sets]
        return [ids, [node_of(s) if len(s) and i is not None else None for s, i in zip(sets, ids)], [len(s) for s in sets], none, none, none, bins]

    def finish():
        count()
        blocks = sketch.reshape(-1, BLOCK)
        used = [b for b in range(len(blocks)) if blocks[b].any()]
        for lo in range(0, len(used), 256):
            part = used[lo : lo + 256]
            none = [None] * len(part)
            yield [none, none, none, [bundle] * len(part), part, [_packed(blocks[b]) for b in part], none]

    step.finish = finish
    return step


def _packed(block: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs; their width follows from the length."""
    top = int(block.max())
    return block.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if top <= np.iinfo(t).max)).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // BLOCK])


_BLOCKS = "bundle int, block int, counts binary"


def _add_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, dtype=np.int64)
    for raw in table["counts"]:
        total += _unpacked(raw.as_py())
    return pa.table({"bundle": pa.array([table["bundle"][0].as_py() // 64], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})


def _order_codes(first: DataFrame, bits: int) -> np.ndarray:
    """One byte per counter: eight steps per doubling of the count. Its size is bounded."""
    blocks = first.where(F.col("block").isNotNull()).select("bundle", "block", "counts")
    for _ in range(3):  # 64 tasks at a time, then 64 of those, then all
        blocks = blocks.groupBy("bundle", "block").applyInArrow(_add_blocks, _BLOCKS)
    codes = np.zeros((1 << bits) // BLOCK * BLOCK, dtype=np.uint8).reshape(-1, BLOCK)
    for r in blocks.select("block", "counts").toLocalIterator():
        codes[r.block] = np.minimum(255, np.ceil(8 * np.log2(1.0 + _unpacked(r.counts))))
    return codes.reshape(-1)


#: s is the shingle; it is null where the list is not salted and so is the shingle itself.
_POSTINGS = T.StructType([T.StructField("list", T.LongType()), T.StructField("s", T.LongType()), T.StructField("node", T.LongType()), T.StructField("pos", T.IntegerType())])


def _postings(docs: DataFrame, codes: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def make():
        code = sent.value
        # how many sub-lists a shingle of each code is dealt to
        parts = np.maximum(1, (np.exp2(np.arange(256) / 8) / LONG_LIST).astype(np.uint64))
        seen: set[int] = set()
        shift = np.uint64(65 - len(code).bit_length())

        def step(ids, texts):
            cols: list[list] = [[] for _ in range(4)]
            for doc_id, s in zip(ids, shingle_sets(texts)):
                n = len(s)
                if not n or doc_id is None:
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) >= _NODE_CACHE:
                    seen.clear()
                seen.add(node)
                c = code[(s >> shift).astype(np.int64)]
                order = np.argsort(c, kind="stable")[: prefix_length(n)]
                top, deal = s[order], parts[c[order]]
                salt = np.uint64(node & 0x7FFFFFFFFFFFFFFF) % deal
                lists = np.where(deal > 1, mix(top + salt * _SALT + np.uint64(1)), top)
                p = len(top)
                for col, v in zip(cols, (lists.view(np.int64), pa.array(top.view(np.int64), mask=deal == 1), np.full(p, node, dtype=np.int64), np.arange(p, dtype=np.int32))):
                    col.append(v)
            return [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in cols] if cols[0] else None

        return step

    return map_texts(docs, make, _POSTINGS)


def _sets_of(docs: DataFrame, need: DataFrame, with_bins: bool = False) -> DataFrame:
    """(node, set) of the nodes in need(node, doc_id); the ids are broadcast only if few."""
    need = materialise(need, "needed")
    ids = need.select("doc_id").distinct()
    rows = docs.join(F.broadcast(ids) if need.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")

    def make():
        def step(_, texts):
            sets = [s for s in shingle_sets(texts) if len(s)]
            return [[node_of(s) for s in sets], [s.view(np.int64) for s in sets]]

        return step

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])
    return map_texts(rows, make, schema).dropDuplicates(["node"])


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that link: the suffix filter first, then one intersection each."""
    a, b = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bins").alias(f"bins{k}")) for k in "ab")
    apart = F.aggregate(F.zip_with("binsa", "binsb", lambda p, q: F.abs(p - q)), F.lit(0), lambda total, d: total + d)
    # two sets of that many elements apart share at most (na + nb - apart) / 2
    pairs = pairs.join(a, "a").join(b, "b").where(7 * (F.col("na") + F.col("nb") - apart) >= 6 * (F.col("na") + F.col("nb"))).select("a", "b")
    pairs = materialise(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialise(_sets_of(docs, ends.join(nodes, "node").select("node", "doc_id")), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return materialise(both.where("100 * i >= 75 * (size(x) + size(y) - i)").select("a", "b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the end points of edges(a, b): alternating large-star and small-star
    contraction; every round is a table, and star centres are joined, never collected."""
    state, before = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        state = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _lengths_fit(a: Column, b: Column) -> Column:
    return (4 * F.least(a, b)) >= (3 * F.greatest(a, b))


def _positions_fit(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """Could this be the first shingle, in the global order, that a linking pair shares? Then
    all they share starts here, in both."""
    return 7 * F.least(na - pa, nb - pb) >= 3 * (na + nb)


def band(n: Column) -> Column:
    """Sizes of sets in bands that grow by an eighth."""
    return F.floor(F.log(n) / F.log(F.lit(1.125))).cast("int")


def _sized(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a written table of short rows: broadcast if its measured size allows."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def join_classes(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = id_text(df)
    bits = min(MOST_BITS, max(LEAST_BITS, docs.count().bit_length() + 4))
    first = materialise(map_texts(docs, lambda: _digest(bits), _FIRST), "digests")
    rows = first.where(F.col("block").isNull())
    codes = _order_codes(first, bits)
    nodes = materialise(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bins").alias("bins")), "nodes")

    def shared(postings: DataFrame) -> DataFrame:
        """Postings whose list another node is in; salted lists may meet elsewhere and stay."""
        by = W.partitionBy("list")
        met = postings.withColumns({"lo": F.min("node").over(by), "hi": F.max("node").over(by), "size": F.count(F.lit(1)).over(by)})
        return met.where("lo <> hi or s is not null").drop("lo", "hi")

    lists = materialise(shared(_postings(docs, codes)), "lists")

    def alive(lists: DataFrame) -> DataFrame:
        """The most that a node may share with any other, where that suffices to link, and the
        mean size of the lists it posted to."""
        met = lists.groupBy("node").agg(F.min("pos").alias("own"), F.sum("size").alias("size")).join(nodes.select("node", "n"), "node")
        met = met.withColumn("weight", F.expr("size div (n - (3 * n + 3) div 4 + 1)"))
        return materialise(met.where("4 * (n - own) >= 3 * n").select("node", "n", (F.col("n") - F.col("own")).alias("most"), "weight"), "alive")

    for _ in range(2):
        able = alive(lists)
        lists = materialise(shared(_sized(lists.select("list", "s", "node", "pos"), able, ["node"])), "met")
    lists = lists.drop("size").distinct().withColumn("s", F.coalesce("s", "list"))

    def may_link(n: Column, most: Column, pos: Column, m: Column, most_m: Column, pos_m: Column) -> Column:
        return _lengths_fit(n, m) & _positions_fit(n, pos, m, pos_m) & (7 * F.least(most, most_m) >= 3 * (n + m))

    def stars(members: DataFrame, key: str) -> DataFrame:
        heads = members.groupBy(key).agg(F.max(F.struct("weight", F.col("node").alias("b"), "n", "most", "pos")).alias("h"))
        near = members.join(heads, key).where(F.col("node") != F.col("h.b"))
        return near.where(may_link(F.col("n"), F.col("most"), F.col("pos"), F.col("h.n"), F.col("h.most"), F.col("h.pos"))).select("node", F.col("h.b").alias("b"))

    salted = lists.where("list <> s")
    star = stars(lists, "list")
    star = star.union(stars(salted, "s")) if salted.head(1) else star
    shares = star.groupBy("node", "b").agg(F.count(F.lit(1)).alias("c"))
    tried = materialise(shares.groupBy(F.col("node").alias("a")).agg(F.max_by("b", F.struct("c", "b")).alias("b")), "tried")
    links = _links(docs, nodes, tried)
    found = materialise(components(links), "roots")

    placed = _sized(lists, found, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.withColumn("largest", F.least(F.expr("7 * least(most, n - pos) div 3 - n"), F.expr("4 * n div 3")))
    mixed = placed.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("smallest")).where("lo <> hi").select("s", "smallest")
    open_ = materialise(placed.join(mixed, "s").where("largest >= smallest").drop("smallest"), "open")
    x, y = open_.withColumn("band", F.explode(F.sequence(band(F.col("n")), band(F.col("largest"))))).where("largest >= n").alias("x"), open_.withColumn("band", band(F.col("n"))).alias("y")
    # x has the smaller set of the two, or one as large; both may link with the other's length
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    fits = order & (F.col("y.n") <= F.col("x.largest")) & (F.col("x.n") <= F.col("y.largest")) & (F.col("x.root") != F.col("y.root"))
    across = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.band") == F.col("y.band")) & fits)
    across = across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    once = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _links(docs, nodes, across.join(once, ["a", "b"], "left_anti"))
    roots = components(links.union(more)) if more.head(1) else found

    known = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = known.join(known.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "component_id")
    out = rows.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")).join(classes, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(df: DataFrame) -> DataFrame:
    """One row of each class: that of its smallest id, with all columns of df. Rows without an
    id are in no class and stay; of rows that share an id, one of the longest text stays."""
    lone = df.where(F.col("doc_id").isNull())
    classes = join_classes(df.where(F.col("doc_id").isNotNull())).where("doc_id = component_id").select("doc_id").distinct()
    names = fresh(df, 3)
    classes = materialise(classes.toDF(names[0]), "first")
    side = F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes
    first = df.join(side, F.col("doc_id").cast("long") == F.col(names[0]), "left_semi")
    twice = first.groupBy("doc_id").agg(F.count(F.lit(1)).alias(names[1])).where(F.col(names[1]) > 1)
    if twice.head(1):
        by = W.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), F.xxhash64("text"))
        first = first.withColumn(names[2], F.row_number().over(by)).where(F.col(names[2]) == 1).drop(names[2])
    return first.unionByName(lone)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(documents(spark, sf_dir))


ORACLE = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from t where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
links as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select a, b from links union select r.a, links.b from r join links on r.b = links.a)
select t.doc_id, coalesce(n.n, 0) n_shingles, least(t.doc_id, coalesce(min(b), t.doc_id)) component_id
from t left join n on n.doc_id = t.doc_id left join r on r.a = t.doc_id group by t.doc_id, n.n
"""
