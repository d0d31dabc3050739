"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut in halves, each half has a codebook of its own, and the product of the codebooks is
a grid of cells. Every vector lies in one cell and visits the cells around it, nearest first.

1. Equal vectors are one node with a weight. The codebooks (at most MOST_CODES codes a half, about
   CELL vectors a cell) are fitted on a bounded sample: at most SAMPLE vectors and SAMPLE_VALUES
   numbers. Every vector is indexed.
2. Visiting is the multi-sequence traversal: both halves' codes in order of distance, cells popped
   from a heap in order of the sum. It stops where the cost of a cell exceeds that of the nearest
   one by `reach`: the excess within which RECALL of the sample's vectors find a vector turned
   away from them in a random direction to just the threshold, the hardest case. Nearer vectors
   are found more surely.
3. A pair is compared once: the later node visits, the earlier one lies in the cell. Cells with
   more than BLOCK members or visitors are compared in blocks, each a task's group of its own, by
   one matrix product in double precision. A block gives sums per node and a spanning forest,
   never its pairs.
4. Hot groups of near copies are taken out of the grid: cells with more than max(HOT, nodes / 1000)
   members (so fewer than 1,000) propose the middle of their densest group, and vectors within half
   the threshold's angle of such a middle are a ball. Members of one ball are linked by the
   triangle inequality and need no comparison. Against a ball a vector is compared if its angle to
   the middle allows a link with any member; that bound is exact, so balls lose no link.
5. Links are summed by node, and components are contracted over tables.

Defined results: null, empty and zero vectors and vectors with null or non-finite components link
with nothing; vectors of different lengths do not link; a multiple of a vector links with it; rows
with a null vec_id come back with a null component_id and link with nothing; repeated rows are
vectors of their own and come back once each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm.common import enter, give_back, materialise
from factspan.llm.ngram_join import _sized, components

THRESHOLD = 0.95
RECALL = 0.99
SAMPLE, SAMPLE_VALUES = 20_000, 1 << 23
CELL = 64
MOST_CODES = 1024
BLOCK = 1024
HOT = 2048
_ROUNDS = 8


def _matrices(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) for every length of vector in a batch; a null component is NaN."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)]))
    return out


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled first so that no square overflows."""
    m = m / np.abs(m).max(1)[:, None]
    return m / np.sqrt((m * m).sum(1))[:, None]


def _mapped(df: DataFrame, step, schema: str | T.StructType) -> DataFrame:
    def run(batches):
        enter("multi-index")
        for b in batches:
            yield step(b)
        give_back()

    return df.mapInArrow(run, schema)


def _fingerprints(df: DataFrame) -> DataFrame:
    """vec_id, dim and digest of every row; dim and digest are null where it can link with nothing."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        dims, digests = [None] * b.num_rows, [None] * b.num_rows
        for rows, m in _matrices(b.column(1)):
            for r, v in zip(rows[good := np.isfinite(m).all(1) & (m != 0).any(1)].tolist(), m[good] + 0.0):
                dims[r], digests[r] = len(v), hashlib.blake2b(v.tobytes(), digest_size=16).digest()
        own = [b.column(0), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), b.column(1)]
        return pa.RecordBatch.from_arrays(own, names=["vec_id", "dim", "digest", "vec"])

    # Arrow gives every null of a list as NaN, which a vector of numbers never holds here
    kind = next(f.dataType for f in df.schema if f.name == "embedding").elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(kind)).alias("vec"))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("vec", T.ArrayType(kind))])
    return _mapped(rows, step, schema)


def squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (codes * codes).sum(1) - 2 * x @ codes.T, 0)


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[lo : lo + 2048], codes).argmin(1) for lo in range(0, len(x), 2048)])


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k codes of a half by Lloyd's rounds from a random choice of its vectors."""
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(_ROUNDS):
        of = _nearest(x, codes)
        sums, counts = np.zeros_like(codes), np.bincount(of, minlength=k)
        np.add.at(sums, of, x)
        codes[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return codes


class Grid:
    """The codebooks of both halves for vectors of one length, and how far a visit reaches."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        self.dim, rng = sample.shape[1], np.random.default_rng(7)
        self.half = self.dim // 2
        k = max(1, min(k, len(sample) // 4))
        self.codes = codebook(sample[:, : self.half], k, rng), codebook(sample[:, self.half :], k, rng)
        seen = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
        away = rng.standard_normal(seen.shape)
        away -= (away * seen).sum(1)[:, None] * seen
        size = np.sqrt((away * away).sum(1))[:, None]
        turned = threshold * seen + math.sqrt(1 - threshold**2) * np.divide(away, size, out=np.zeros_like(away), where=size > 0)
        cells, excess = self.nearest(turned), self.costs(seen)
        row = np.arange(len(seen))
        self.reach = float(np.quantile(excess[0][row, cells[0]] + excess[1][row, cells[1]], recall)) if len(seen) else 0.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def costs(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance of either half to its codes beyond that of the nearest one."""
        return [(d := squared(h, c)) - d.min(1)[:, None] for h, c in zip(self.halves(x), self.codes)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(squared(h, c).argmin(1) for h, c in zip(self.halves(x), self.codes))

    def key(self, i, j):
        return (self.dim << 40) | (i << 20) | j

    def home(self, x: np.ndarray) -> np.ndarray:
        i, j = self.nearest(x)
        return self.key(i.astype(np.int64), j.astype(np.int64))

    def visited(self, x: np.ndarray) -> list[list[int]]:
        """The cells that every row visits, nearest first."""
        return [[self.key(i, j) for i, j in traverse(a, b, self.reach)] for a, b in zip(*self.costs(x))]


def traverse(a: np.ndarray, b: np.ndarray, reach: float):
    """Multi-sequence traversal: pairs (i, j) in order of a[i] + b[j], up to reach."""
    oa, ob = (o[np.argsort(v[o], kind="stable")].tolist() for o, v in ((np.flatnonzero(a <= reach), a), (np.flatnonzero(b <= reach), b)))
    va, vb = a[oa].tolist(), b[ob].tolist()
    heap = [(0.0, 0, 0)]
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > reach:
            return
        yield oa[i], ob[j]
        if j + 1 < len(vb):
            heapq.heappush(heap, (va[i] + vb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(va):
            heapq.heappush(heap, (va[i + 1] + vb[0], i + 1, 0))


def _fit(nodes: DataFrame, count: int, longest: int, threshold: float, recall: float) -> dict[int, Grid]:
    """A grid for every length of vector in the sample; vectors of a length that the sample lacks share one cell."""
    rows = min(SAMPLE, max(256, SAMPLE_VALUES // max(longest, 1)))
    cut = math.ceil(2**30 * min(1.0, rows / max(count, 1)))
    table = nodes.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < cut).select("vec").toArrow()
    k = max(1, min(MOST_CODES, round(math.sqrt(count / CELL))))
    grids = {}
    for _, m in _matrices(table["vec"].combine_chunks()) if table.num_rows else []:
        grids[m.shape[1]] = Grid(units(m), k, threshold, recall)
    return grids


def _single(dim: int) -> int:
    """The one cell of vectors whose length has no grid."""
    return dim << 40


def _homes(nodes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        home = np.zeros(b.num_rows, dtype=np.int64)
        for rows, m in _matrices(b.column(1)):
            home[rows] = grids[m.shape[1]].home(units(m)) if m.shape[1] in grids else _single(m.shape[1])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(home), b.column(1)], names=["node", "home", "vec"])

    return _mapped(nodes.select("node", "vec"), step, T.StructType([nodes.schema["node"], T.StructField("home", T.LongType()), nodes.schema["vec"]]))


def _middles(homes: DataFrame, hot: DataFrame, threshold: float) -> dict[int, np.ndarray]:
    """Middles of the densest groups of hot cells, by length; those near a better supported one are left out."""

    def densest(rows: pa.Table) -> pa.Table:
        x = units(_matrices(rows["vec"].combine_chunks())[0][1])
        near = x @ x.T >= threshold
        best = near.sum(1).argmax()
        middle = units(x[near[best]].mean(0)[None])[0]
        share = float(near[best].mean())
        return pa.table({"share": pa.array([share * rows["size"][0].as_py()]), "middle": pa.array([middle.tolist()], pa.list_(pa.float64()))})

    # about 256 members tell where a cell's densest group is; they decide nothing else
    some = homes.join(F.broadcast(hot), "home").where(F.pmod(F.xxhash64("node"), F.col("size")) < 256)
    found = some.select("home", "size", "vec").groupBy("home").applyInArrow(densest, "share double, middle array<double>").orderBy(F.desc("share"), "middle").collect()
    out: dict[int, list] = {}
    for r in found:
        v, kept = np.array(r.middle), out.setdefault(len(r.middle), [])
        if all(v @ u < math.cos(math.acos(threshold) / 2) for u in kept):
            kept.append(v)
    return {d: np.array(v) for d, v in out.items()}


def _place(nodes: DataFrame, grids: dict[int, Grid], cells: np.ndarray, balls: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """home and visits of every node. Balls have negative keys; they are numbered over all lengths."""
    numbers, first = {}, 0
    for d in sorted(balls):
        numbers[d], first = first, first + len(balls[d])
    angle = math.acos(threshold)
    # a hair less than half the angle, so that rounding cannot make a link of members that are none
    inner, outer = math.cos(angle / 2 - 1e-7), math.cos(min(math.pi, 1.5 * angle + 1e-7))
    known = nodes.sparkSession.sparkContext.broadcast(cells)

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        home, visits = np.zeros(b.num_rows, dtype=np.int64), [[]] * b.num_rows
        for rows, m in _matrices(b.column(2)):
            x, d = units(m), m.shape[1]
            free = np.ones(len(x), dtype=bool)
            if d in balls:
                cos = x @ balls[d].T
                own = cos.argmax(1)
                free = cos[np.arange(len(x)), own] < inner
                home[rows[~free]] = -(numbers[d] + own[~free]) - 1
                # a ball compares itself with the balls before it, a free vector with all in reach
                wanted = (cos >= outer) & (free[:, None] | (np.arange(cos.shape[1]) < own[:, None]))
                for r, w in zip(rows.tolist(), wanted):
                    visits[r] = (-(numbers[d] + np.flatnonzero(w)) - 1).tolist()
            x, rows = x[free], rows[free]
            if d in grids:
                home[rows] = grids[d].home(x)
                seen = grids[d].visited(x)
            else:
                home[rows] = _single(d)
                seen = [[_single(d)]] * len(rows)
            sizes = np.array([len(s) for s in seen], dtype=np.int64)
            keys = np.array([k for s in seen for k in s], dtype=np.int64)
            taken = np.isin(keys, known.value).tolist()
            for r, s, hi, n in zip(rows.tolist(), seen, np.cumsum(sizes).tolist(), sizes.tolist()):
                visits[r] = visits[r] + [k for k, t in zip(s, taken[hi - n : hi]) if t]
        own = [*b.columns, pa.array(home), pa.array(visits, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(own, names=["node", "weight", "vec", "home", "visits"])

    kept = [nodes.schema[c] for c in ("node", "weight", "vec")]
    placed = _mapped(nodes.select("node", "weight", "vec"), step, T.StructType([*kept, T.StructField("home", T.LongType()), T.StructField("visits", T.ArrayType(T.LongType()))]))
    return materialise(placed, "placed")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n points with edges (a, b), the smallest point of each one's component."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(rows: pa.Table, threshold: float) -> pa.Table:
    """Links of a block: (node, links, root) with the weights of what it links with here."""
    visitor, node, weight = (rows[c].to_numpy() for c in ("visitor", "node", "weight"))
    nothing = pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "root")})
    x, y = np.flatnonzero(visitor), np.flatnonzero(~visitor)
    if not len(x) or not len(y):
        return nothing
    unit = units(_matrices(rows["vec"].combine_chunks())[0][1])
    met = unit[x] @ unit[y].T >= threshold
    if rows["key"][0].as_py() >= 0:
        met &= node[x][:, None] > node[y]
    i, j = np.nonzero(met)
    if not len(i):
        return nothing
    ends, where = np.unique(np.concatenate([node[x][i], node[y][j]]), return_inverse=True)
    links = np.bincount(where, weights=np.concatenate([weight[y][j], weight[x][i]])).astype(np.int64)
    root = ends[_labels(len(ends), where[: len(i)], where[len(i) :])]
    return pa.table({"node": ends, "links": links, "root": root})


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Members and visitors of every key; keys with many of either are cut into blocks that meet in pairs."""
    visits = placed.select(F.explode("visits").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("p"))
    members = placed.groupBy(F.col("home").alias("key")).agg(F.count(F.lit(1)).alias("m"))
    parts = visits.join(members, "key").where(F.greatest("p", "m") > block)
    parts = materialise(parts.select("key", F.ceil(F.col("m") / block).alias("ms"), F.ceil(F.col("p") / block).alias("ps")), "parts")
    one = F.lit(1).cast("long")

    def dealt(side: DataFrame, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        side = _sized(side, parts, ["key"], "left").withColumns({c: F.coalesce(c, one) for c in ("ms", "ps")})
        side = side.withColumn(own_part, F.pmod(F.xxhash64("node"), F.col(own)))
        return side.withColumn(other_part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("key", "i", "j", "visitor", "node", "weight", "vec")

    lying = dealt(placed.select(F.col("home").alias("key"), "node", "weight", "vec", F.lit(False).alias("visitor")), "ms", "ps", "i", "j")
    visiting = dealt(placed.select(F.explode("visits").alias("key"), "node", "weight", "vec", F.lit(True).alias("visitor")), "ps", "ms", "j", "i")
    return lying.union(visiting)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of df(vec_id, embedding)."""
    rows = materialise(_fingerprints(df), "fingerprints")
    told = rows.where(F.col("digest").isNotNull() & F.col("vec_id").isNotNull())
    nodes = told.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    count, longest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(0))).first()

    grids = _fit(nodes, count, longest, threshold, recall)
    sizes = materialise(_homes(nodes, grids).groupBy("home").agg(F.count(F.lit(1)).alias("size")), "cells")
    cells = np.sort(sizes.select("home").toArrow()["home"].to_numpy())  # at most MOST_CODES ** 2 a length
    crowded = sizes.where(F.col("size") > max(hot, count // 1000))
    balls = _middles(_homes(nodes, grids), crowded, threshold) if crowded.head(1) else {}

    placed = _place(nodes, grids, cells, balls, threshold)
    found = _blocks(placed, block).groupBy("key", "i", "j").applyInArrow(lambda t: _compare(t, threshold), "node long, links long, root long")
    found = materialise(found, "links")
    in_ball = placed.where("home < 0")
    ball = in_ball.groupBy("home").agg(F.sum("weight").alias("all"), F.min("node").alias("root"))
    certain = in_ball.join(F.broadcast(ball), "home").select("node", (F.col("all") - F.col("weight")).alias("links"), "root")
    found = found.union(certain)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))

    known = nodes.select("node", "digest", "id", "weight").join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    known = known.join(least, "root").select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op13_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
