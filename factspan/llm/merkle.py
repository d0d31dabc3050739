"""Merkle dataset manifest: contiguous digest matrices, one row per aligned block.

Every row of documents is a leaf, the leaves of a source ascend by doc_id, every FANOUT
consecutive nodes become one until one is left (the source's subroot), and the subroots, ordered
by source, become the root in the same way.

1. Leaves are hashed by SQL functions and sorted by range of (source, doc_id), so a source of any
   size lies over many tasks. A leaf's index in its source is its place within its task plus what
   earlier tasks hold of the source, from one count per task and source.
2. FANOUT**HEIGHT consecutive leaves are one aligned block, and a block is one row: its doc_ids
   and two matrices of 64-byte hexadecimal digests (as they are, and after tampering). Within a
   block the matrix is reshaped by the fanout and hashed a level at a time.
3. The blocks' top nodes are the leaves of the same step, until a source has one; the subroots go
   through it once more as one tree. A tree of n leaves takes log(n) / log(FANOUT**HEIGHT) steps.
4. Down again: a block's own way up (its siblings and places) comes by join with the step above.
   A leaf's siblings within its block follow from its index, its way above from its block, so
   proofs are made a block at a time and no proof is ever shuffled.

Defined results: null values are the field `-`; a null doc_id comes first in its source and is
never tampered; rows with the same doc_id are leaves of their own, in order of their hash; a null
source is a source, before all others; a source of one leaf has that leaf as its subroot; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.llm.common import documents, materialise

FANOUT = 3
#: Levels that one block spans: 3**7 = 2,187 leaves, 280 KB of digests.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digest(df: DataFrame, changed: Column | None = None) -> Column:
    return F.sha2(F.concat(*(_field(changed if changed is not None and f == "text" else df[f]) for f in FIELDS)).cast("binary"), 256)


def leaves(df: DataFrame) -> DataFrame:
    """(tree, key, doc_id, leaf, seen): the leaf, and what a reader of tampered rows would hash."""
    doc_id = F.col("doc_id").cast("long")
    tampered = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    seen = F.when(tampered & F.col("text").contains("\n"), _digest(df, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    # in UTF-8 order "-" comes before "s": the tree of the null source is the first
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    return df.select(tree.alias("tree"), doc_id.alias("doc_id"), _digest(df).alias("leaf"), seen.alias("seen"))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes(tree, ...) with index, their place in the tree by `order`, and size, the tree's leaves."""
    # the row's number parts rows that are alike, so that they too can lie over many tasks
    told = nodes.withColumn("tie", F.monotonically_increasing_id())
    spread = told.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    spread = materialise(spread.withColumns({"part": F.spark_partition_id(), "place": place}), "sorted")
    counts = spread.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = counts.groupBy("tree").agg(F.sum("n").alias("size"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(whole, "tree")
    out = spread.join(counts.drop("n"), ["tree", "part"])
    return out.withColumn("index", F.col("before") + F.col("place") - F.col("low")).drop("part", "place", "low", "before")


def _hash_rows(nodes: np.ndarray) -> np.ndarray:
    """One level up: rows of FANOUT digests, the last row with what is left, each become a digest."""
    whole = len(nodes) // FANOUT * FANOUT
    runs = [r.tobytes() for r in nodes[:whole].reshape(-1, FANOUT * _HEX)] + ([nodes[whole:].tobytes()] if whole < len(nodes) else [])
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode(), dtype=np.uint8).reshape(-1, _HEX)


def levels(leaves: np.ndarray, size: int, height: int) -> list[np.ndarray]:
    """The levels of one block, from its leaves up, in a tree of `size` leaves; a block that is its
    whole tree ends at one node, any other after `height` levels, where its tree goes on."""
    out, alone = [leaves], size <= FANOUT**height
    while len(out[-1]) > 1 if alone else len(out) <= height:
        out.append(_hash_rows(out[-1]))
    return out


def _matrix(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, _HEX)


def _block(rows: pa.Table, height: int) -> pa.Table:
    """The rows of one block as one row: ids and digest matrices in order, and the top node."""
    rows = rows.sort_by("index")
    digests = "".join(rows["leaf"].to_pylist())
    seen = "".join(s or l for s, l in zip(rows["seen"].to_pylist(), rows["leaf"].to_pylist()))
    size = rows["size"][0].as_py()
    top = levels(_matrix(digests.encode()), size, height)[-1].tobytes().decode()
    ids = pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64()))
    named = pa.array([rows["name"].to_pylist()], pa.list_(pa.string()))
    return pa.table({
        "tree": rows["tree"][:1], "block": rows["block"][:1], "size": pa.array([size], pa.int64()), "doc_ids": ids, "names": named,
        "digests": pa.array([digests.encode()], pa.binary()), "seen": pa.array([seen.encode()], pa.binary()), "top": pa.array([top]),
    })


_BLOCKS = "tree string, block long, size long, doc_ids array<long>, names array<string>, digests binary, seen binary, top string"


def _blocks(nodes: DataFrame, order: list[str], height: int) -> DataFrame:
    """One row per block of nodes(tree, doc_id, name, leaf, seen)."""
    numbered = _numbered(nodes, order).withColumn("block", F.expr(f"index div {FANOUT**height}"))
    cols = numbered.select("tree", "block", "size", "index", "doc_id", "name", "leaf", "seen")
    return materialise(cols.groupBy("tree", "block").applyInArrow(lambda rows: _block(rows, height), _BLOCKS), "blocks")


def _way(all_levels: list[np.ndarray], i: int) -> tuple[str, str]:
    """Siblings of leaf i, bottom to top, and one letter a level: how many of them are to its left
    and in all (`a` for 0 of 0)."""
    found, places = [], []
    for nodes in all_levels[:-1]:
        lo, at = i - i % FANOUT, i % FANOUT
        run = nodes[lo : lo + FANOUT]
        found.append(run[:at].tobytes() + run[at + 1 :].tobytes())
        places.append(chr(97 + at * FANOUT + len(run) - 1))
        i //= FANOUT
    return b"".join(found).decode(), "".join(places)


def fold(leaf: str, siblings: str, places: str) -> str:
    """The root that follows from a leaf and its way up."""
    for p in places:
        at, others = divmod(ord(p) - 97, FANOUT)
        run, siblings = siblings[: others * _HEX], siblings[others * _HEX :]
        leaf = hashlib.sha256((run[: at * _HEX] + leaf + run[at * _HEX :]).encode()).hexdigest()
    return leaf


_WAYS = "tree string, index long, name string, siblings string, places string, subroot string, root string"
_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _descend(blocks: DataFrame, schema: str, row, height: int) -> DataFrame:
    """blocks with their own way up (siblings, places, subroot, root) to one row per node. A task
    takes one block after the other, so it holds one matrix at a time."""
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[p.split()[1]] for p in schema.split(", ")]
    names = [p.split()[0] for p in schema.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        r = rows.to_pylist()[0]
        steps = levels(_matrix(r["digests"]), r["size"], height)
        made = zip(*(row(r, steps, i, height) for i in range(len(r["doc_ids"]))))
        return pa.table([pa.array(c, t) for c, t in zip(made, types)], names=names)

    return blocks.groupBy("tree", "block").applyInArrow(run, schema)


def _node(r: dict, steps: list[np.ndarray], i: int, height: int) -> tuple:
    siblings, places = _way(steps, i)
    index = r["block"] * FANOUT**height + i
    root = r["root"] or r["top"]  # the top of the last tree of all is the root
    return r["tree"], index, r["names"][i], siblings + (r["siblings"] or ""), places + (r["places"] or ""), r["subroot"], root


def _proof(r: dict, steps: list[np.ndarray], i: int, height: int) -> tuple:
    siblings, places = _way(steps, i)
    siblings, places = siblings + r["siblings"], places + r["places"]
    leaf, seen = (r[k][_HEX * i : _HEX * (i + 1)].decode() for k in ("digests", "seen"))
    folded = fold(seen, siblings, places)
    return r["doc_ids"][i], leaf, r["subroot"], r["root"], hashlib.sha256(siblings.encode()).hexdigest(), folded, folded == r["root"]


def _climb(nodes: DataFrame, order: list[str], height: int) -> list[DataFrame]:
    """The steps of blocks, from the leaves up to where every tree is one block."""
    steps, none = [_blocks(nodes, order, height)], F.lit(None).cast("string")
    while (above := steps[-1].where(F.col("size") > FANOUT**height)).head(1):
        up = above.select("tree", F.col("block").alias("doc_id"), none.alias("name"), F.col("top").alias("leaf"), none.alias("seen"))
        steps.append(_blocks(up, ["doc_id"], height))
    return steps


_WAY = ("siblings", "places", "subroot", "root")


def _ways_down(steps: list[DataFrame], tops: DataFrame, height: int, row, schema: str) -> DataFrame:
    """One row per leaf of the lowest step. tops(tree, siblings, places, subroot, root) is what
    lies above each tree; a block of a larger tree goes on from its node of the step above."""
    ways = None
    for step in reversed(steps):
        placed = step.where(F.col("size") <= FANOUT**height).join(tops, "tree")
        if ways is not None:
            up = ways.select("tree", F.col("index").alias("block"), *_WAY)
            placed = placed.unionByName(step.where(F.col("size") > FANOUT**height).join(up, ["tree", "block"]))
        if step is not steps[0]:
            ways = materialise(_descend(placed, _WAYS, _node, height), "ways")
    return _descend(placed, schema, row, height)


def manifest(df: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; blocks
    span `height` levels, which changes nothing in the result."""
    none = F.lit(None).cast("string")
    low = _climb(leaves(df).withColumn("name", none), ["doc_id", "leaf"], height)
    subroots = reduce(DataFrame.union, (step.where(F.col("size") <= FANOUT**height).select("tree", "top") for step in low))
    nodes = subroots.select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("name"), F.col("top").alias("leaf"), none.alias("seen"))
    high = _climb(nodes, ["name"], height)

    nothing = high[-1].select("tree", *(none.alias(c) for c in _WAY))
    above = _ways_down(high, nothing, height, _node, _WAYS).select(F.col("name").alias("tree"), "siblings", "places", "root")
    above = materialise(above.join(subroots.withColumnRenamed("top", "subroot"), "tree"), "subroots")
    return _ways_down(low, above, height, _proof, _PROOFS)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))
