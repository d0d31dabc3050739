"""Best-fit packing with large-item matching.

Every document becomes token ids and an end id; only documents above CAPACITY are cut, into
full pieces and one rest. Packing needs lengths alone, so the plan is made from one number per
length (at most CAPACITY numbers, whatever the corpus):

1. a large piece (above a third of CAPACITY) shares a sequence with at most one other large
   piece: from the longest down, it is matched with the longest partner that still fits;
2. small pieces, from the longest down, go to the sequence with the smallest gap that holds
   them; when none is left, new sequences open.

Sequences of one gap are interchangeable, so the plan works on runs of them and is a short
table (length, ranks, first sequence, offset). Each piece finds its place by its rank among
the pieces of its length: ranks come from counts per task and length, never from one sorted
group, so a length that a third of all pieces share is no hot spot. Long runs of the plan are
cut into blocks of ranks to make the join an equi-join.

Defined results: a null text is empty and packs as its end id alone; null ids and repeated
rows keep their pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factspan.llm.common import documents, id_text, keep, map_texts, materialise

CAPACITY = 4096
END_ID = 1
BLOCK = 4096
#: Bytes of chunks and ids that a Python worker remembers, and what an entry takes beside them.
CACHE = 56 << 20
_ENTRY = 160


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """Ids by chunk. A chunk that is looked up and not there is taken over from the generation before or, as
    a word of lower-case Latin letters, which is one piece as it is, goes straight to the merges; all
    else is None and put off for the whole library."""

    def __init__(self, merge: Callable, mapped: dict[int, str], before: dict[str, bytes]):
        super().__init__({"": b""})
        self.merge, self.mapped, self.before = merge, mapped, before
        self.size = 0
        self.later: set[str] = set()

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.before.get(chunk)
        if ids is None:
            if not (chunk.isalpha() and chunk == chunk.lower()):
                self.later.add(chunk)
                return None
            if chunk.isascii():
                word = chunk
            elif not _BEYOND_LATIN.search(chunk):
                word = chunk.translate(self.mapped)
            else:
                self.later.add(chunk)
                return None
            ids = array("I", [x.id for x in self.merge(word)]).tobytes()
        self.keep(chunk, ids)
        return ids

    def keep(self, chunk: str, ids: bytes) -> None:
        self[chunk] = ids
        self.size += len(chunk) + len(ids) + _ENTRY


class ChunkTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, by way of their chunks.

    The vocabulary's normaliser maps white space to one space and its splitter drops it, so a
    chunk's ids do not depend on its neighbours; known chunks are looked up, new words are
    learnt as they are met, and all other new chunks of a call go through the library as one text, cut
    again at their places. Texts of Latin letters
    are lower-cased first, as the normaliser does one character at a time, and marks that
    end a chunk after a word become a chunk of their own, as the splitter has it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        from tokenizers.pre_tokenizers import ByteLevel

        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = (chr(c) for c in range(0x80, 0x250) if chr(c).isalpha() and chr(c) == chr(c).lower())
        self.mapped = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self.known = self._generation({})

    def _generation(self, before: dict[str, bytes]) -> _Known:
        return _Known(self.tokenizer.model.tokenize, self.mapped, before)

    def _learn(self, missing: list[str]) -> None:
        """Chunks that take the whole library."""
        for lo in range(0, len(missing), 4096):
            part = missing[lo : lo + 4096]
            starts = np.cumsum([0] + [len(c) + 1 for c in part[:-1]])
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4")
            begins = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            cuts = np.searchsorted(begins, starts).tolist() + [len(ids)]
            raw = ids.tobytes()
            for c, x, y in zip(part, cuts, cuts[1:]):
                self.known.keep(c, raw[4 * x : 4 * y])

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, found, put_off = self.known, [], []
        for t in texts:
            if (t.isascii() or not _BEYOND_LATIN.search(t)) and "<|" not in t:
                t = (_MARKS if _SYMBOL.search(t) else _LONE_MARK).sub(r" \g<0>", t.lower())
            chunks = t.replace("\n", " ").split(" ")
            got = list(map(known.__getitem__, chunks))
            if known.later and None in got:
                put_off.append((len(found), chunks))
                found.append(got)
            else:
                found.append(b"".join(got))
        if put_off:
            self._learn(list(known.later))
            known.later.clear()
            for i, chunks in put_off:
                found[i] = b"".join([known[c] if x is None else x for c, x in zip(chunks, found[i])])
        if known.size > CACHE // 2:
            known.before = {}
            self.known = self._generation(known)
        return found


#: Outside it, or for the dotted capital I, lower-casing and composition depend on more than one character.
_BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
_LONE_MARK = re.compile(r"[.,](?<=[^\W_][.,])(?=\s|$)")
#: The same for any run of marks after a word; slower to find, and rarely needed.
_MARKS = re.compile(r"(?<=[^\W_])[^\w\s]++(?=\s|$)")
_SYMBOL = re.compile("[!#$%&*]")


def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process: what it has learnt serves the next task."""
    return keep("packing", path, lambda: ChunkTokenizer(path))


_PIECES = [
    ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
    ("task", T.IntegerType()), ("place", T.LongType()),
]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document; (task, length, place) numbers the pieces of a length within a task."""
    fields = [T.StructField(n, t) for n, t in _PIECES] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])

    def make():
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        encode = tokenizer(path)
        end = end_id.to_bytes(4, "little")
        seen: dict[int, int] = {}

        def step(doc_ids, texts):
            out: list[list] = [[] for _ in fields]
            for doc_id, ids in zip(doc_ids, encode([t or "" for t in texts])):
                ids += end
                for k, lo in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * lo : 4 * (lo + capacity)]
                    n = len(part) // 4
                    place = seen.get(n, 0)
                    seen[n] = place + 1
                    row = (doc_id, k, lo, n, zlib.crc32(part), task, place)
                    for col, v in zip(out, row):
                        col.append(v)
                    if with_ids:
                        out[-1].append(np.frombuffer(part, dtype="<i4"))
            return out

        return step

    return map_texts(id_text(df), make, T.StructType(fields), "packing")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number, first sequence, offset): piece `first rank + i` of that
    length goes to sequence `first sequence + i`."""
    left = {n: c for n, c in counts.items() if c}
    rank: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}

    def place(length: int, number: int, first: int, offset: int) -> None:
        at = rank.get(length, 0)
        rank[length] = at + number
        left[length] -= number
        rows.append((length, at, number, first, offset))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        partner = [m for m in large if m <= n]
        while left[n]:
            fit = next((m for m in partner if n + m <= capacity and left[m] and (m != n or left[n] > 1)), None)
            number = left[n] if fit is None else left[n] // 2 if fit == n else min(left[n], left[fit])
            place(n, number, sequences, 0)
            if fit is not None:
                place(fit, number, sequences, n)
            gaps.setdefault(capacity - n - (fit or 0), []).append((sequences, number))
            sequences += number

    open_gaps = sorted(g for g in gaps if g > 0)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(open_gaps, n)
            if i == len(open_gaps):
                gaps.setdefault(capacity, []).append((sequences, -(-left[n] // (capacity // n))))
                sequences += gaps[capacity][-1][1]
                insort(open_gaps, capacity)
                continue
            gap = open_gaps[i]
            runs, moved = gaps[gap], []
            while runs and left[n]:
                first, number = runs.pop()
                take = min(number, left[n])
                place(n, take, first, capacity - gap)
                moved.append((first, take))
                if take < number:
                    runs.append((first + take, number - take))
            if not runs:
                del gaps[gap]
                open_gaps.pop(i)
            rest = gap - n
            if rest:
                if rest not in gaps:
                    gaps[rest] = []
                    insort(open_gaps, rest)
                gaps[rest] += moved
    return rows


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; with_ids adds the token ids themselves."""
    spark = df.sparkSession
    cut = materialise(pieces(df, path or tokenizer_path(), capacity, end_id, with_ids), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "piece-counts")
    per_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(per_length, capacity)
    placed = spark.createDataFrame(rows, "length long, first long, number long, sequence long, offset long")
    placed = placed.withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(first + number - 1) div {BLOCK}"))))
    base = counts.select("task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place")).withColumn("block", F.expr(f"rank div {BLOCK}"))
    out = ranked.alias("r").join(placed.alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("r.block") == F.col("p.block")) & F.col("r.rank").between(F.col("p.first"), F.col("p.first") + F.col("p.number") - 1))
    names = [n for n, _ in _PIECES[:5]]
    return out.select(*(F.col(f"r.{n}") for n in names), (F.col("p.sequence") + F.col("r.rank") - F.col("p.first")).alias("sequence_id"), F.col("p.offset").alias("offset"), *([F.col("r.ids")] if with_ids else []))


def op6_pack_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
