"""Cross-tokenizer alignment by elementary intervals.

Two tokenisations of one text give two sorted arrays of byte ends. Their union cuts the text into
elementary intervals, each owned by one token of either side (searchsorted of the interval's end):
an interval is one overlap of two tokens. Where both tokens end, a group closes, and the tokens of
a group are linked each with each: group products expand to links of ids.

1. Every document is tokenised once, by chunks: where a space that follows no space stands before
   something other than white space, both tokenisers begin a new token whatever is around it (the
   byte-level splitter begins a word there, and no piece has its space mark inside; the latter is
   checked when a vocabulary is read). A worker remembers the ids of chunks. A document's statistics
   and its distinct id pairs, each with the number of its links, are written as one row; equal
   tokens of a long group expand once, by their number.
2. How many documents hold a pair is counted from these rows: every task sums its own pairs first,
   so a pair that all documents share is a few rows a task, and the sums are added by pair.
3. A document's pairs meet these counts again. While the measured table of counts is at most
   BROADCAST_PAIRS pairs, every worker has it as sorted arrays; beyond that, pairs and counts are
   joined by shuffle and summed by document. Both ways give the same result.

Defined results: null, empty and unfaithful texts (the joined bytes of a side's tokens differ from
a space and the text) have no tokens: zeros and an empty groups_sha256. Special tokens are plain
text. Rows with null ids and repeated rows come back once each and count as documents; an empty
table gives an empty result; extra columns are ignored. A text of any length is one row; only its
arrays are held.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm.common import documents, enter, give_back, id_text, keep, map_texts, materialise

#: Pairs (12 bytes each) up to which a worker holds the counts; the counter of a task holds as many.
BROADCAST_PAIRS = 2_000_000
#: Links of a group above which its equal tokens are put together before they expand.
_WIDE = 4096


def vocabulary_paths() -> tuple[str, str]:
    """Files of the byte-level vocabulary (as ranks; its ids are those of its JSON form) and the piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Encoders:
    """Both tokenisers, and the bytes of every token of either."""

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(paths[0], "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("a piece has a space mark inside: texts cannot be cut at spaces")
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, chunks: list[str]) -> list[tuple[bytes, bytes] | bool]:
        """Ids of either side, as unsigned 16-bit numbers, of chunks written without their leading
        space; False for a chunk that the tokens' bytes do not give back. Chunks that begin and end
        with something other than a space are encoded as one text, which chunks fall apart in again."""
        if len(chunks) > 1:
            plain = [bool(c) and not c[0].isspace() and c[-1] != " " for c in chunks]
            whole = self._together([c for c, p in zip(chunks, plain) if p])
            if whole is not None:
                own = iter(whole)
                return [next(own) if p else self([c])[0] for c, p in zip(chunks, plain)]
            middle = len(chunks) // 2  # one of them is not given back: look for it
            return self(chunks[:middle]) + self(chunks[middle:])
        return self._together(chunks) or [False] * len(chunks)

    def _together(self, chunks: list[str]) -> list[tuple[bytes, bytes]] | None:
        if not chunks:
            return []
        raw = [b" " + c.encode() for c in chunks]
        ends, whole, text = np.cumsum(list(map(len, raw))), b"".join(raw), " ".join(chunks)
        sides = []
        for ids, known, sizes in ((self.a.encode_ordinary(" " + text), self.bytes_a, self.sizes_a), (self.b.encode(text, num_threads=1), self.bytes_b, self.sizes_b)):
            if b"".join(map(known.__getitem__, ids)) != whole:
                return None
            packed = array("H", ids).tobytes()
            cuts = (2 * np.searchsorted(np.cumsum(sizes[ids]), ends, side="right")).tolist()
            sides.append([packed[x:y] for x, y in zip([0, *cuts], cuts)])
        return list(zip(*sides))


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every elementary interval its owner on either side, and whether a group closes with it."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def group_sizes(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side each group has."""
    a, b, closes = intervals(ends_a, ends_b)
    return np.diff(a[closes], prepend=-1), np.diff(b[closes], prepend=-1)


def pair_links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs as a * width + b and the links that each stands for; a pair may come more than once."""
    at_a, at_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    plain = np.flatnonzero(na * nb <= _WIDE)
    n, m, p, q = na[plain], nb[plain], at_a[plain], at_b[plain]
    links = n * m
    group = np.repeat(np.arange(len(n)), links)
    k = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    keys = [a[p[group] + k // m[group]] * width + b[q[group] + k % m[group]]]
    times = [np.ones(len(group), dtype=np.int64)]
    for g in np.flatnonzero(na * nb > _WIDE):
        (ua, ca), (ub, cb) = (np.unique(ids[lo : lo + c], return_counts=True) for ids, lo, c in ((a, at_a[g], na[g]), (b, at_b[g], nb[g])))
        keys.append((ua[:, None] * width + ub).ravel())
        times.append((ca[:, None] * cb).ravel())
    return np.concatenate(keys), np.concatenate(times)


#: A text with one of these has chunks that a plain split at spaces does not give.
_UNEVEN = re.compile(r" (?:\s|$)|^ ")
_BEGINS = re.compile(r"(?<=[^ ]) (?=\S)")
#: Chunks that a worker remembers.
REMEMBERED = 100_000


def chunks_of(text: str) -> list[str]:
    return _BEGINS.split(text) if _UNEVEN.search(text) else text.split(" ")


class Chunks:
    """The ids of texts by way of their chunks. Two generations are remembered, so that a frequent
    chunk is never forgotten; a chunk is learnt with all new ones of a call."""

    def __init__(self, paths: tuple[str, str]):
        self.encode = Encoders(paths)
        self.width = self.encode.b.get_piece_size()
        self.known: dict[str, tuple[bytes, bytes] | bool] = {}
        self.older: dict[str, tuple[bytes, bytes] | bool] = {}

    def __call__(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides of every text of chunks; None where there are no tokens."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = [list(map(known.get, chunks)) for chunks in texts]
        missing = {c for chunks, got in zip(texts, found) if None in got for c, x in zip(chunks, got) if x is None}
        if missing:
            known.update((c, older[c]) for c in missing if c in older)
            new = [c for c in missing if c not in known]
            known.update(zip(new, self.encode(new)))
            found = [list(map(known.get, chunks)) if None in got else got for chunks, got in zip(texts, found)]
        return [None if not got or False in got else tuple(np.frombuffer(b"".join(s), dtype=np.uint16).astype(np.int64) for s in zip(*got)) for got in found]


class Reader:
    """How the groups of a text read: every id has two forms of equal width, one before another id of
    its side and one at the end of its side's run; padding is left out at the end."""

    def __init__(self, size_a: int, size_b: int):
        forms = [f"{i}{end}" for size, last in ((size_a, "|"), (size_b, ";")) for i in range(size) for end in (",", last)]
        self.table = np.array(forms, dtype="S6")
        self.b_side = 2 * size_a

    def __call__(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> bytes:
        end_a, end_b = np.cumsum(na), np.cumsum(nb)
        row_a, row_b = 2 * a, self.b_side + 2 * b
        row_a[end_a - 1] += 1
        row_b[end_b - 1] += 1
        rows = np.empty(len(a) + len(b), dtype=np.int64)
        rows[np.arange(len(a)) + np.repeat(end_b - nb, na)] = row_a  # a group's first ids stand behind the others' of earlier groups
        rows[np.arange(len(b)) + np.repeat(end_a, nb)] = row_b
        return self.table[rows].tobytes().replace(b"\0", b"")[:-1]


def aligned(sides: tuple[np.ndarray, np.ndarray] | None, encode: Encoders, read: Reader, width: int) -> tuple:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and links of a text's ids."""
    if sides is None:
        return _NOTHING
    a, b = sides
    na, nb = group_sizes(np.cumsum(encode.sizes_a[a]), np.cumsum(encode.sizes_b[b]))
    digest = hashlib.sha256(read(a, b, na, nb)).hexdigest()
    pairs, times = pair_links(a, b, na, nb, width)
    found, where = np.unique(pairs, return_inverse=True)
    links = np.bincount(where, weights=times, minlength=len(found)).astype(np.int64)
    return len(a), len(b), len(na), int((na * nb).sum()), digest, found, links


_NOTHING = (0, 0, 0, 0, "", [], [])
_ROWS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.LongType())),
])


def _aligned(paths: tuple[str, str]):
    def begin():
        chunks = Chunks(paths)
        return chunks, Reader(len(chunks.encode.sizes_a), len(chunks.encode.sizes_b))

    chunks, read = keep("alignment", repr(paths), begin)

    def step(ids, texts):
        sides = chunks([chunks_of(t) if t else [] for t in texts])
        return [ids, *zip(*(aligned(s, chunks.encode, read, chunks.width) for s in sides))]

    return step


class _Tally:
    """How many documents of a task hold each pair; passed on whenever it grows to `most` pairs."""

    def __init__(self, most: int):
        self.most, self.waiting, self.size = most, [], 0
        self.pairs, self.docs = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.waiting.append(pairs)
        self.size += len(pairs)
        if self.size > max(1 << 20, len(self.pairs)):
            self._sum()
            if len(self.pairs) >= self.most:
                yield from self.out()

    def _sum(self) -> None:
        new = np.concatenate([self.pairs, *self.waiting])
        weights = np.concatenate([self.docs, np.ones(len(new) - len(self.pairs), dtype=np.int64)])
        self.pairs, where = np.unique(new, return_inverse=True)
        self.docs = np.bincount(where, weights=weights, minlength=len(self.pairs)).astype(np.int64)
        self.waiting, self.size = [], 0

    def out(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._sum()
        for lo in range(0, len(self.pairs), 1 << 16):
            yield self.pairs[lo : lo + (1 << 16)], self.docs[lo : lo + (1 << 16)]
        self.pairs, self.docs = self.pairs[:0], self.docs[:0]


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _tallied(rows: DataFrame, most: int) -> DataFrame:
    def run(batches):
        enter("alignment-counts")
        tally = _Tally(most)
        for b in batches:
            for pairs, docs in tally.add(_flat(b.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=_COUNTS.names)
        for pairs, docs in tally.out():
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=_COUNTS.names)
        give_back()

    return rows.select("pairs").mapInArrow(run, _COUNTS)


_COUNTS = T.StructType([T.StructField("pair", T.LongType()), T.StructField("docs", T.LongType())])
_SUMS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups_sha256", T.StringType())])


def pair_counts(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(pair, docs, best): how many documents hold a pair, and whether no pair of its A id is held by more."""
    docs = _tallied(rows, most).groupBy("pair").agg(F.sum("docs").alias("docs"))
    docs = materialise(docs, "pairs")
    top = docs.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("docs").alias("top"))
    joined = docs.withColumn("a", F.expr(f"pair div {width}")).join(top, "a")
    return materialise(joined.select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "counts")


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.orderBy("pair").toArrow()
    arrays = table["pair"].to_numpy(), np.where(table["best"].to_numpy(), 1, 0).astype(np.int8), table["docs"].to_numpy().astype(np.int64)
    sent = rows.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        enter("alignment-sums")
        known, best, docs = sent.value
        for b in batches:
            at = np.searchsorted(known, _flat(b.column("pairs")))
            links = _flat(b.column("links"))
            ends = np.concatenate(([0], np.cumsum(b.column("pairs").value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(links * x[at])))[ends])) for x in (best, docs)]
            own = dict(zip(b.schema.names, b.columns)) | dict(zip(("n_best", "count_sum"), sums))
            yield pa.RecordBatch.from_arrays([own[c] for c in _SUMS.names], names=_SUMS.names)
        give_back()

    return rows.mapInArrow(run, _SUMS)


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by shuffle; the rows' numbers stand for ids, which may be null or repeated."""
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
    none = F.lit(0).cast("long")
    out = rows.drop("pairs", "links").join(sums, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")})
    return out.select(*_SUMS.names)


def align(df: DataFrame, paths: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Numbers of tokens, groups and links of every row, and how common its links are in df."""
    import sentencepiece

    paths = paths or vocabulary_paths()
    width = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    rows = map_texts(id_text(df), lambda: _aligned(paths), _ROWS, "alignment")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, width, broadcast_pairs)
    if counts.count() <= broadcast_pairs:
        return _looked_up(rows.drop("row"), counts)
    return _joined(rows, counts)


def op11_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
