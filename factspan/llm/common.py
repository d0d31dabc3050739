"""Shared helpers: input shaping, Arrow mapping, bounded samples, tables that cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Documents handled at once inside a Python worker, and sent to it at once; they bound its memory.
SLICE = 256
BATCH_ROWS = 1024
#: Rows up to which a measured table of short rows may be broadcast.
BROADCAST_ROWS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no extra column of the caller can clash with ours."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(df: DataFrame, number: int) -> list[str]:
    """Column names that df does not have."""
    taken = {c.lower() for c in df.columns}
    names = (f"_own{i}" for i in itertools.count())
    return list(itertools.islice((n for n in names if n not in taken), number))


def fold(modulus: int = 5) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a session on one
    machine gets one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext.getCheckpointDir()
        if not made and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: tables that cut lineage need a folder that all executors share")
        if not made:
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "factspan-checkpoints"))
            made = spark.sparkContext.getCheckpointDir()
        found = made
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a
    lost executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factspan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About `rows` rows picked by a hash of id and text (all of them when there are no more)."""
    total = df.count()
    if total <= rows:
        return df
    cut = int((1 << 30) * rows / total)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) < cut)


#: What a worker process keeps between tasks, by operator.
_KEPT: dict[str, tuple] = {}


def enter(operator: str | None) -> None:
    """A task of `operator` begins in this worker: what other operators kept is let go."""
    stale = [k for k in _KEPT if k != operator]
    if stale:
        for k in stale:
            del _KEPT[k]
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, so that it holds none while idle."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keep(operator: str, key: object, make: Callable[[], object]) -> object:
    """An object that the next task of the operator finds again, as long as the key is the same
    object or an equal text."""
    old = _KEPT.get(operator, (None,))[0]
    if old is not key and not (isinstance(key, str) and old == key):
        _KEPT.pop(operator, None)
        _KEPT[operator] = (key, make())
    return _KEPT[operator][1]


def _small_batches(df: DataFrame) -> None:
    """Arrow batches of whole documents are sized down from the default; a size set by the user stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(df: DataFrame, make: Callable[[], Callable], schema: T.StructType, operator: str | None = None) -> DataFrame:
    """Arrow map over batches. ``make()`` runs once per task and returns ``step(*columns)``,
    which gets the columns as lists and returns the output columns as sequences. A step with a
    ``finish`` attribute is asked for a last batch at the end of the task."""
    arrow = to_arrow_schema(schema)

    def batch(cols: Sequence) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(operator)
        step = make()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                out = step(*(c.to_pylist() for c in part.columns))
                if out is not None:
                    yield batch(out)
        finish = getattr(step, "finish", None)
        if finish:
            for out in finish():
                yield batch(out)
        del step
        give_back()

    _small_batches(df)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], operator: str | None = None) -> DataFrame:
    """Arrow map that keeps the schema, over slices of SLICE rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(operator)
        step = make()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                yield step(b.slice(lo, SLICE))
        del step
        give_back()

    _small_batches(df)
    return df.mapInArrow(run, df.schema)

