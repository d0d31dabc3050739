"""Named extensions: gates, note kinds, tokenisers (survey 2.18, J18, M11, G6)."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed set of extension kinds.
KINDS = ("gate", "note_kind", "memory_profile", "tokeniser")


class RegistryError(ValueError):
    pass


@dataclass
class Registry:
    entries: dict[tuple[str, str], object] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def register(self, kind: str, name: str, value: object) -> None:
        """Kinds are closed, and nothing is shadowed."""
        if kind not in KINDS:
            raise RegistryError(f"unknown kind: {kind}")
        if (kind, name) in self.entries:
            raise RegistryError(f"already registered: {kind}:{name}")
        self.entries[kind, name] = value

    def load(self, provider: Callable[[], list[tuple[str, str, object]]]) -> None:
        """A provider that fails is recorded and registers nothing."""
        try:
            found = list(provider())
        except Exception as e:  # noqa: BLE001
            self.errors.append((getattr(provider, "__name__", "?"), type(e).__name__))
            return
        for kind, name, value in found:
            self.register(kind, name, value)

    def require(self, kind: str, name: str) -> object:
        if (kind, name) not in self.entries:
            raise RegistryError(f"not registered: {kind}:{name}")
        return self.entries[kind, name]

    def manifest(self, spark: SparkSession) -> DataFrame:
        """(kind, name, digest): the digest is that of the source code."""
        rows = [(k, n, code_digest(v)) for (k, n), v in sorted(self.entries.items())]
        return spark.createDataFrame(rows, "kind string, name string, digest string")


def code_digest(value: object) -> str:
    try:
        text = inspect.getsource(value)
    except (TypeError, OSError):
        text = repr(value)
    return hashlib.sha256(text.encode()).hexdigest()


def mismatches(declared: DataFrame, installed: DataFrame) -> DataFrame:
    """Declared extensions that are missing or whose code differs."""
    i = installed.select("kind", "name", F.col("digest").alias("found"))
    d = declared.join(i, ["kind", "name"], "left").where(~F.col("digest").eqNullSafe(F.col("found")))
    return d.select("kind", "name", F.when(F.col("found").isNull(), "missing").otherwise("changed").alias("problem"))


def gate_column(gate: Callable[[str, str], str | None], question: Column, answer: Column) -> Column:
    """A gate as a vectorised column: null lets pass, a code refuses; it fails closed, an
    exception or an odd value is a refusal that names its class."""

    @F.pandas_udf(T.StringType())
    def judged(questions: pd.Series, answers: pd.Series) -> pd.Series:
        def one(q, a):
            try:
                code = gate(q, a)
            except Exception as e:  # noqa: BLE001
                return f"filter_error:{type(e).__name__}"
            return code if code is None or isinstance(code, str) else "filter_error:value"

        return pd.Series([one(q, a) for q, a in zip(questions, answers)], dtype=object)

    return judged(question, answer)


def annotate(rows: DataFrame, kinds: dict[str, Callable[[str], str | None]]) -> DataFrame:
    """(sid, kind, text) notes of every registered kind over (sid, sent)."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            out = [(s, k, note) for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, f in kinds.items() if (note := f(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["sid", "kind", "text"])

    return rows.select("sid", "sent").mapInArrow(run, schema)
