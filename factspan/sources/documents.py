"""Document scans and sentence rows (survey S1-S7, S14, S15, S18)."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factspan.functions.redaction import REDACT, REDACT_AFTER
from factspan.functions.text import CLOSE_BRACKETS, CLOSERS, ENDS, OPEN_BRACKETS

SUFFIXES = (".txt", ".md", ".markdown")
LARGEST = 8 * 1024 * 1024
# List and heading marks, code fences.
_MARK = re.compile(r"^\s*(?:#{1,6}\s+|>+\s*|[-*+]\s+|\d{1,3}[.)]\s+)")
_FENCE = re.compile(r"^\s*(```|~~~)")

CORPUS_ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("sha", "title", "sent", "source")])


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """Title, path, size and text of every document below a folder.

    Hidden files and folders and other suffixes are skipped. A title is the base name if that is
    unique, else the relative path without suffix, else the relative path; ``#`` becomes ``＃``.
    Files above LARGEST raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,markdown}").load(path)
    root = F.regexp_replace(F.lit(path.rstrip("/")), "^[a-z0-9]+:/*", "/")
    plain = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    rel = F.expr("substring(p, length(r) + 2)")
    d = files.withColumn("p", plain).withColumn("r", root).withColumn("rel", rel).where(~F.col("rel").rlike(r"(^|/)\."))
    d = d.withColumn("stem", F.regexp_replace("rel", r"\.(txt|md|markdown)$", "")).withColumn("base", F.regexp_extract("stem", "([^/]*)$", 1))
    many = lambda c: F.count(F.lit(1)).over(W.partitionBy(c))
    title = F.when(many("base") == 1, F.col("base")).when(many("stem") == 1, F.col("stem")).otherwise(F.col("rel"))
    title = F.replace(title, F.lit("#"), F.lit("＃"))
    text = F.when(F.col("length") <= LARGEST, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("docs_too_large: "), F.col("path"))))
    return d.select(title.alias("title"), "path", F.col("length").alias("size"), text.alias("text"))


def sentences_of(text: str | None, ends: str = ENDS) -> list[str]:
    """S2 for one text: marks stripped, fences skipped, cut after a terminator and what closes
    with it, at bracket depth 0, and at line ends."""
    out, fenced = [], False
    for raw in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if _FENCE.match(raw):
            fenced = not fenced
        elif not fenced:
            out += _cut(_MARK.sub("", raw).strip(), ends)
    return out


def _cut(line: str, ends: str) -> list[str]:
    out, depth, begin, i = [], 0, 0, 0
    while i < len(line):
        c = line[i]
        i += 1
        if c in OPEN_BRACKETS:
            depth += 1
        elif c in CLOSE_BRACKETS:
            depth = max(0, depth - 1)
        elif c in ends and not depth:
            while i < len(line) and line[i] in ends + CLOSERS:
                i += 1
            out.append(line[begin:i].strip())
            begin = i
    out.append(line[begin:].strip())
    return [s for s in out if s]


#: What a text has that is not cut by patterns alone: brackets, fences, white space beside blanks,
#: tabs and line ends.
_INTRICATE = (*OPEN_BRACKETS, *CLOSE_BRACKETS, "```", "~~~", *map(chr, (11, 12, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PLAIN_MARK = r"^[ \t]*(?:#{1,6}[ \t]+|>+[ \t]*|[-*+][ \t]+|\p{Nd}{1,3}[.)][ \t]+)"


def split_sentences(docs: DataFrame, key: str = "doc_id", ends: str = ENDS + ".") -> DataFrame:
    """S2 over a table: (key, k, sent). Texts without brackets and fences are cut by patterns; the
    others need a bracket depth and go over Arrow."""
    d = docs.select(key, F.col("text").cast("string").alias("text"))
    intricate = functools.reduce(operator.or_, (F.contains(F.col("text"), F.lit(x)) for x in _INTRICATE))  # faster than one pattern
    return _split_plain(d.where(~intricate), key, ends).union(_split_intricate(d.where(intricate), key, ends))


def _split_plain(docs: DataFrame, key: str, ends: str) -> DataFrame:
    """Marks go at line starts, a line end is put in after each terminator, and lines are sentences."""
    end = re.escape(ends)
    text = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), f"(?dm){_PLAIN_MARK}", "")
    text = F.regexp_replace(text, f"[{end}][{end}{re.escape(CLOSERS)}]*+", "$0\n")
    sents = F.filter(F.transform(F.split(text, "[ \t]*\n[ \t\n]*"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")
    return docs.select(key, F.posexplode(sents).alias("k", "sent"))


def _split_intricate(docs: DataFrame, key: str, ends: str) -> DataFrame:
    import pyarrow as pa

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("k", T.IntegerType()), T.StructField("sent", T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids, ks, sents = [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = sentences_of(text, ends)
                    ids += [i] * len(found)
                    ks += range(len(found))
                    sents += found
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((ids, ks, sents), arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)


def redact(c: Column) -> Column:
    """L14 for text as written: every pattern in order, key and value pairs keep their key."""
    for name, pattern in REDACT:
        c = F.regexp_replace(c, pattern, f"[REDACTED:{name}]")
    for name, pattern in REDACT_AFTER:
        c = F.regexp_replace(c, pattern, f"$1[REDACTED:{name}]")
    return c


def corpus_rows(sentences: DataFrame, title: Column) -> DataFrame:
    """S3: sha, title, redacted sentence and its source ``title#k``."""
    d = sentences.withColumn("sent", redact(F.col("sent"))).withColumn("title", F.replace(title.cast("string"), F.lit("#"), F.lit("＃")))
    return d.select(F.sha2("sent", 256).alias("sha"), "title", "sent", F.concat_ws("#", "title", F.col("k").cast("string")).alias("source"), "k")


def corpus_digest(rows: DataFrame) -> DataFrame:
    """One content address per title (canonical JSON lines in order), so no task holds more
    than a document; the corpus address is the digest of those digests."""
    line = F.to_json(F.struct("sent", "sha", "source", "title"))
    return rows.groupBy("title").agg(F.sha2(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n")), 256).alias("sha"), F.count(F.lit(1)).alias("n"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CORPUS_ROW) -> DataFrame:
    """Lines that do not parse come back in _corrupt_record."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)


def read_bank(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """A tab-separated question bank; gold splits on | and evidence on ;."""
    d = spark.read.csv(path, sep="\t", header=True, quote='"' if quoted else "\u0000", escape='"' if quoted else "\u0000")
    d = d.toDF(*(c.lstrip("#") for c in d.columns))
    return d.withColumn("gold", F.split("gold", r"\|")).withColumn("evidence", F.split("evidence", ";"))


def manifest_mismatches(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(name, expected, found) for every file whose digest differs or that is missing."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    return manifest.join(files, "name", "left").where(~F.col("sha").eqNullSafe(F.col("found"))).select("name", F.col("sha").alias("expected"), "found")


def make_source(store: Column, session: Column, i: Column, role: Column | None = None) -> Column:
    """Mem:<store>/<session>#<i>[:role]."""
    plain = F.concat(F.lit("mem:"), store, F.lit("/"), session, F.lit("#"), i.cast("string"))
    return plain if role is None else F.concat(plain, F.coalesce(F.concat(F.lit(":"), role), F.lit("")))


def parse_source(c: Column) -> Column:
    """S14 back: a struct of store, session, i and role; nulls where it is no such source."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^mem:([^/]+)/([^#]+)#(\d+)(?::(\w+))?$", k), F.lit(""))
    return F.struct(part(1).alias("store"), part(2).alias("session"), part(3).cast("long").alias("i"), part(4).alias("role"))


def mixed_sources(rows: DataFrame, memory: bool) -> DataFrame:
    """The rows that break the rule that memory rows and base rows never mix."""
    is_memory = F.col("source").startswith("mem:")
    return rows.where(~is_memory if memory else is_memory)
