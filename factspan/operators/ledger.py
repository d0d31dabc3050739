"""Hash-chained ledgers: seal, verify, status, caps, budgets (survey L1-L5, L7, L17, S8, S9, W8-W11, W15, X12, J17)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factspan.operators.folds import ordered_fold

ROOT = "0" * 64
# The statuses of a ledger, what makes a line a tampered one, and the fields of a row.
STATUS = ("OK", "EMPTY", "HEAD_MISMATCH", "TORN_TAIL", "TAMPERED")
LINE_PROBLEMS = ("LINE_UNPARSABLE", "BAD_SHAPE", "BAD_INDEX", "SHA_MISMATCH", "PREV_MISMATCH", "NONCANONICAL_LINE")
ROW_FIELDS = ("v", "i", "actor", "op", "args", "result", "state_sha", "prev", "sha")
REDACTED_FIELDS = ("redacted", "args_sha256")
TRUNCATED_FIELDS = ("truncated", "args_sha256", "args_chars")
_SHA_FIELD = r',"sha":"[0-9a-f]{64}"(?=,"state_sha":"[0-9a-f]{64}"(?:,"truncated":true)?,"v":1\}$)'


def seal(rows: DataFrame, run: str, order: str, body: Column) -> DataFrame:
    """Every row of a run gets i, prev and sha = sha256(prev | i | body). The chain is
    sequential within a run by definition; runs are dealt out and each is streamed in order."""
    d = rows.select(F.col(run).alias("run"), F.col(order).alias("o"), body.alias("body"))
    schema = T.StructType([T.StructField("run", d.schema["run"].dataType), T.StructField("i", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("body", "prev", "sha"))])

    def step(state, row):
        prev, i = state
        sha = hashlib.sha256(f"{prev}|{i}|{row[2]}".encode()).hexdigest()
        return (sha, i + 1), [(row[0], i, row[2], prev, sha)]

    return ordered_fold(d, ["run"], "o", schema, lambda: (ROOT, 0), step)


def extend(heads: DataFrame, rows: DataFrame, run: str, order: str, body: Column) -> DataFrame:
    """Seal more rows onto runs that end at heads(run, head, n); new runs start at the root.
    Extending by parts equals sealing the whole."""
    d = rows.select(F.col(run).alias("run"), F.col(order).alias("o"), body.alias("body")).join(heads, "run", "left")
    schema = T.StructType([T.StructField("run", d.schema["run"].dataType), T.StructField("i", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("body", "prev", "sha"))])

    def step(state, row):
        _, _, text, last, n = row
        prev, i = state or (last or ROOT, n or 0)
        sha = hashlib.sha256(f"{prev}|{i}|{text}".encode()).hexdigest()
        return (sha, i + 1), [(row[0], i, text, prev, sha)]

    return ordered_fold(d.select("run", "o", "body", "head", "n"), ["run"], "o", schema, lambda: None, step)


def head(chain: DataFrame) -> DataFrame:
    return chain.groupBy("run").agg(F.max_by("sha", "i").alias("head"), F.count(F.lit(1)).alias("n"))


def problems(chain: DataFrame) -> DataFrame:
    """Per row the digests and links that do not hold; rows are checked in parallel."""
    w = W.partitionBy("run").orderBy("i")
    expect = F.sha2(F.concat_ws("|", "prev", F.col("i").cast("string"), "body"), 256)
    link = F.coalesce(F.lag("sha").over(w), F.lit(ROOT))
    index = F.row_number().over(w) - 1
    return chain.select(
        "run", "i",
        (F.col("sha") != expect).alias("sha_mismatch"), (F.col("prev") != link).alias("prev_mismatch"), (F.col("i") != index).alias("bad_index"),
    )


def verify(chain: DataFrame, heads: DataFrame) -> DataFrame:
    """The worst status of every run and its problem counts, against the recorded heads."""
    p = problems(chain).groupBy("run").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("sha_mismatch", "prev_mismatch", "bad_index")))
    d = heads.withColumnRenamed("head", "recorded").select("run", "recorded").join(head(chain), "run", "left").join(p, "run", "left")
    broken = (F.col("sha_mismatch") > 0) | (F.col("prev_mismatch") > 0) | (F.col("bad_index") > 0)
    status = F.when(F.col("n").isNull(), "EMPTY").when(broken, "TAMPERED").when(~F.col("head").eqNullSafe(F.col("recorded")), "HEAD_MISMATCH").otherwise("OK")
    return d.select("run", status.alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "sha_mismatch", "prev_mismatch", "bad_index")))


def read_ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of stored ledgers with file and number; bytes stay as they are."""
    d = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("run"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("o"))
    return d.withColumn("i", F.row_number().over(W.partitionBy("run").orderBy("o")) - 1).drop("o")


def torn_tails(spark: SparkSession, path: str) -> DataFrame:
    """Does the file end within a line?"""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("run"), (F.expr("right(cast(content as string), 1)") != "\n").alias("torn"))


def check_stored_lines(lines: DataFrame) -> DataFrame:
    """L3, L4 on stored canonical lines: the digest of a line without its own sha field, and the
    link to the line before. Nothing is parsed and written again, so bytes stay identical."""
    field = lambda k: F.regexp_extract("line", f'"{k}":"([0-9a-f]{{64}})"', 1)
    own = F.regexp_extract("line", r'"sha":"([0-9a-f]{64})","state_sha"', 1)
    d = lines.withColumn("sha", own).withColumn("prev", field("prev"))
    w = W.partitionBy("run").orderBy("i")
    good = F.sha2(F.regexp_replace("line", _SHA_FIELD, ""), 256) == F.col("sha")
    return d.select("run", "i", good.alias("sha_ok"), (F.col("prev") == F.coalesce(F.lag("sha").over(w), F.lit(ROOT))).alias("prev_ok"))


def canonical(row: object) -> str:
    return json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def seal_lines(rows: DataFrame, run: str, order: str, body: Column) -> DataFrame:
    """L1: (run, i, line, sha) of rows stored as canonical JSON. `body` is a JSON object; every
    field of the row, nulls included, is under the digest, and so are v, i and prev."""
    d = rows.select(F.col(run).alias("run"), F.col(order).alias("o"), body.alias("body"))
    schema = T.StructType([T.StructField("run", d.schema["run"].dataType), T.StructField("i", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("line", "sha"))])

    def step(state, row):
        prev, i = state
        fields = json.loads(row[2]) | {"v": 1, "i": i, "prev": prev}
        sha = hashlib.sha256(canonical(fields).encode()).hexdigest()
        return (sha, i + 1), [(row[0], i, canonical(fields | {"sha": sha}), sha)]

    return ordered_fold(d, ["run"], "o", schema, lambda: (ROOT, 0), step)


_SHAPES = frozenset(frozenset(ROW_FIELDS + more) for more in ((), REDACTED_FIELDS, TRUNCATED_FIELDS))
_READ = T.StructType([T.StructField("found", T.ArrayType(T.StringType())), T.StructField("prev", T.StringType()), T.StructField("sha", T.StringType())])


def _read_line(line: str | None, i: int) -> tuple[list[str], str | None, str | None]:
    """What is wrong with a line by itself; prev and sha only of a row of the right shape."""
    try:
        row = json.loads(line)
        if not isinstance(row, dict):
            raise ValueError("no object")
    except (TypeError, ValueError, RecursionError):
        return ["LINE_UNPARSABLE"], None, None
    if frozenset(row) not in _SHAPES:
        return ["BAD_SHAPE"], None, None
    found = [] if row["i"] == i else ["BAD_INDEX"]
    text = lambda v: v if isinstance(v, str) else None
    try:
        if hashlib.sha256(canonical({k: v for k, v in row.items() if k != "sha"}).encode()).hexdigest() != row["sha"]:
            found.append("SHA_MISMATCH")
        if canonical(row) != line:
            found.append("NONCANONICAL_LINE")
    except UnicodeEncodeError:  # a lone surrogate has no bytes to digest
        found += ["BAD_SHAPE", "NONCANONICAL_LINE"]
    return found, text(row["prev"]), text(row["sha"])


def stored_lines(lines: DataFrame) -> DataFrame:
    """Stored lines (run, i, line) as (run, i, found, prev, sha, link): what is wrong with each
    by itself, and the sha of the line before. That line is met by number in one grouping on
    (run, i), so a run of any length is spread over all tasks."""

    @F.pandas_udf(_READ)
    def read(line, i):
        import pandas as pd

        return pd.DataFrame([_read_line(a, int(b)) for a, b in zip(line, i)], columns=["found", "prev", "sha"])

    d = lines.select("run", "i", read("line", F.col("i").cast("long")).alias("own"))
    nothing = F.lit(None).cast(_READ)
    here = F.struct(F.col("i").alias("i"), F.col("own").alias("own"), F.lit(None).cast("string").alias("link"))
    after = F.struct((F.col("i") + 1).alias("i"), nothing.alias("own"), F.col("own.sha").alias("link"))
    both = d.select("run", F.explode(F.array(here, after)).alias("x")).select("run", "x.*")
    met = both.groupBy("run", "i").agg(F.first("own", ignorenulls=True).alias("own"), F.first("link", ignorenulls=True).alias("link"))
    return met.where("own is not null").select("run", "i", "own.*", F.when(F.col("i") == 0, ROOT).otherwise(F.col("link")).alias("link"))


def stored_problems(read: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, i, type) of everything wrong with stored ledgers, as rows. `read` is made by
    stored_lines; `runs` has run, torn (the file ends within a line) and head (null: not stored).
    A line that cannot be read, or has another shape, leaves the link of the next one open; when it
    is the torn last one it is a torn tail only."""
    seen, last = _ends(read)
    d = read.join(seen, "run").join(runs.select("run", F.coalesce("torn", F.lit(False)).alias("torn")), "run", "left")
    tail = F.coalesce("torn", F.lit(False)) & (F.col("i") == F.col("n") - 1)
    unread = F.array_contains("found", "LINE_UNPARSABLE")
    shaped = ~unread & ~((F.size("found") == 1) & F.array_contains("found", "BAD_SHAPE"))
    broken = shaped & F.col("link").isNotNull() & ~F.col("prev").eqNullSafe(F.col("link"))
    types = F.concat(
        F.when(tail & unread, F.array().cast("array<string>")).otherwise(F.col("found")),
        F.when(broken, F.array(F.lit("PREV_MISMATCH"))).otherwise(F.array().cast("array<string>")),
        F.when(tail, F.array(F.lit("TORN_TAIL"))).otherwise(F.array().cast("array<string>")),
    )
    by_line = d.select("run", "i", F.explode(types).alias("type"))
    h = runs.select("run", "head").join(seen, "run", "left").join(last, "run", "left")
    of_head = F.when(F.col("head").isNull(), F.when(F.col("n") > 0, "HEAD_MISSING")).when(~F.col("head").eqNullSafe(F.col("last")), "HEAD_MISMATCH")
    by_run = h.select("run", F.lit(None).cast("long").alias("i"), of_head.alias("type")).where("type is not null")
    return by_line.select("run", F.col("i").cast("long").alias("i"), "type").unionByName(by_run)


def _ends(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per run the number of its lines, and the last sha that could be read."""
    seen = read.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return seen, read.where("sha is not null").groupBy("run").agg(F.max_by("sha", "i").alias("last"))


def stored_status(read: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, status, n and the number of problems of each type) of every run in `runs`. A run
    with neither lines nor head is EMPTY; one whose lines are gone but whose head is stored has a
    HEAD_MISMATCH."""
    problems = stored_problems(read, runs)
    kinds = (*LINE_PROBLEMS, "TORN_TAIL", "HEAD_MISSING", "HEAD_MISMATCH")
    p = problems.groupBy("run").agg(*(F.count_if(F.col("type") == k).alias(k.lower()) for k in kinds))
    d = runs.select("run", "head").join(_ends(read)[0], "run", "left").join(p, "run", "left").na.fill(0, ["n", *(k.lower() for k in kinds)])
    tampered = sum((F.col(k.lower()) for k in LINE_PROBLEMS), F.lit(0)) > 0
    status = F.when(tampered, "TAMPERED").when(F.col("torn_tail") > 0, "TORN_TAIL").when(F.col("head_missing") + F.col("head_mismatch") > 0, "HEAD_MISMATCH")
    status = status.when((F.col("n") == 0) & F.col("head").isNull(), "EMPTY").otherwise("OK")
    return d.select("run", status.alias("status"), "n", *(k.lower() for k in kinds))


def capped_calls(calls: DataFrame, run: str, order: str, key: Column, is_status: Column, repeat: int = 8, status: int = 20) -> DataFrame:
    """Calls refused as the ninth or later of equal consecutive calls, else as status calls
    beyond their number. Refused calls do not count, so an equal run stays refused until it ends;
    status calls refused for repetition do not use up the status cap."""
    w = W.partitionBy(run).orderBy(order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)

    def streak(d: DataFrame, over, name: str) -> DataFrame:
        new = F.when(F.col("_key").eqNullSafe(F.lag("_key").over(over)), 0).otherwise(1)
        d = d.withColumn("_new", new).withColumn("_island", F.sum("_new").over(over.rowsBetween(W.unboundedPreceding, 0)))
        return d.withColumn(name, F.row_number().over(W.partitionBy(run, *([] if over is w else ["_spent"]), "_island").orderBy(order)))

    d = streak(calls.withColumn("_key", key).withColumn("_status", is_status), w, "_first")
    d = d.withColumn("statuses", F.sum(F.when(F.col("_status") & (F.col("_first") <= repeat), 1).otherwise(0)).over(so_far))
    # status calls beyond the cap are refused and so do not part two equal calls around them
    d = d.withColumn("_spent", F.col("_status") & (F.col("statuses") > status))
    d = streak(d, W.partitionBy(run, "_spent").orderBy(order), "_streak")
    d = d.withColumn("streak", F.when(F.col("_spent"), F.col("_first")).otherwise(F.col("_streak")))
    reason = F.when(F.col("streak") > repeat, "cap_repeat").when(F.col("_spent"), "cap_status")
    return d.withColumn("refused", reason).drop("_key", "_status", "_new", "_island", "_first", "_spent", "_streak")


def counted_caps(calls: DataFrame, run: str, order: str, kind: str, most: dict[str, int]) -> DataFrame:
    """The calls of each class beyond its number are refused; refused ones do not count."""
    k = F.row_number().over(W.partitionBy(run, kind).orderBy(order))
    cap = F.create_map(*(F.lit(x) for kv in most.items() for x in kv))[F.col(kind)]
    return calls.withColumn("refused", F.coalesce(k > cap, F.lit(False)))


def budget(results: DataFrame, turn: str, order: str, size: Column, most: int = 6000) -> DataFrame:
    """Characters a turn has spent and what of each result is kept; a result that does not
    fit keeps what is left, and the turn is then spent."""
    w = W.partitionBy(turn).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.least(F.coalesce(F.sum(size).over(w), F.lit(0)), F.lit(most))
    return results.select(turn, order, size.alias("full"), F.least(size, F.lit(most) - before).alias("kept"))


def last_before(rows: DataFrame, run: str, order: str, when: Column, what: Column) -> Column:
    """`what` of the last earlier row of the run for which `when` holds."""
    return F.last(F.when(when, what), ignorenulls=True).over(W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, -1))


def settle(rows: DataFrame, run: str, order: str) -> DataFrame:
    """The outcome of a run: its last op, how many were refused, and the last refusal."""
    return rows.groupBy(run).agg(
        F.max_by("op", order).alias("last_op"), F.count(F.lit(1)).alias("ops"), F.count_if("refused").alias("refused"),
        F.coalesce(F.max_by("op", F.when(F.col("refused"), F.col(order))), F.lit("")).alias("last_refused"),
    )


def find_by_prefix(chain: DataFrame, prefix: str) -> DataFrame:
    """X12."""
    return chain.where(F.col("sha").startswith(prefix))


def with_corrections(chain: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows with the corrections (sha, text) that refer to them, in order."""
    notes = corrections.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("corrections"))
    return chain.join(notes, "sha", "left")


LINE = T.StructType([T.StructField("run", T.StringType()), T.StructField("i", T.LongType()), T.StructField("line", T.StringType())])
