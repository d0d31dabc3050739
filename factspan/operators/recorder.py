"""The second recorder (survey S10, L13, L19): rows are checked, then appended by expected head.

A recorder is a folder on the file system that driver and executors share: `data/<name>` holds
sealed rows, `commits/<number>` names the data that counts, `rejects/<name>` what was refused. An
append seals its rows on the heads it has read, writes them, and creates the next commit only if
nobody has; a writer that comes second reads the new heads and seals again. So two writers make
one chain and lose no row, and a writer that dies leaves data that no commit names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.functions.redaction import redact_json
from factspan.operators import ledger

# Kinds with the actors each allows, kinds that a correction may exchange, reasons in the order tried.
OWN, LATER = ("owner", "agent", "process"), {"system_message": ("system",), "user_turn_unattributed": ("unknown",), "correction": ("owner", "agent")}
KINDS = ("owner_utterance", "agent_stop", "tool_call", "process_start", "process_exit", "process_interrupted", "process_orphaned", "approval", "commit", "test_run")
ACTORS = {k: OWN for k in KINDS} | LATER
CORRECTABLE = ("owner_utterance", "system_message", "user_turn_unattributed")
REASONS = ("UNKNOWN_KIND", "BAD_ACTOR", "BAD_DATA", "UNREDACTED_SECRET_REFUSED")
LEAST_PREFIX = 8


def preflight(rows: DataFrame) -> DataFrame:
    """rows(run, ord, kind, actor, data) with the reason they are refused for, null if they may be
    written. data must be a JSON object without a secret in any form."""
    allowed = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in ACTORS.items() for x in kv))
    actors = F.try_element_at(allowed, F.col("kind"))
    is_object = F.get_json_object("data", "$").startswith("{")
    secret = redact_json(F.concat(F.lit("["), "data", F.lit(","), F.to_json(F.struct("actor")), F.lit("]")))["hidden"] > 0
    reason = F.when(actors.isNull(), REASONS[0]).when(~F.coalesce(F.array_contains(actors, F.col("actor")), F.lit(False)), REASONS[1])
    reason = reason.when(~F.coalesce(is_object, F.lit(False)), REASONS[2]).when(F.coalesce(secret, F.lit(False)), REASONS[3])
    return rows.withColumn("reason", reason)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def commits(spark: SparkSession, folder: str) -> list[str]:
    """Names of the committed data, in order. There is one commit an append, however many rows it has."""
    fs, path = _files(spark, f"{folder}/commits")
    if not fs.exists(path):
        return []
    return [json.loads(r.value)["data"] for r in spark.read.option("wholetext", True).text(f"{folder}/commits").select(F.col("_metadata.file_name").alias("n"), "value").orderBy("n").collect()]


def read_events(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows that commits name; None if there are none yet."""
    names = commits(spark, folder)
    return spark.read.parquet(*(f"{folder}/data/{n}" for n in names)) if names else None


def _commit(spark: SparkSession, folder: str, number: int, name: str) -> bool:
    """Create commit `number`; False if another writer has."""
    fs, path = _files(spark, f"{folder}/commits/{number:012d}")
    fs.mkdirs(path.getParent())
    try:
        out = fs.create(path, False)
    except Exception as e:  # the file system says in many ways that a file is there
        if fs.exists(path):
            return False
        raise e
    out.write(bytearray(json.dumps({"data": name}), "utf-8"))
    out.close()
    return True


def _body() -> Column:
    return F.to_json(F.struct("kind", "actor", "data"))


def append(spark: SparkSession, folder: str, rows: DataFrame, before_commit=None) -> int:
    """Append the good ones of rows(run, ord, kind, actor, data) and put the others aside with their
    reasons; gives the number of tries. `before_commit` is called before each (tests)."""
    checked = preflight(rows)
    name = uuid.uuid4().hex
    checked.where("reason is not null").write.parquet(f"{folder}/rejects/{name}")
    good = checked.where("reason is null")
    tries = 0
    while True:
        tries += 1
        done = commits(spark, folder)
        written = spark.read.parquet(*(f"{folder}/data/{n}" for n in done)) if done else None
        none = spark.createDataFrame([], f"run {rows.schema['run'].dataType.simpleString()}, head string, n long")
        sealed = ledger.extend(none if written is None else ledger.head(written), good, "run", "ord", _body())
        data = f"{name}-{tries}"
        sealed.write.parquet(f"{folder}/data/{data}")
        if before_commit:
            before_commit(tries)
        if _commit(spark, folder, len(done), data):
            return tries


def rejects(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rejects/*")


def corrections(events: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(id, refers, kind_should_be, note, actor) with the code each is refused for, or null
    and the row (run, data) that an append would write. A row is named by the start of its sha."""
    kind = lambda c: F.get_json_object(c, "$.kind")
    start = F.substring("sha", 1, LEAST_PREFIX)
    rows = events.select("run", "sha", kind("body").alias("kind"), F.get_json_object("body", "$.actor").alias("by"), start.alias("start"))
    d = asked.withColumn("start", F.substring("refers", 1, LEAST_PREFIX))
    met = d.join(rows, "start", "left").where(F.col("sha").isNull() | F.col("sha").startswith(F.col("refers")))
    found = met.where("sha is not null").groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("sha", "run", "kind", "by")).alias("row"))
    d = asked.join(found, "id", "left")
    code = (
        F.when(F.coalesce(F.length("refers"), F.lit(0)) < LEAST_PREFIX, "PREFIX_TOO_SHORT").when(F.col("found").isNull(), "NOT_FOUND").when(F.col("found") > 1, "AMBIGUOUS_PREFIX")
        .when(~F.col("row.kind").isin(*CORRECTABLE), "NOT_AN_ATTRIBUTION_ROW").when(~F.coalesce(F.col("kind_should_be").isin(*CORRECTABLE), F.lit(False)), "UNKNOWN_KIND")
        .when(F.col("kind_should_be") == F.col("row.kind"), "NO_CHANGE").when(F.coalesce(F.trim("note"), F.lit("")) == "", "NOTE_REQUIRED")
        .when(~F.coalesce(F.col("actor").isin(*LATER["correction"]), F.lit(False)), "BAD_ACTOR")
    )
    actor = F.create_map(*(F.lit(x) for k, a in (("owner_utterance", "owner"), ("system_message", "system"), ("user_turn_unattributed", "unknown")) for x in (k, a)))
    told = F.to_json(F.struct(
        F.col("row.sha").alias("refers"), F.col("row.kind").alias("refers_kind"), F.col("row.by").alias("refers_actor"), "kind_should_be",
        F.try_element_at(actor, F.col("kind_should_be")).alias("actor_should_be"), "note",
    ))
    return d.select("id", code.alias("code"), F.when(code.isNull(), F.col("row.run")).alias("run"), F.lit("correction").alias("kind"), "actor", F.when(code.isNull(), told).alias("data"))
