"""The history of scans: a folder of JSON rows that can be listed, appended to, and
followed as a stream; saved as versions, of which the newest sound one counts; and told as
events, what was added, updated or removed, from a log of task rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.display import task_status
from ..sources import store

TASK = (
    "id string, created_utc string, started_utc string, completed_utc string, target_directory string, target_root_name string, "
    "status string, files_inspected bigint, bytes_inspected bigint, warnings bigint, errors bigint, matches bigint"
)
SAFE_ID = r"^[a-z0-9][a-z0-9\-]{0,127}\z"


def cleaned(rows: DataFrame) -> DataFrame:
    """What a store's rows mean when it is opened: unknown states are pending, scans that
    were pending or running have failed, and counters are never null."""
    status = task_status(F.col("status"))
    stopped = status.isin("pending", "running")
    rows = rows.withColumn("errors", F.coalesce("errors", F.lit(0)) + stopped.cast("long"))
    return rows.withColumn("status", F.when(stopped, "failed").otherwise(status)).fillna(0)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks with safe ids; an id that occurs twice rejects the store (ValueError)."""
    rows = spark.read.schema(TASK).option("mode", "FAILFAST").json(folder)
    bad = rows.groupBy("id").count().where(F.col("id").isNull() | ~F.col("id").rlike(SAFE_ID) | (F.col("count") > 1))
    if not bad.isEmpty():
        raise ValueError("the history has unsafe or repeated ids")
    return cleaned(rows)


def _sound(rows: DataFrame) -> bool:
    """Whether every id is safe and occurs once."""
    return rows.groupBy("id").count().where(F.col("id").isNull() | ~F.col("id").rlike(SAFE_ID) | (F.col("count") > 1)).isEmpty()


def save(tasks: DataFrame, folder: str, after: int) -> int:
    """Saves the whole history as the version behind one, after a check of what was given
    (ValueError). store.Conflict if another writer was first. The version before stays, as
    the one to fall back on."""
    if not _sound(tasks):
        raise ValueError("the history has unsafe or repeated ids")
    names = [f.split(" ")[0] for f in TASK.split(", ")]
    return store.commit(tasks.select(names), folder, after)


def reopen(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int, str]:
    """(the tasks of the newest sound version, the newest number taken, a warning where
    that isn't the same). Rows that could not have been saved reject a version too."""
    rows, version, taken = store.load(spark, folder)
    while rows is not None and not _sound(rows):
        older = [v for v in store.versions(spark, folder) if v < version]
        rows, version = store.load_version(spark, folder, older)
    warning = "" if version == taken else f"Version {taken} of the history could not be read; version {version} is shown."
    return (None if rows is None else cleaned(rows)), taken, warning


def append(tasks: DataFrame, folder: str) -> None:
    tasks.write.mode("append").json(folder)


def delete(spark: SparkSession, folder: str, task_id: str, to: str) -> None:
    """Writes the history without a finished task to another folder."""
    rows = spark.read.schema(TASK).json(folder)
    found = rows.where(F.col("id") == task_id).select(task_status(F.col("status")).alias("s")).first()
    if found is None or found["s"] in ("pending", "running"):
        raise ValueError("only finished tasks can be deleted")
    rows.where(F.col("id") != task_id).write.json(to)


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the tasks as they are appended."""
    return spark.readStream.schema(TASK).json(folder)


def daily_totals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Scans, files and warnings per day and target, by event time; days close when they
    are later than the watermark."""
    rows = stream.withColumn("at", F.to_timestamp("created_utc")).withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 day").alias("day"), "target_root_name").agg(
        F.count(F.lit(1)).alias("scans"), F.sum("files_inspected").alias("files"), F.sum("warnings").alias("warnings")
    )


#: A log of task rows: what a task is from a place on, or that it was removed there.
LOG = f"{TASK}, seq bigint, removed boolean"
CHANGE = "id string, seq bigint, kind string, revision bigint"


def _digest(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[f.split(" ")[0] for f in TASK.split(", ")]), {"ignoreNullFields": "false"}), 256)


def change_events(log: DataFrame) -> DataFrame:
    """id, seq, kind (added, updated, removed) and revision of every row of the log that
    changes its task, revision counting the changes of that task from 1. Rows of a task
    count in the order of seq, of equal ones only one (that of least digest); rows that
    leave the task as it is tell nothing. A null removed is false; rows without id or seq
    are left out."""
    rows = log.where("id is not null and seq is not null").select("id", "seq", F.coalesce("removed", F.lit(False)).alias("removed"), _digest(log).alias("digest"))
    rows = rows.groupBy("id", "seq").agg(F.min(F.struct("digest", "removed")).alias("r")).select("id", "seq", "r.*")
    order = Window.partitionBy("id").orderBy("seq")
    gone = F.coalesce(F.lag("removed").over(order), F.lit(True))
    kind = F.when(F.col("removed"), F.when(~gone, "removed")).when(gone, "added").when(F.lag("digest").over(order) != F.col("digest"), "updated")
    told = rows.select("id", "seq", kind.alias("kind")).where("kind is not null")
    return told.withColumn("revision", F.row_number().over(order).cast("long"))


class _Changes(StatefulProcessor):
    """Keeps of each task its last place, digest (none once removed) and revision."""

    def init(self, handle) -> None:
        self.task = handle.getValueState("task", "seq bigint, digest string, revision bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, digest, revision = self.task.get() if self.task.exists() else (None, None, 0)
        found = sorted(row for part in rows for row in zip(part["seq"].tolist(), part["digest"].tolist(), part["removed"].tolist(), strict=True))
        out = []
        for at, now, removed in found:
            if seq is not None and at <= seq:
                continue  # told before, or late
            seq = at
            kind = "removed" if removed else "added" if digest is None else "updated"
            if (now if not removed else None) == digest:
                continue
            digest, revision = None if removed else now, revision + 1
            out.append((key[0], at, kind, revision))
        if seq is not None:
            self.task.update((seq, digest, revision))
        yield pd.DataFrame(out, columns=["id", "seq", "kind", "revision"])

    def close(self) -> None:
        pass


def follow_changes(log: DataFrame) -> DataFrame:
    """change_events of a stream (LOG), batch by batch: tasks are kept as state, so events
    go on where they were after a restart from the checkpoint. Rows that come behind later
    ones of their task are left out. The session must keep state in RocksDB
    (spark.sql.streaming.stateStore.providerClass)."""
    rows = log.where("id is not null and seq is not null").select("id", "seq", F.coalesce("removed", F.lit(False)).alias("removed"), _digest(log).alias("digest"))
    return rows.groupBy("id").transformWithStateInPandas(_Changes(), CHANGE, "Append", "None")
