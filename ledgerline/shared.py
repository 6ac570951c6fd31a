"""Tables that cut a plan: written once to the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where the session names none and runs
    on one machine; else a ValueError."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    return _own[app]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows, dealt to as many tasks as a shuffle has, by keys if any: for narrow tables
    of few files whose rows are much work each. To be called before what makes the rows wide."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what follows reads it as often as it likes."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
