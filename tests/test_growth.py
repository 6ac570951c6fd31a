"""Steps whose work must grow with their rows alone."""

import time

from ledgerline.operators import document
from pyspark.sql import functions as F

from .test_operators import component, frame


def test_an_object_of_very_many_paths(spark):
    """Told apart pair by pair, its properties would take minutes."""
    n = 60_000
    rows = frame(spark, [component("a", "1.0.0", company_name="X")]).withColumn("evidence_paths", F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda i: F.format_string("a\\%06d", i)))
    rows = rows.withColumn("evidence_paths", F.concat("evidence_paths", F.array(F.lit("a/000000"), F.lit(""), F.lit(None).cast("string"))))
    task = document.Task("t", target_directory="/x")
    began = time.monotonic()
    got = rows.select(document.component_object(task).alias("c")).select("c.properties", F.size("c.evidence.occurrences").alias("n")).first()
    assert time.monotonic() - began < 30
    pairs = [tuple(p) for p in got["properties"]]
    paths = [v for k, v in pairs if k == "ledgerline:evidence-path"]
    assert paths == [f"a/{i:06d}" for i in range(n)] and pairs == sorted(set(pairs)) and len(pairs) == n + 5
    assert got["n"] == n + 2  # as stored: with the component's own path, and two forms of one
    few = frame(spark, [component("a", source_artifact="", evidence_paths=[])]).select(document.component_object(task).alias("c")).first()["c"]
    assert few["evidence"] is None and few["hashes"] is None and few["licenses"] is None
