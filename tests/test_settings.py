import pytest
from pyspark.sql import functions as F

from ledgerline import settings
from ledgerline.functions import evidence


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    for text, good in [('{"calculate_sha256": false}', True), ('{"format_version": 1, "scan_settings": {"ignore_patterns": ["x"]}}', True), ('{"format_version": 2, "scan_settings": {}}', False), ('{"calculate_sha256": 1}', False), ("[]", False), ('{"ignore_patterns": [1]}', False)]:
        path.write_text(text)
        if good:
            settings.load(str(path))
        else:
            with pytest.raises(ValueError):
                settings.load(str(path))


def test_evidence(spark):
    rows = spark.createDataFrame([("Acme, Inc.", "My (Tool)", "1.2"), ("é", "x", "1"), ("a", "b", "1")], "c string, p string, v string")
    got = [r[0] for r in rows.coalesce(1).select(evidence.evidence_cpe(F.col("c"), F.col("p"), F.col("v"))).collect()]
    assert got == ["cpe:2.3:a:acme_inc:my_tool:1.2:*:*:*:*:*:*:*", "", "cpe:2.3:a:a:b:*:*:*:*:*:*:*:*"]
    words = spark.createDataFrame([("a.b",), ("${x}",), ("a/b",), ("",), ("x" * 513,)], "w string")
    assert [r[0] for r in words.coalesce(1).select(evidence.is_literal_coordinate(F.col("w"))).collect()] == [True, False, False, False, False]
    named = spark.range(1).select(evidence.export_name(F.lit("2024-01-02T03:04:05.678Z"), F.lit("a b"), F.lit("id")))
    assert named.first()[0] == "20240102_030405_a_b_id.cdx.json"
    assert spark.range(1).select(evidence.is_within(F.lit("/a/b"), F.lit("/a/"))).first()[0] and not spark.range(1).select(evidence.is_within(F.lit("/ab"), F.lit("/a"))).first()[0]
