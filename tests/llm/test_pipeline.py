"""The pipeline against a brute-force version on a small documents table."""

import base64
import gzip

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from ledgerline.llm import decontaminate, quality, secrets, token_counts

from .test_operators import brute_print, brute_roots, prose

TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def rows_text(i):
    return prose(i, 90)


def write(spark, folder, rows, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], TYPES).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_matches_brute_force(spark, tmp_path):
    item = prose(77, 25)
    rows = [(i, prose(i, 90)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(7, rows[7][1]), (None, prose(999, 80)), (None, prose(998, 80)), (None, rows_text(3)), (300, None), (301, "too short")]
    rows += [(400, f"{prose(5000, 60)} {item} {prose(5001, 60)}"), (401, f"{prose(5002, 80)} token=abcdef99 {prose(5003, 9)}")]
    rows += [(402, f"{prose(5004, 80)} {base64.b64encode(b'password: abcdefg').decode()} end")]
    write(spark, str(tmp_path), rows, [(1, item), (2, None)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    refs = quality.references(spark.read.parquet(f"{tmp_path}/documents.parquet"), quality.Rules())
    kept = [(i, t) for i, t in rows if quality.judge([(t or "").encode()], ["en"], refs, quality.Rules())["kept"][0]]
    least = {}
    for i, t in kept:
        f = brute_print(t)
        least[f] = i if least.get(f) is None else least[f] if i is None else min(i, least[f])
    roots = brute_roots(least)
    single = sorted({(i, t) for i, t in kept if roots[brute_print(t)] == i}, key=str)
    assert sum(i is None for i, _ in single) == 2 and sum(i == 3 for i, _ in single) == 1
    own = decontaminate.shingles(decontaminate.words_of(item), 5)
    clean = [(i, t) for i, t in single if len(own & decontaminate.shingles(decontaminate.words_of(t), 5)) < 0.8 * len(own)]
    assert 400 in dict(single) and 400 not in dict(clean) and {401, 402} <= set(dict(clean))
    encoding, _ = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = [(i, encoding.encode_ordinary(secrets.redact(t, secrets.unwrap(t, 1 << 20).rows))) for i, t in clean]
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=str) == sorted(want, key=str)
    assert all("[SECRET]" in encoding.decode(dict(want)[i]) for i in (401, 402))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_of_documents_even_when_empty(spark, tmp_path, name, stage):
    write(spark, str(tmp_path), [(1, prose(1, 40))], [(1, "a b c d e f")])
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    out = stage(spark, empty, str(tmp_path))
    assert out.dtypes == empty.dtypes and out.collect() == []


def test_last_stage_on_an_empty_table(spark, tmp_path):
    write(spark, str(tmp_path), [(1, prose(1, 40))], [(1, "a b c d e f")])
    out = corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "ids"] and out.collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_columns_of_clashing_names(spark, tmp_path, name, stage):
    rows = [(i, prose(i % 9, 90), "en", "s", 5, i, "x", "y", 1, i, 2.5) for i in range(12)]
    more = TYPES + ", _fp long, _id string, _print string, fp int, component_id long, root double"
    docs = spark.createDataFrame(rows, more)
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got, want = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)), stage(spark, plain, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect()) != []
    if name != "tokens":
        assert got.columns == docs.columns
        given = {r[0]: r[5:] for r in rows}
        assert all(tuple(r)[5:] == given[r["doc_id"]] for r in got.collect())


def test_runs_that_are_not_read_as_a_whole_are_redacted(spark, tmp_path):
    run = base64.b64encode(gzip.compress(b"a" * 300_000)).decode()
    write(spark, str(tmp_path), [(1, f"head {run} tail"), (2, "plain text")], [(1, "a b c d e f")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.secret_redaction(spark, docs, str(tmp_path), max_expanded=50)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("head [SECRET] tail", 18), 2: ("plain text", 10)}
