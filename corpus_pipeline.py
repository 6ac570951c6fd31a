"""A corpus pipeline of five operators over the documents table.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All
but the last return the columns of documents; the last returns each kept document's ids.
Rows are filtered or rewritten where they are read, so null ids and repeated rows need
no join; only near-duplicates are grouped by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontaminate, quality, secrets, simhash
from ledgerline.llm.common import bytes_of, saved, table, texts_of, work_dir


def _kept(docs: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged by references over all of docs. Null
    texts have no words and go; a null lang is the empty one; null ids and repeated rows are
    judged like any other; an empty table stays empty."""
    rules = quality.Rules()
    refs = quality.references(docs, rules)
    return _kept(
        docs,
        lambda b: quality.judge(bytes_of(b.column("text")), b.column("lang").to_pylist(), refs, rules)["kept"],
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of its least doc_id (null if it has no
    other), of that id's least fingerprint, and of equal rows the least by its columns."""
    fp, own_id, own_fp = _fresh(docs, "fp", "id", "print")  # names that docs doesn't have
    marked = simhash.with_fingerprint(docs, fp)
    prints = saved(marked.select(F.col("doc_id"), F.col(fp).alias("fp")), "fingerprints")
    groups = simhash.grouped(prints).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = groups.groupBy("root").agg(F.min_by(F.struct("doc_id", "fp"), "fp").alias("k")).select("k.*")
    kept = saved(least.select(F.col("doc_id").alias(own_id), F.col("fp").alias(own_fp)), "kept")
    same = marked["doc_id"].eqNullSafe(kept[own_id]) & (marked[fp] == kept[own_fp])
    left = marked.join(kept, same, "left_semi")
    several = saved(
        prints.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(own_id), F.col("fp").alias(own_fp)), "repeats"
    )
    columns = [f"`{c}`" for c in docs.columns]
    if several.isEmpty():
        return left.select(columns)
    again = left["doc_id"].eqNullSafe(several[own_id]) & (left[fp] == several[own_fp])
    once = left.join(several, again, "left_anti").select(columns)
    others = [c for c in docs.columns if c != "doc_id"]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    first = left.join(several, again, "left_semi").groupBy("doc_id", fp).agg(F.min(row).alias(own_id))
    return once.unionByName(first.select("doc_id", *[F.col(f"{own_id}.c{k}").alias(c) for k, c in enumerate(others)]))


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in docs.columns}
    mark = next("_" * n for n in range(1, len(taken) + 2) if not any("_" * n + x in taken for x in names))
    return [mark + x for x in names]


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none, null and wordless items
    are in no document; null ids and repeated rows are kept; empty tables drop nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str, max_expanded: int = 64 << 20) -> DataFrame:
    """All documents, with every secret's span replaced, and that of every compressed run
    which was not read as a whole; n_chars is counted anew where a text changed. Null texts
    stay null; null ids and repeated rows are kept; an empty table stays empty."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], []
            for t in texts_of(batch.column("text")):
                found = secrets.unwrap(t, max_expanded)
                rows = found.rows + [("unread", s, e, "") for s, e in found.unread]
                changed.append(bool(rows))
                texts.append(secrets.redact(t, rows) if rows else None)
            columns = dict(zip(names, batch.columns, strict=True))
            mask = pa.array(changed, pa.bool_())
            new = pa.array(texts, columns["text"].type)
            columns["text"] = pc.if_else(mask, new, columns["text"])
            sizes = pc.utf8_length(new).cast(columns["n_chars"].type)
            columns["n_chars"] = pc.if_else(mask, sizes, columns["n_chars"])
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of each document. A null text is empty and has no ids;
    null ids and repeated rows are kept; an empty table gives an empty result."""
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("tokens", tokens),
]

#: The stages go beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = work_dir(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
