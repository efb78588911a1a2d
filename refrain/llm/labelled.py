"""Training samples for document classifiers, and the fold each document is in.

The sample is bounded: at most ``per_class`` labelled documents of each class, those with the
smallest hashes of their ids, none longer than ``most_bytes``, and all together no more than
``total_bytes``. That bound is the only one; scoring covers every document.

Defined results: null ids and labels other than 0 and 1 don't count; of several labels of a
document the largest does, of several texts under one id too; a null text is empty; without
labels, or documents for them, the sample is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.sources.shared import materialize


@dataclass(frozen=True)
class Sample:
    texts: list[str]
    labels: list[int]
    #: of label 1 among all training rows
    share: float


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; no id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def draw(docs: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int = 1500, most_bytes: int = 100_000, total_bytes: int = 64_000_000) -> Sample:
    """``training``: a condition on labels' doc_id."""
    rows = labels.filter(training & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    counts = dict(rows.groupBy("_label").count().collect())
    order = F.xxhash64("doc_id")
    chosen = [(r["doc_id"], r["_label"]) for y in (0, 1) for r in rows.filter(F.col("_label") == y).orderBy(order, "doc_id").limit(per_class).collect()]
    if not chosen:
        return Sample([], [], 0.0)
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, rows.schema))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).filter(F.octet_length("_text") <= most_bytes)
    # one text an id, whatever the number of its rows
    found = materialize(own.join(picked, "doc_id").groupBy("doc_id", "_label").agg(F.max("_text").alias("_text")), "sample")
    sizes = {r["doc_id"]: r["n"] for r in found.select("doc_id", F.octet_length("_text").alias("n")).collect()}
    room = {0: total_bytes // 2, 1: total_bytes // 2}
    kept = []
    for d, y in chosen:
        if d in sizes and sizes[d] <= room[y]:
            room[y] -= sizes[d]
            kept.append(d)
    texts = sorted(tuple(r) for r in found.filter(F.col("doc_id").isin(kept)).select("doc_id", "_text", "_label").collect()) if kept else []
    return Sample([r[1] for r in texts], [r[2] for r in texts], counts.get(1, 0) / max(1, sum(counts.values())))
