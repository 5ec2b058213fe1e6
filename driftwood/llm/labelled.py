"""A bounded sample of labelled documents for the classifiers to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, most_bytes: int = 6 << 20) -> tuple[list[str], list[int], float]:
    """Texts and labels of up to per_class documents and most_bytes of either class, and the share of class 1 in all labels.

    The documents are those whose doc_id comes first by hash; documents of the held-out fold are never among them.
    Null labels and doc_ids are passed over; of several labels of one document
    the largest counts, of several texts the first in order. Both classes together are at most
    2 * per_class rows, which is the bound of what is broadcast and of what comes to the driver.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))  # of per_class rows at most
    some = some.groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("bytes", so_far)
    rows = sorted(some.where(F.col("bytes") - F.octet_length("text") < most_bytes).select("doc_id", "text", "y").collect())
    return [r["text"] for r in rows], [r["y"] for r in rows], 0.0 if share is None else float(share)
