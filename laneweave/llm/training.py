"""Bounded samples of labelled documents for the models that are fitted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1 << 30


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """``docs`` rows (all columns) with their label, about ``per_class`` of each of the classes 0 and 1.

    ``usable`` says which ids may be learned from. A class with more rows gives
    those whose id hash is smallest. Ids with several label rows take the
    largest; null ids and null labels are left out. The sampled ids, bounded by
    2 x per_class, are what is broadcast.
    """
    held = labels.filter(usable & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_sample_id")).agg(F.max(label_col).alias("_label"))
    held = held.filter(F.col("_label").isin(0, 1)).withColumn("_order", F.pmod(F.xxhash64("_sample_id"), F.lit(_GRAIN)))
    totals = {r["_label"]: r["n"] for r in held.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for label, n in totals.items():
        share = F.when(F.col("_label") == label, F.lit(_GRAIN if n <= per_class else max(1, _GRAIN * per_class // n))).otherwise(share)
    sample = held.filter(F.col("_order") < share).drop("_order")
    return docs.join(F.broadcast(sample), docs[id_col] == sample["_sample_id"]).drop("_sample_id")
