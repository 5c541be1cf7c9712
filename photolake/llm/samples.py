"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake.storage import materialize

#: The part of a sample's bytes that a single text may take; longer ones are scored but not learned from.
LONGEST = 1 / 16


def marked_rows(labels: DataFrame, label_col: str, learn: Column) -> DataFrame:
    """``doc_id, label`` of the labelled ids that meet ``learn``; 1 if any label of the id is."""
    marked = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    return marked.where(learn)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, max_rows: int, max_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, label`` of at most ``max_rows`` labelled rows, and ``max_bytes`` of text if given.

    Only rows that meet ``learn``, a condition on ``doc_id``, are taken, in the order of a hash of
    their id, so the sample is the same on every run. Documents that carry several labels count as 1
    if any label is, and of texts that share an id the smallest is taken; rows without an id, text or
    label are left out before ``max_rows`` are counted, and so are texts of over ``LONGEST`` of
    ``max_bytes``, which would shut out the rows behind them.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    if max_bytes is not None:
        texts = texts.where(F.octet_length("text") <= max_bytes * LONGEST)
    there = marked_rows(labels, label_col, learn).join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = there.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))
    if max_bytes is None:
        return found.select("doc_id", "text", "label", "place")
    # ids and sizes alone, at most max_rows of them, are put in one line
    found = materialize(found, "labelled")
    size = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("place", "doc_id"))
    sizes = found.select("doc_id", "place", F.octet_length("text").alias("bytes")).withColumn("upto", size)
    return found.join(sizes.where(F.col("upto") <= max_bytes).select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "label", "place")
