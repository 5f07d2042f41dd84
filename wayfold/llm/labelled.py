"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import held_out, text_of


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, most: int) -> DataFrame:
    """(doc_id, grade, text) of at most `most` labelled documents that are not held out, chosen by a hash of the id.

    Rows with a null id or grade are left out; of several labels for one id the highest grade counts. The ids, `most` at the
    most, are broadcast, so the documents are filtered where they are read and never shuffled.
    """
    marked = labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return text_of(docs, "doc_id").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
