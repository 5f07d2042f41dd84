"""The corpus pipeline: toxicity, near-duplicate documents, repeated paragraphs, benchmark contamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.common import table, written
from wayfold.llm.decontaminate import drop_contaminated
from wayfold.llm.packing import pack_stage
from wayfold.llm.setjoin import keep_one_of_each_group
from wayfold.llm.substring import cut_repeats
from wayfold.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_stage),
]

#: A trained machine and a tokenizer decide rows; SQL can't express these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
