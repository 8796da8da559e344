"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage
before it kept.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brineloom.llm.decontam import drop_contaminated
from brineloom.llm.neardup import one_of_each
from brineloom.llm.packing import pack_stage
from brineloom.llm.shared import materialize
from brineloom.llm.substrings import remove_repeats
from brineloom.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each),
    ("substring_dedup", remove_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and sketches have no SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None
