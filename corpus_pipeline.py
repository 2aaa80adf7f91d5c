"""The corpus pipeline: toxicity, near-duplicates, secrets, mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet to
shared storage and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlens.llm._common import materialize, read_table
from barlens.llm.bpe import bpe_stage
from barlens.llm.mixing import mixing_stage
from barlens.llm.secrets import secrets_stage
from barlens.llm.simhash import simhash_stage
from barlens.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", simhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: A trained classifier, components and hashes of tokens: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
