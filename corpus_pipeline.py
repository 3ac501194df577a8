"""Training corpus from documents: toxicity, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the
last one adds each row's shard and slot. Oracle: none, as learned scores, SimHash and
flow have no SQL form; tests/llm checks run() against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphward.llm.common import materialize, table
from glyphward.llm.decontamination import decontaminate_stage
from glyphward.llm.mixing import mix_stage
from glyphward.llm.sharding import shard_stage
from glyphward.llm.simhash import dedup_stage
from glyphward.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("mixing", mix_stage),
    ("sharding", shard_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
