"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cmdlake.llm import stages
from cmdlake.llm.common import Workspace, table

STAGES = [
    ("language_id", stages.language_id),
    ("minhash_near_dedup", stages.near_dedup),
    ("secret_scans", stages.secret_scans),
    ("mixing", stages.mixing),
    ("best_fit_packing", stages.packing),
]

#: Byte-level language models, tokenizer ids and a learned rejection have no SQL form; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
