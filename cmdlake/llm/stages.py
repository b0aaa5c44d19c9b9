"""Stages of the corpus pipeline: each applies one operator's decisions to whole documents.

Columns of documents: doc_id, text, lang, source, n_chars. Further columns pass through where rows are kept, whatever
their names. In every stage null texts count as empty, texts are taken whole however long, repeated rows and ties are treated as
the operator's module says, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding is replaced by its kind in brackets; documents without findings stay as they are."""
    from . import secrets

    found = secrets.findings_by_path(docs.select("text", F.struct("*").alias("_row")), secrets.update_ledger(docs))
    hit = F.size("findings") > 0
    text = F.when(hit, secrets.redact(F.col("text"), F.col("findings"))).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(text).cast("long")).otherwise(F.col("_row.n_chars"))
    return found.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, as the packing query returns them."""
    from . import packing as p

    return p.best_fit_packing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without a text or without any letter.

    The models learn from the labelled documents of the stage's own input.
    """
    from . import langid

    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id."""
    from . import neardup

    return neardup.keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document appears once for each time that it is drawn."""
    from . import mixing as m

    return m.mixed_documents(docs)
