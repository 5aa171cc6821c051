"""From raw documents to packed training sequences."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from monthloom.llm import mixing, packing, simhash, suffix_dedup, toxicity
from monthloom.llm.common import table, written
from monthloom.shipping import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """The stage, with the package on the executors."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship_package(spark), docs, sf_dir)

    return run_stage


@_shipped
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models learned from the labels find ordinary."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@_shipped
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked by three bits or fewer."""
    return simhash.one_of_each_class(docs)


@_shipped
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes and more that an earlier one holds."""
    return suffix_dedup.texts_without_repeats(docs)


@_shipped
def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document stands in the mix as often as it is taken."""
    return mixing.as_documents(docs)


@_shipped
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of at most 1,024 ids, placed in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_to_weights),
    ("best-fit packing", best_fit_packing),
]

#: Subword ids, learned scores and byte-wise repeats have no SQL form; tests hold what the stages call against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
