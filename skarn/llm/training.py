"""Bounded training samples for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Whether a row's label is kept from training: crc32 of its id as text is divisible by 5 (null: no)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_ids(ids: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows of ``ids`` (column ``doc_id``), the first in order of a hash: each task keeps its
    own first ones, so that nothing larger than the bound is gathered."""
    return ids.where("doc_id is not null").orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(bound)


def train_ids(labels: DataFrame, label_col: str, value: int, bound: int) -> DataFrame:
    """A bounded sample of the ids labelled ``value`` outside the held-out fold."""
    own = labels.where((F.col(label_col) == value) & ~held_out(F.col("doc_id")))
    return sample_ids(own.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), bound)


def features_of(docs: DataFrame, ids: DataFrame, bound: int, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``features`` of the rows (doc_id, text) of a sample of at most ``bound`` ids, of at most ``bound`` rows also where ids
    repeat (the first in order of id and a hash of the text). The ids are broadcast, texts are not shuffled, and what is
    gathered are features."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = features(own.join(F.broadcast(ids), "doc_id", "left_semi"))
    return found.orderBy("doc_id", F.xxhash64(*[c for c in found.columns if c != "doc_id"])).limit(bound)
