"""Merging, comparing and leaving out policies, as set operations on rule atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policies import POLICY
from .rules import ATOM_KEY


def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Atoms of either, stored ones first in order. Nothing stored is ever lost."""
    tagged = stored.withColumn("__late", F.lit(0)).unionByName(incoming.withColumn("__late", F.lit(1)))
    first = F.struct("__late", "first_seq")
    merged = tagged.groupBy(*ATOM_KEY).agg(F.min(first).alias("__first"), F.min_by("selector", first).alias("selector"))
    offset = stored.agg(F.coalesce(F.max("first_seq") + 1, F.lit(0)).alias("__offset"))  # one row
    return merged.join(F.broadcast(offset)).select(*ATOM_KEY, (F.col("__first.first_seq") + F.col("__first.__late") * F.col("__offset")).alias("first_seq"), "selector")


def fingerprints(atoms: DataFrame) -> DataFrame:
    """POLICY, atoms and fingerprint: equal policies have equal fingerprints, whatever the order of their rules.

    A fingerprint is the number of atoms and the sum of their 128-bit hashes, so it is made by partial aggregation and no list of a policy's atoms is held; atoms of a policy are distinct."""
    held = [F.coalesce(F.col(c), F.lit("")) for c in (*ATOM_KEY, "selector")]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *held).cast("decimal(38,0)")).cast("string")
    return atoms.groupBy(*POLICY).agg(F.count(F.lit(1)).alias("atoms"), F.concat_ws("/", F.count(F.lit(1)), total(1), total(2)).alias("fingerprint"))


def dispositions(incoming: DataFrame, live: DataFrame, written: DataFrame) -> DataFrame:
    """POLICY, fingerprint and disposition of each incoming policy: skip_live, skip_written or write.

    All three are tables of fingerprints; what is live in the cluster is asked first, then what was written last."""
    mark = lambda df, name: df.select(*POLICY, "fingerprint", F.lit(True).alias(name))
    keys = [*POLICY, "fingerprint"]
    both = incoming.select(*keys).join(mark(live, "__live"), keys, "left").join(mark(written, "__written"), keys, "left")
    return both.select(*keys, F.when(F.col("__live"), "skip_live").when(F.col("__written"), "skip_written").otherwise("write").alias("disposition"))


def added(stored: DataFrame, merged: DataFrame) -> DataFrame:
    """Atoms that the merge brings to what is stored."""
    return merged.join(stored.select(*ATOM_KEY), ATOM_KEY, "left_anti")
