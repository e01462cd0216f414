"""Cluster health: drops that no policy causes, by reason, node and workload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dropclass import class_rank


def contributors(events: DataFrame) -> DataFrame:
    """reason, dimension (reason, node, workload), name and drops: one pass over the events by grouping sets."""
    rows = events.select("reason", "class", "node", F.concat_ws("/", "namespace", "workload").alias("workload"))
    grouped = rows.groupingSets([["reason", "class"], ["reason", "class", "node"], ["reason", "class", "workload"]], "reason", "class", "node", "workload").agg(F.count(F.lit(1)).alias("drops"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "reason").when(F.col("g") == 1, "node").otherwise("workload")
    return grouped.select("reason", "class", kind.alias("dimension"), F.when(kind == "node", F.col("node")).when(kind == "workload", F.col("workload")).otherwise("").alias("name"), "drops")


def report(contributed: DataFrame, hints: DataFrame) -> DataFrame:
    """reason, class, drops, remediation, by_node and by_workload, by reason. Empty without drops."""
    pairs = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("dimension") == kind, F.struct("name", "drops"))))
    by = contributed.groupBy("reason", "class").agg(F.max(F.when(F.col("dimension") == "reason", F.col("drops"))).alias("drops"), pairs("node").alias("by_node"), pairs("workload").alias("by_workload"))
    return by.join(F.broadcast(hints.select("reason", F.col("hint").alias("remediation"))), "reason", "left").orderBy("reason")


def reasons_only(disposed: DataFrame) -> DataFrame:
    """Drops by reason alone, where no evidence is kept."""
    return disposed.filter(F.col("disposition").isin("infra", "transient")).groupBy(F.col("drop_reason").alias("reason"), F.col("drop_class").alias("class")).agg(F.count(F.lit(1)).alias("drops"))


def top(contributed: DataFrame, n: int = 3) -> DataFrame:
    """Of each reason's nodes and workloads the ``n`` with most drops and all that tie with the last of them: place, and more (how many are left out)."""
    each = Window.partitionBy("reason", "dimension")
    named = contributed.filter("dimension <> 'reason'").withColumn("rank", F.rank().over(each.orderBy(F.desc("drops")))).withColumn("total", F.count(F.lit(1)).over(each))
    kept = named.filter(F.col("rank") <= n).withColumn("place", F.row_number().over(each.orderBy(F.desc("drops"), "name")))
    return kept.withColumn("more", F.col("total") - F.count(F.lit(1)).over(each)).drop("rank", "total")


def top_text(contributed: DataFrame, n: int = 3) -> DataFrame:
    """reason, dimension and the list as text: ``a (5), b (2) (+1 more)``."""
    shown = top(contributed, n).groupBy("reason", "dimension").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "drops"))), lambda x: F.concat(x["name"], F.lit(" ("), x["drops"].cast("string"), F.lit(")"))).alias("items"), F.max("more").alias("more"))
    return shown.select("reason", "dimension", F.concat(F.array_join("items", ", "), F.when(F.col("more") > 0, F.concat(F.lit(" (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise("")).alias("top"))


def summary_order(reported: DataFrame) -> DataFrame:
    """Infrastructure before transient, most drops first, then by name."""
    return reported.orderBy(class_rank(F.col("class")), F.desc("drops"), "reason")
