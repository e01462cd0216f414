"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) are summed by source; targets share the total by weight, stopping at ``cap`` times a source's size.
2. Each source's documents are put in an order by hash. Runs of about 1/``blocks`` of the source's words are its blocks; a longer
   document is a block of its own, so a source has at most 2 * ``blocks`` of them, whatever its size. Blocks of like size (within a
   factor of two) form a class.
3. A source's quota of each class is exact: every block as often as the target holds the source, and of the rest a share of
   each class, the longest first. What a class can't take in whole blocks goes on to the shorter ones; what then is left is closed by the
   next blocks of any class (from the next round, where a class is through with this one) while one lessens it.
4. The splitting tree halves the output shards again and again: a node's quotas of all sources and classes are dealt between its halves
   by one multivariate-hypergeometric draw, so they stay exact at every node down to the shards.
5. The blocks of a class are permuted anew for each round through it; a shard takes the next run of its quota, so no block is drawn twice
   in a round, and a block beyond all shards' quotas is not taken. Within a shard, documents go by hash.

Only sizes and keys are shuffled for the plan; the driver sees a row for each class of each source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .workspace import Workspace, arrow_map, even_buckets, shuffle_width

WEIGHTS = (5, 2, 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.diff(chunk.words()[2]) for chunk in tn.string_chunks(batch.column(3))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], ["doc_id", "th", "source", "size"])


def word_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, th (hash of the text), source and size in words of every row; a null text has none."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(source).cast("string").alias("source"), F.col(text))
    return arrow_map(rows, _count_words, "doc_id long, th long, source string, size long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3) -> DataFrame:
    """source, source_size, target. Sources go by code point, null last, and take the weights in turn."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    # The share per weight at which a source reaches its cap; sources stop in this order.
    weighed = weighed.withColumn("stop", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    earlier = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = weighed.withColumn("level", left / rest)
    share = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", F.col("source").isNull().alias("none"), "source", "level"))).over(whole)["level"]
    return level.withColumn("share", share).select("source", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("share") * F.col("weight")).alias("target"))


def _order_hash(seed: int, *keys: Column) -> Column:
    """Number in [0, 2^32) from a seed and keys, by a hash that other engines have as well."""
    text = F.concat_ws(":", F.lit("mix"), F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _running(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with k (place in the source's order by h and ``order``, from 0) and start (words before it)."""
    parts = shuffle_width(rows.sparkSession)
    cut = rows.withColumn("r", F.floor(F.col("h") * F.lit(parts) / F.lit(2**32)).cast("int"))
    sums = cut.groupBy("source", "r").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col("source").alias("g"), F.col("r").alias("gr"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("source", "r").orderBy("h", *order)
    local = cut.withColumn("k", F.row_number().over(inside) - 1).withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = local.join(first, local["source"].eqNullSafe(first["g"]) & (local["r"] == first["gr"]))
    return joined.select(*rows.columns, (F.col("k") + F.col("n0")).alias("k"), (F.col("start") + F.col("s0")).alias("start"))


def partial_quotas(words: Sequence[np.ndarray], rest: float) -> list[int]:
    """How many of the first blocks of each class make up ``rest`` words. ``words``: the blocks' words by class, a row for each round
    left, in the order of its draw; classes from the shortest blocks to the longest."""
    sums = [np.concatenate([[0], np.cumsum(w[0])]) for w in words]
    share = rest / max(1, sum(int(s[-1]) for s in sums))
    taken, gap = [0] * len(sums), 0.0
    for c in reversed(range(len(sums))):
        gap += share * float(sums[c][-1])
        taken[c] = int(np.searchsorted(sums[c], gap, side="right")) - 1
        gap -= float(sums[c][taken[c]])
    drawn = [w.ravel() for w in words]
    while True:  # the next blocks of the classes: those that fit, the longest first, and at last one that overshoots by less
        ahead = [(float(w[k]), c) for c, (w, k) in enumerate(zip(drawn, taken, strict=True)) if k < len(w)]
        fits = max((x for x in ahead if x[0] <= gap), default=None) or min((x for x in ahead if x[0] < 2 * gap), default=None)
        if fits is None:
            return taken
        taken[fits[1]] += 1
        gap -= fits[0]


_DRAWN = "source string, block long, class int, blocks long, quota long, places array<long>"


def _draw_blocks(cap: int):
    """Of one source's blocks (block, h, words, source_size, target): class, blocks and quota of the class, and the place in each round's permutation."""

    def run(table: pa.Table) -> pa.Table:
        block, h, words = (table[c].to_numpy() for c in ("block", "h", "words"))
        size, target = int(table["source_size"][0].as_py()), float(table["target"][0].as_py())
        full = min(cap, int(target // size))
        by_block = np.argsort(block)
        block, h, words = block[by_block], h[by_block].view(np.uint64), words[by_block]
        own = np.frexp(words.astype(float))[1]
        classes, at, sizes = np.unique(own, return_inverse=True, return_counts=True)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        places, orders = np.zeros((len(block), cap), np.int64), []
        for e in range(cap):
            drawn = np.lexsort((block, tn.mix64(h + np.uint64(e)), own))
            places[drawn, e] = np.arange(len(block)) - cuts[at[drawn]]
            orders.append(words[drawn])
        quota = full * sizes
        if full < cap:
            left = np.stack(orders[full:])
            quota = quota + np.array(partial_quotas([left[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], target - full * size), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * cap, pa.int32()), pa.array(places.ravel()))
        return pa.table([table["source"].combine_chunks().take(pa.array(by_block)), pa.array(block), pa.array(own.astype(np.int32)), pa.array(sizes[at]), pa.array(quota[at]), lists], names=["source", "block", "class", "blocks", "quota", "places"])

    return run


#: numpy draws hypergeometric numbers from fewer of either kind.
NUMPY_MOST = 10**9


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` things drawn out of ``good`` and ``bad`` ones are good.

    Beyond numpy's range by inversion of the law, over the counts within 14 standard deviations of its mean: what lies beyond has less weight than a double can tell."""
    if good < NUMPY_MOST and bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    total, low, high = good + bad, max(0, sample - bad), min(good, sample)
    share = good / total
    spread = (sample * share * (1 - share) * ((total - sample) / max(1, total - 1))) ** 0.5
    low, high = max(low, int(sample * share - 14 * spread) - 20), min(high, int(sample * share + 14 * spread) + 20)
    k = np.arange(high - low, dtype=np.float64)  # counts above the lowest
    steps = np.log(good - low - k) + np.log(sample - low - k) - np.log(low + k + 1) - np.log(bad - sample + low + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources table of blocks whose columns sum to ``quotas``; shards' totals differ by the rounding of halves only."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def deal(low: int, high: int, held: np.ndarray) -> None:
        if high - low == 1:
            out[low] = held
            return
        middle = (low + high) // 2
        total = int(held.sum())
        want = total * (middle - low) // (high - low)
        drawn, left = np.zeros_like(held), want
        rng = np.random.default_rng([seed, low, high])
        for s, own in enumerate(held):  # the marginal draws of the multivariate law, one source after the other
            if left == 0:
                break
            total -= int(own)
            drawn[s] = left if total == 0 else _hypergeometric(rng, int(own), total, left)
            left -= int(drawn[s])
        deal(low, middle, drawn)
        deal(middle, high, held - drawn)

    deal(0, shards, np.asarray(quotas, np.int64))
    return out


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = 3, shards: int = 16, blocks: int = 1 << 16, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, th, source, size, source_size, target, copies, shards (one for each copy) and taken (words).

    A source's taken words differ from its target by less than its shortest block that could still be taken: at most 1/``blocks`` of
    the source's words, or one document where all are longer.
    A pure function of the rows and parameters. Null or empty texts have size 0 and take nothing; a null source is one source, the last.
    Repeated rows are documents each. Other columns are not read. An empty table gives an empty result."""
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    sizes = space.write(word_sizes(docs, doc_id, text, source), "sizes")
    targets = space.write(source_targets(sizes, weights, cap), "targets", 1)
    placed = _running(sizes.withColumn("h", _order_hash(seed, F.col("doc_id"))), ["doc_id", "th", "size"])
    unit = F.greatest(F.lit(1), F.ceil(F.col("source_size") / blocks))
    block = F.when(F.col("size") >= unit, -1 - F.col("k")).when(F.col("size") > 0, F.expr("start div unit"))
    known = targets.withColumnRenamed("source", "g")
    placed = placed.join(known, placed["source"].eqNullSafe(known["g"])).withColumn("unit", unit).withColumn("block", block)
    placed = space.write(placed.select("doc_id", "th", "source", "size", "source_size", "target", "k", "block"), "placed")
    made = placed.filter("block is not null").groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    made = made.withColumn("h", F.xxhash64(F.lit(seed + 1), "source", "block"))
    drawn = space.write(made.groupBy("source").applyInArrow(_draw_blocks(cap), _DRAWN), "blocks")
    quotas = sorted(((r["source"], r["class"], r["quota"]) for r in drawn.groupBy("source", "class").agg(F.first("quota").alias("quota")).collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
    dealt = splitting_tree(np.array([n for *_, n in quotas], np.int64), shards, seed).cumsum(axis=0).T if quotas else np.zeros((0, shards))
    ends = spark.createDataFrame([(s, c, [int(x) for x in row]) for (s, c, _), row in zip(quotas, dealt, strict=True)], "g string, gc int, ends array<long>")
    # the place of a copy in its class, round after round; shards whose quotas end before it are passed, and with the last shard the copy itself
    shard = lambda p, e: F.size(F.filter("ends", lambda x: x <= p + e * F.col("blocks")))
    homes = drawn.join(ends, drawn["source"].eqNullSafe(ends["g"]) & (drawn["class"] == ends["gc"]))
    homes = homes.select(F.col("source").alias("bs"), F.col("block").alias("bb"), F.filter(F.transform("places", shard), lambda s: s < shards).alias("shards"))
    sent = placed.join(homes, placed["source"].eqNullSafe(homes["bs"]) & (placed["block"] == homes["bb"]), "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    return sent.select("doc_id", "th", "source", "size", "source_size", "target", F.size("shards").alias("copies"), "shards", (F.size("shards") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, plan: DataFrame, shards: int = 16, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", extra: bool = False) -> DataFrame:
    """The mixed corpus: each document as often as ``plan`` says, shard after shard, shuffled within it. ``shards`` is the plan's number. ``extra`` keeps mix_shard and mix_epoch.

    A shard is cut into as many ranges of its order as the session's shuffle partitions ask for; a range is a partition, so a task
    holds no whole shard and the order of the corpus doesn't depend on the session.

    Rows of the same id, text and source take the plan's rows in turn, by their other columns."""
    dealt = F.sort_array(F.collect_list(F.when(F.col("copies") > 0, F.col("shards"))))
    shared = plan.groupBy(F.col("doc_id").alias("__pid"), F.col("th").alias("__pth"), F.col("source").alias("__ps")).agg(dealt.alias("__to"), F.count(F.lit(1)).alias("__rows"))
    shared = Workspace(docs.sparkSession, "mix").write(shared.filter(F.size("__to") > 0), "plan")
    rows = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = rows[doc_id].cast("long").eqNullSafe(F.col("__pid")) & (rows["__th"] == F.col("__pth")) & rows[source].cast("string").eqNullSafe(F.col("__ps"))
    joined = rows.join(shared.hint("shuffle_hash"), same).withColumn("__row", F.lit(1))
    if not shared.filter("__rows > 1").isEmpty():  # the same id, text and source more than once
        others = F.to_json(F.struct(F.lit(0).alias("__0"), *[c for c in docs.columns if c != text]))
        turn = F.row_number().over(Window.partitionBy("__pid", "__pth", "__ps").orderBy(others))
        joined = joined.filter("__rows = 1").unionByName(joined.filter("__rows > 1").withColumn("__row", turn).filter(F.col("__row") <= F.size("__to")))
    copies = joined.select(*docs.columns, "__th", "__row", F.posexplode(F.element_at("__to", F.col("__row"))).alias("mix_epoch", "mix_shard"))
    order = F.xxhash64(F.lit(seed + 2), F.col(doc_id), F.col("__th"), F.col("mix_epoch"))
    ranges = max(1, -(-shuffle_width(docs.sparkSession) // shards))
    at = F.col("mix_shard") * ranges + F.floor((F.shiftrightunsigned("__o", 32) * ranges) / F.lit(2**32)).cast("int")
    home = F.element_at(F.array(*[F.lit(b) for b in even_buckets(docs.sparkSession, shards * ranges)]), at + 1)
    turn = F.shiftrightunsigned("__o", 32), F.col("__o"), F.col("__row")
    mixed = copies.withColumn("__o", order).repartition(shards * ranges, home).sortWithinPartitions("mix_shard", *turn)
    return mixed.select(*docs.columns, *(["mix_shard", "mix_epoch"] if extra else []))
