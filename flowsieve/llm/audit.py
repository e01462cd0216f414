"""How filters interact: what each removes in every order, from signed parity sums.

A document's failures are a mask of bits, one for each filter. For every set S of filters one sum is taken per part and label, of +1 for
a mask with an even number of failures in S and -1 for an odd one: the Walsh-Hadamard transform of the counts by mask, built by partial
aggregation (2^k numbers a part and task, however many documents). Its inverse is exact in whole numbers and gives the count of each mask.

From the counts come, for every order of the filters, the documents kept and removed at each step: K[P], those that fail none of the filters in P,
answers each of them by one or two look-ups. A filter's Shapley value over all k! orders has a closed form: a document with c failures is
removed by each of them in k!/c orders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .workspace import Workspace, arrow_map

FILTERS = "ABCDE"
#: The bit of the filter that needs the whole table.
COPY = FILTERS.index("E")
_SYMBOL, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_CAPITAL[65:91] = True


def _counted(chosen: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each document's bytes are chosen."""
    out, full = np.zeros(len(offsets) - 1, np.int64), offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(chosen.view(np.uint8), offsets[:-1][full], dtype=np.int64)
    return out


def text_failures(chunk: tn.Chunk) -> np.ndarray:
    """Masks of the filters A to D that the documents of a chunk fail."""
    starts, ends, firsts = chunk.words()
    words, hashes = np.diff(firsts), tn.span_hashes(chunk.data, starts, ends)
    owner = np.repeat(np.arange(chunk.n), words)
    order = np.lexsort((hashes, owner)) if chunk.n > 1 else np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(owner[new], minlength=chunk.n)
    points = np.diff(chunk.offsets) - _counted((chunk.data & 0xC0) == 0x80, chunk.offsets)
    fails = [words < 200, 100 * distinct < 50 * words, 100 * _counted(_CAPITAL[chunk.data], chunk.offsets) > 2 * points, _counted(_SYMBOL[chunk.data], chunk.offsets) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = [text_failures(chunk) for chunk in tn.string_chunks(batch.column(3))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(masks) if masks else [], pa.int32())], ["doc_id", "part", "digest", "mask"])


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of every document: the filters A to E that it fails and its labels.

    E: a smaller doc_id has the identical text anywhere in the table; the smallest of each text is joined on id and text, so a text with a
    third of all documents is no hot key. A null text is empty, a null source the part ''. A document without an id comes after none and before none, so it neither
    fails E nor makes others fail it, and has no labels. Repeated rows count each; of an id's label rows one with the value 1 is enough.
    Other columns are not read."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("digest"), body.alias("text"))
    space = Workspace(docs.sparkSession, "audit")
    rows = space.write(arrow_map(rows, _judge, "doc_id long, part string, digest binary, mask int"), "masks")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    named = rows.filter("doc_id is not null")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = named.join(firsts, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    no = F.lit(False)
    marked = marked.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << COPY)).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return marked.unionByName(rows.filter("doc_id is null").select("part", "mask", no.alias("good"), no.alias("toxic")))


def parity_sums(marked: DataFrame, names: str = FILTERS, labels: Sequence[str] = ()) -> DataFrame:
    """part, label and sums: the signed parity sums of all 2^k sets of filters, of all documents (label '') and of those with each label."""
    own = F.array_compact(F.array(F.lit(""), *[F.when(F.col(c), F.lit(c)) for c in labels]))
    each = marked.select("part", "mask", F.explode(own).alias("label"))
    sign = lambda s: 1 - 2 * F.pmod(F.bit_count(F.col("mask").bitwiseAND(F.lit(s))), F.lit(2))
    sums = each.groupBy("part", "label").agg(*[F.sum(sign(s)).alias(f"s{s}") for s in range(1 << len(names))])
    return sums.select("part", "label", F.array(*[F.col(f"s{s}").cast("long") for s in range(1 << len(names))]).alias("sums"))


def _each(n: int, run) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), run)


def _total(n: int, value) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda t, i: t + value(i))


def mask_counts(sums: Column, n: int) -> Column:
    """The number of documents with each mask: the inverse of the parity sums, exact."""
    sign = lambda m, s: 1 - 2 * F.pmod(F.bit_count(m.bitwiseAND(s)), F.lit(2))
    return _each(n, lambda m: F.expr("0L") + F.shiftright(_total(n, lambda s: F.get(sums, s) * sign(m, s)), int(math.log2(n))))


def interaction_audit(marked: DataFrame, names: str = FILTERS, labels: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, NAME_lost for each label, and shapley.

    ``marked`` has part, mask (bit i: the document fails the filter names[i]) and a boolean column a label. A row for each part that occurs, order of all filters and step.
    An empty table gives an empty result. Every part is one row of 2^k counts a label until the orders are listed, so hot parts cost no more than others."""
    n = 1 << len(names)
    counted = parity_sums(marked, names, labels).select("part", "label", mask_counts(F.col("sums"), n).alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), n)
    of = lambda label: F.coalesce(F.first(F.when(F.col("label") == label, F.col("cells")), ignorenulls=True), none).alias(f"cells_{label}")
    cells = counted.groupBy("part").agg(*[of(x) for x in ("", *labels)])
    free = lambda c: _each(n, lambda p: _total(n, lambda m: F.when(m.bitwiseAND(p) == 0, F.get(F.col(c), m)).otherwise(0)))
    by = cells.select("part", F.col("cells_").alias("cells"), *[free(f"cells_{x}").alias(f"free_{x}") for x in ("", *labels)])
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(names))), ",")
    bit = lambda i: f"shiftleft(1, instr('{names}', substr(filter_order, {i}, 1)) - 1)"
    steps = by.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    steps = steps.withColumn("bit", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (m, i) -> if(i < step, m | {bit('i')}, m))"))
    steps = steps.withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    at = lambda c, p: F.get(F.col(c), p if isinstance(p, Column) else F.col(p))
    lost = lambda x: at(f"free_{x}", "before") - at(f"free_{x}", "after")
    share = _total(n, lambda m: F.when(m.bitwiseAND(F.col("bit")) != 0, F.get(F.col("cells"), m) * F.expr(f"{math.factorial(len(names))}L").cast("long") / F.greatest(F.bit_count(m), F.lit(1))).otherwise(0).cast("long"))
    return steps.select(
        "part", "filter_order", "step", at("free_", "after").alias("kept"), lost("").alias("removed"), (at("free_", F.lit(0)) - at("free_", "bit") - lost("")).alias("redundant"),
        at("cells", "bit").alias("unique_fails"), *[lost(x).alias(f"{x}_lost") for x in labels], share.alias("shapley"),
    )
