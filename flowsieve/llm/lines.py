"""Line deduplication on hashes: only line hashes and per-document bitmaps are ever shuffled for the decision.

1. Each document becomes an array of line-key hashes (96 bits; null where the key is empty).
2. All occurrences are range-partitioned by hash and sorted by hash, document and position. Going through them in that order, a
   row begins a document of its key where the row before is of another one; that counts the documents of each key and
   takes the first (document, position).
3. A line that a third of all documents share must not be one task's. Keys found in ``HOT_DOCS`` documents of a sample are cut into
   many ranges by a hash of the document, at most ``HOT_KEYS`` of them. The sample decides where rows go. Such keys
   are known to be frequent, as the sample alone has enough documents; the first occurrence is then the lowest of their ranges'.
4. The positions of dropped lines are folded into 64-bit words, one sparse bitmap per document.
5. The bitmaps meet the text once, by a hash join on the document. What is returned of them is their run lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, shuffle_width

BLANKS = " \t\n\x0b\x0c\r"
#: Share of the documents in the sample, documents of it that make a key hot, and hot keys at most.
SAMPLED, HOT_DOCS, HOT_KEYS = 64, 16, 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_lines(text: Column) -> Column:
    """Lines of a text cut at \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(lines: Column) -> Column:
    """Keys of lines: blanks stripped at both ends, A-Z lower-cased and nothing else."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    # lower() is the fast way, and the right one where all characters are ASCII
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, UPPER.lower())))


def dropped_lines(docs: DataFrame, space: Workspace, min_docs: int = 10, min_chars: int = 1, keep: str = "none", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a dropped line: __id, __th (hash of its text) and ``drop``, an array of words of 64 drop bits that ends with the last dropped line.

    A row of ``docs`` is a document, also where ids repeat; documents are told apart by id and text.
    ``keep``: "none" drops all lines of a key found in ``min_docs`` documents or more, "first" spares the
    first occurrence by (document, position)."""
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    hashed = docs.select(
        F.col(doc_id).alias("__id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__th"),
        F.monotonically_increasing_id().alias("__row"),
        F.transform(line_keys(split_lines(F.col(text))), lambda k: F.when(F.char_length(k) >= max(1, min_chars), F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b")))).alias("keys"),
    )
    hashed = space.write(hashed, "keys")
    sample = hashed.filter(F.pmod(F.xxhash64("__row"), F.lit(SAMPLED)) == 0).select(F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k"))
    common = sample.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(HOT_DOCS, min_docs)).orderBy(F.desc("n"), "a", "b").limit(HOT_KEYS)
    hot = F.broadcast(space.write(common.select("a", "b", F.lit(True).alias("hot")), "hot", 1))  # at most HOT_KEYS rows
    width = shuffle_width(docs.sparkSession)
    at = hashed.select("__id", "__th", "__row", F.posexplode("keys").alias("pos", "k")).filter("k is not null").select("k.a", "k.b", "__id", "__th", "__row", "pos")
    at = at.join(hot, ["a", "b"], "left").withColumn("cut", F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("__row"), F.lit(width))).otherwise(0).cast("int"))
    order = ["__id", "__th", "__row", "pos"]
    placed = at.repartitionByRange(width, "a", "b", "cut").sortWithinPartitions("a", "b", "cut", *order)
    key = Window.partitionBy("a", "b", "cut")
    before = F.lag("__row").over(key.orderBy(*order))
    begun = placed.withColumn("begins", before.isNull() | (before != F.col("__row")))
    streamed = begun.withColumn("docs", F.count_if("begins").over(key)).filter(F.col("hot") | (F.col("docs") >= min_docs))
    hits = streamed
    if keep == "first":
        here = F.struct("__id", "__th", "pos")
        streamed = streamed.withColumn("first", F.min(here).over(key))
        lowest = streamed.filter("hot").groupBy("a", "b").agg(F.min("first").alias("lowest"))  # at most HOT_KEYS rows
        hits = streamed.join(F.broadcast(lowest), ["a", "b"], "left").filter(here != F.coalesce("lowest", "first"))
    words = hits.groupBy("__id", "__th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    listed = words.groupBy("__id", "__th").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held"))
    # words without a dropped line, between those that have one, are 0
    gap = lambda x, i: x["word"] - F.when(i == 0, F.lit(-1)).otherwise(F.get("held", i - 1)["word"]) - 1
    filled = F.flatten(F.transform("held", lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(x, i)), F.array(x["bits"]))))
    return listed.select("__id", "__th", filled.alias("drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text's repeated lines taken out, and n_lines, n_dropped and keep_bitmap (run lengths of kept and dropped lines in turn; kept first, 0 if none).

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` rows lose their lines everywhere;
    other lines stay in order, joined by \\n. Null or empty text: one empty line, kept (text ''). Blank lines are
    never dropped. Repeated rows count as documents each. Null ids are ids like any other. Columns named like the
    results are replaced. An empty table gives an empty result."""
    space = Workspace(docs.sparkSession, "lines")
    drop = dropped_lines(docs, space, min_docs, min_chars, keep, doc_id, text).withColumnRenamed("drop", "__drop")
    clean = docs.drop("n_lines", "n_dropped", "keep_bitmap")
    rows = clean.withColumn("__rt", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = rows.join(drop.hint("shuffle_hash"), rows[doc_id].eqNullSafe(drop["__id"]) & (rows["__rt"] == drop["__th"]), "left")
    lines = split_lines(F.col(text))
    bit = lambda i: F.coalesce(F.getbit(F.get("__drop", (i / 64).cast("int")), i % 64), F.lit(0)) == 1
    left = F.when(F.col("__drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda x, i: ~bit(i)), "\n"))
    n_lines = F.size(lines)
    every = F.sequence(F.lit(0), n_lines - 1)
    turns = F.filter(every, lambda i: (i > 0) & (bit(i) != bit(i - 1)))  # where a run begins that is not the first
    ends = F.concat(F.when(bit(F.lit(0)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), turns, F.array(n_lines))
    runs = F.zip_with(ends, F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends)), lambda end, start: end - start)
    bitmap = F.when(F.col("__drop").isNull(), F.array(n_lines)).otherwise(runs)
    return joined.select(
        *[left.alias(text) if c == text else F.col(c) for c in clean.columns],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("__drop", F.lit(0).cast("long"), lambda n, b: n + F.bit_count(b)), F.lit(0)).cast("long").alias("n_dropped"),
        bitmap.alias("keep_bitmap"),
    )
