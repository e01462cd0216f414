"""Lempel-Ziv phrase fingerprints: documents that compress alike look alike.

A text's UTF-8 bytes are cut into LZ78 phrases: each is the shortest run not met before in the text. The set of
phrases is kept as the lowest hashes of the set (a minimum-hash signature), and two signatures estimate the share of
phrases that their texts have in common. As compressors do, the parse starts a new dictionary when one is full (``PHRASES``), so its
memory doesn't grow with the text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .workspace import arrow_map, even_buckets, shuffle_width

SIGNATURE = 128
#: Phrases of one dictionary.
PHRASES = 1 << 18


class Parse:
    """The phrases of the bytes fed so far; ``fork`` lets two continuations share a beginning."""

    __slots__ = ("children", "node", "count", "ends", "data")

    def __init__(self, children: dict[int, int] | None = None, node: int = 0, count: int = 0, ends: array | None = None, data: bytes = b""):
        self.children, self.node, self.count, self.ends, self.data = children or {}, node, count, ends or array("q"), data

    def fork(self) -> Parse:
        return Parse(self.children.copy(), self.node, self.count, self.ends[:], self.data)

    def feed(self, data: bytes) -> Parse:
        """The tree of phrases is a map from (phrase number, next byte) to phrase number; phrase 0 is the empty one."""
        children, node, count = self.children, self.node, self.count
        get, add = children.get, self.ends.append
        for at, byte in enumerate(data, len(self.data) + 1):
            key = node << 8 | byte
            node = get(key, 0)
            if not node:
                count += 1
                children[key] = count
                add(at)
                if count == PHRASES:
                    children.clear()
                    count = 0
        self.node, self.count, self.data = node, count, self.data + data
        return self

    def signature(self, size: int = SIGNATURE) -> np.ndarray:
        """The lowest distinct hashes of the phrases; bytes left over at the end of the text are a phrase as well."""
        ends = np.frombuffer(self.ends, np.int64) if self.ends else np.zeros(0, np.int64)
        if len(self.data) > (self.ends[-1] if self.ends else 0):
            ends = np.append(ends, len(self.data))
        if not len(ends):
            return np.zeros(0, np.uint32)
        starts = np.concatenate([[0], ends[:-1]])
        told = (tn.span_hashes(np.frombuffer(self.data, np.uint8), starts, ends) >> tn.U64(32)).astype(np.uint32)
        if len(told) > 4 * size:  # the lowest few suffice, and there are enough distinct ones among them as a rule
            low = np.unique(np.partition(told, 2 * size)[: 2 * size])
            if len(low) >= size:
                return low[:size]
        return np.unique(told)[:size]


def fingerprint(signature: np.ndarray) -> str:
    """Hexadecimal text, eight digits for each hash in rising order; empty for an empty text."""
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    """Share of common phrases among the lowest hashes of both; 1 for two empty signatures."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SIGNATURE) -> DataFrame:
    """``docs`` with the fingerprint of the text in place of the text. Null or empty: an empty fingerprint. Equal texts have equal ones."""
    rest = [c for c in docs.columns if c not in (text, out)]
    source = docs.select(*rest, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(Parse().feed((t.as_py() or "").encode()).signature(size)) for t in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(prints, pa.string())], [*rest, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return arrow_map(source, run, ", ".join([*fields, f"`{out}` string"]))


def fingerprint_likeness(a: str, b: str, size: int = SIGNATURE) -> float:
    """Likeness of two fingerprints as text."""
    read = lambda x: np.frombuffer(bytes.fromhex(x), ">u4")
    return likeness(read(a), read(b), size)


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below ``value``: first among every n-th of them, then between two of those."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    numbers = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = below(numbers(cuts[step - 1 :: step]))
    return block * step + below(F.element_at(F.array(*[numbers(cuts[i : i + step]) for i in range(0, len(cuts) + 1, step)]), block + 1))


def _neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, guest, doc_id, text) so that each document's next one is in its bucket, after it: by falling id, null ids last by their texts' hashes.

    Ids are cut into ranges by quantiles of the ids and null ids by hash; each range's first document is also sent, as a guest, to the
    range before it, and the very first to the last range. The driver sees a number per range."""
    ids = docs.select("doc_id").filter("doc_id is not null")
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    hashed = docs.withColumn("th", F.xxhash64("text"))
    bare = len(cuts) + 1 + F.floor((F.shiftrightunsigned("th", 32) * parts) / F.lit(2**32))  # in the order of unsigned hashes
    last = F.lit(len(cuts))
    hashed = hashed.withColumn("bucket", F.coalesce(last - _range_of(F.col("doc_id"), cuts), bare).cast("int"))
    # the first of a range: its highest id, or its lowest hash
    place = F.coalesce(F.bitwise_not("doc_id"), F.col("th").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    tops = hashed.groupBy("bucket").agg(F.min(place).alias("top")).orderBy("bucket").collect()  # a row for each range
    ranges = docs.sparkSession.createDataFrame([(r["bucket"], r["top"], tops[i - 1]["bucket"]) for i, r in enumerate(tops)], "bucket int, top long, goes int")
    own = hashed.join(F.broadcast(ranges), "bucket").withColumn("place", place)  # at most 2 * parts rows
    there = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    sent = F.when(F.col("place") == F.col("top"), F.array(there, F.struct(F.col("goes").alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(there))
    rows = own.withColumn("to", F.explode(sent))
    codes = even_buckets(docs.sparkSession, len(cuts) + 1 + parts)
    number = F.element_at(F.array(*[F.lit(c) for c in codes]), F.col("to.b") + 1)
    return rows.select(number.alias("bucket"), F.col("to.guest").alias("guest"), "doc_id", "text", "place").repartition(len(codes), "bucket")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited_pairs(size: int):
    import hashlib

    def one(doc_id, text: str, following: str | None, following_signature: np.ndarray) -> tuple:
        n = len(text)
        half = n // 2
        start = text[: n - half].encode()
        begun = Parse().feed(start)
        edited_tail = (following or "")[:half].encode()
        edited = begun.fork().feed(edited_tail).signature(size)
        own = begun.feed(text[n - half :].encode()).signature(size)
        digest = hashlib.sha256(start + edited_tail).hexdigest()
        return doc_id, n, digest, own, edited, likeness(own, edited, size), following_signature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def push(row: tuple) -> None:
            out.append((row[0], row[1], row[2], fingerprint(row[3]), fingerprint(row[4]), row[5], row[6]))

        def flush() -> pa.RecordBatch:
            names = [f.strip().split(" ")[0] for f in _OUT.split(",")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        waiting = None  # (bucket, doc_id, text)
        ready = None  # its row, without near_next, where its signature was already needed
        for batch in batches:
            for bucket, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                text = text or ""
                if waiting is not None and waiting[0] == bucket:
                    row = one(waiting[1], waiting[2], text, None)
                    if ready is not None:  # the one before waits for this signature
                        push((*ready[:6], likeness(ready[3], row[3], size)))
                    ready = row
                    if guest:
                        push((*ready[:6], likeness(ready[3], Parse().feed(text.encode()).signature(size), size)))
                        waiting = ready = None
                        if len(out) >= 200:
                            yield flush()
                            out = []
                        continue
                waiting = None if guest else (bucket, doc_id, text)
                if len(out) >= 200:
                    yield flush()
                    out = []
        if out:
            yield flush()

    return run


def edited_likeness(docs: DataFrame, size: int = SIGNATURE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document by falling id (after the last: the first).

    The edited text's last floor(n/2) code points are the first as many (or all) of the next document. Null texts are empty.
    Null ids come last, in the order of their texts' hashes; rows of one id are in the order of their texts. A single document is its own next. Other columns are
    not read. An empty table gives an empty result."""
    bare = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = shuffle_width(docs.sparkSession)
    placed = _neighbours(bare, parts).sortWithinPartitions("bucket", "guest", "place", "text").drop("place")
    return arrow_map(placed, _edited_pairs(size), _OUT)
