"""Packing of documents into training sequences, with the sources in target proportions throughout.

Every source has a queue of its documents, in an order by hash. Deficit round-robin fills window after window of one sequence's length: a source with the
share p of the corpus gains ``p * length`` tokens of credit a window and sends its next documents, whole, while they fit its credit; what is left
of the credit is its deficit and goes on to the next window. A queue's documents up to a place have left by the first window in which the credit gained so far
reaches the tokens up to that place, so with the running sums of each queue the window of every document is one division: no loop, no order of
tasks, and deficits cross windows and partitions by the sums alone.

Windows are then laid end to end, each source's documents in turn, and cut into sequences of ``length`` tokens. What is left at the end is cut
into powers of two, which need no padding; so no sequence has any.

Running sums are taken within runs of a bounded number of rows and then over the runs' totals (``running_sums``). Only ids, sizes and places are shuffled for that; token ids
once, to their places.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, arrow_map

LENGTH, END = 2048, 1
#: Documents in a run of a source's queue on average; windows in a run of the whole order; runs in a group of runs.
RUN_DOCS, RUN_WINDOWS, GROUP = 4096, 64, 1024
#: Bytes of text at once; distinct words that a worker remembers; words that go through the library as one text; characters of a word that tables cut, at most.
CHUNK, CACHE, JOINED, SHORT = 1 << 20, 150_000, 1000, 1 << 10


# How the public word tokenizer normalises and cuts text, and the characters for which Python's own tables give the same.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PLAIN = [c for c in (*range(0x21, 0x7F), *range(0xA1, 0x300)) if all(0x20 < ord(x) < 0x300 for x in chr(c).lower())]


def _byte_names() -> dict[int, int]:
    """The character by which a byte-level vocabulary names each byte: printable ones by themselves, the others in turn from 0x100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(others)}


_NAMES = _byte_names()


class Recent:
    """A dictionary of between ``CACHE`` and twice as many entries, those met last."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, keys: list[str], make: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """What is remembered of distinct ``keys``, and what ``make`` gives for the others, in their order; all of them are in ``young`` from now on."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, out = self.young, list(map(self.young.get, keys))
        gone = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(gone, list(map(self.old.get, [keys[i] for i in gone])), strict=True):
            if x is not None:
                out[i] = young[keys[i]] = x
        gone = [i for i in gone if out[i] is None]
        if gone:
            for i, x in zip(gone, make([keys[i] for i in gone]), strict=True):
                out[i] = young[keys[i]] = x
        return out


def _cut(raw: bytes, ends: list[int], gap: int = 0) -> list[bytes]:
    """``raw`` cut at ``ends``, without the ``gap`` bytes after each."""
    return [raw[a:b] for a, b in zip([0, *[e + gap for e in ends[:-1]]], ends, strict=True)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point to 0x300: 1 for letters, 2 for numbers, 3 for other characters and 0 for those that need more than a table, and the lower case."""
    kind, low = np.zeros(0x301, np.uint8), np.zeros(0x301, np.uint32)
    for c in _PLAIN:
        if chr(c) not in "'<" and len(chr(c).lower()) == 1:
            low[c] = ord(chr(c).lower())
            kind[c] = {"L": 1, "N": 2}.get(unicodedata.category(chr(low[c]))[0], 3)
    return kind, low


_KIND, _LOW = _classes()


def _spread(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all ``values`` on end, where each one's begin and how many they are."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return np.frombuffer(b"".join(values), np.uint32), np.cumsum(sizes) - sizes, sizes


class Encoder:
    """Token ids of texts by a tokenizer that takes words between white space apart, each by itself.

    The library encodes each distinct word that isn't remembered. For the public word tokenizer and words of Latin letters, its model alone encodes each distinct part that the
    tokenizer cuts them into: they are lower-cased and cut here, most by tables, many at once. The library's own steps for that cost more than its model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        marks = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = marks[0] if marks else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, cuts = (spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = normal == _NORMAL and cuts[0].get("pattern") == {"Regex": _CUT} and cuts[0].get("invert") and cuts[1:] == [_BYTES] and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        of = lambda kind: "".join(f"\\u{c:04x}" for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)
        every = "".join(f"\\u{c:04x}" for c in _PLAIN)
        self.plain = re.compile(f"[{every}]+").fullmatch if known else lambda w: None
        self.cut = re.compile("\n|" + _CUT.replace("[^\\s\\p{L}\\p{N}]", f"[^\n{of('L')}{of('N')}]").replace("\\p{L}", of("L")).replace("\\p{N}", of("N"))).findall
        self.known, self.model = known, self.tokenizer.model
        self.words, self.parts = Recent(), Recent()

    def _by_library(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words. Words without the tokenizer's mark, a special token, go through the library joined by it, many at once: it cuts there before anything else."""
        joined = [w for w in words if self.mark[1] not in w] if self.mark else []
        alone = [w for w in words if self.mark[1] in w] if self.mark else words
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            yield w, array("I", e.ids).tobytes()
        groups = [joined[a : a + JOINED] for a in range(0, len(joined), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.mark[1].join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark[0])
            yield from zip(group, _cut(ids.tobytes(), [*(ends * 4).tolist(), len(ids) * 4], 4), strict=True)

    def _by_model(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts as the tokenizer cuts them, in their order, JOINED at a time."""
        tokenize = self.model.tokenize
        for a in range(0, len(parts), JOINED):
            found = [tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_NAMES)) for p in parts[a : a + JOINED]]
            ends = (np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) * 4).tolist()
            yield from _cut(array("I", [t.id for own in found for t in own]).tobytes(), ends)

    def _encode_words(self, words: list[str]) -> Iterable[bytes]:
        """Ids of distinct words, in their order."""
        plain = [w for w in words if "<|" not in w and self.plain(w)]
        if not plain:
            other = dict(self._by_library(words))
            return [other[w] for w in words]
        parts = self.cut("\n".join(plain).lower())  # each word's parts, then a line feed
        names = list({*parts} - {"\n"})
        known = dict(zip(names, self.parts.values(names, self._by_model), strict=True))
        known["\n"] = b""
        ids = [known[p] for p in parts]
        at = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        ends = [*at[[i for i, p in enumerate(parts) if p == "\n"]].tolist(), int(at[-1])]
        found = _cut(b"".join(ids), ends)
        if len(plain) == len(words):
            return found
        chosen = dict(zip(plain, found, strict=True))
        chosen.update(self._by_library([w for w in words if w not in chosen]))
        return [chosen[w] for w in words]

    def _encode_simple(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the distinct words ``names`` tables can cut into parts, the ids of those on end, and how many each has."""
        sizes = np.asarray(pc.utf8_length(names)).astype(np.int64)
        short = sizes <= SHORT
        sizes, data = sizes[short], "".join(names.filter(pa.array(short)).to_numpy(zero_copy_only=False).tolist())
        points = np.minimum(np.frombuffer(data.encode("utf-32-le"), "<u4"), 0x300)
        odd, ends = np.append(0, np.cumsum(_KIND[points] == 0)), np.cumsum(sizes)
        even = odd[ends] == odd[ends - sizes]
        points, sizes = _LOW[points[np.repeat(even, sizes)]], sizes[even]
        simple = short.copy()
        simple[short] = even
        if not len(points):
            return simple, np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        kind, to = _KIND[points], np.cumsum(sizes)
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
        new[to[to < len(points)]] = True
        # parts tile the words, so they are stretches of the lower-cased bytes
        first = np.flatnonzero(new)
        offsets = np.append((np.cumsum(1 + (points > 0x7F)) - (1 + (points > 0x7F)))[first], len(points) + np.count_nonzero(points > 0x7F)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.utf8(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(points.astype("<u4").tobytes().decode("utf-32-le").encode())]).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        pool, begins, long = _joined(self.parts.values(distinct, self._by_model))
        which = np.asarray(parts.indices)
        upto = np.append(0, np.cumsum(long[which]))[np.append(0, np.cumsum(new))[to]]  # ids to the end of each word
        return simple, _spread(pool, begins[which], long[which]), np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each with ``end`` after it, and where each text's ids end."""
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten()
        coded = flat.dictionary_encode()
        names, which = coded.dictionary, np.asarray(coded.indices)
        simple, ids, long = self._encode_simple(names) if self.known and len(names) else (np.zeros(len(names), bool), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        other, begun, rest = _joined(self.words.values(names.filter(pa.array(~simple)).to_pylist(), self._encode_words))
        pool = np.concatenate([ids, other, np.array([end], np.uint32)])
        begins, sizes = np.full(len(names) + 1, len(pool) - 1), np.ones(len(names) + 1, np.int64)
        begins[:-1][simple], sizes[:-1][simple] = np.cumsum(long) - long, long
        begins[:-1][~simple], sizes[:-1][~simple] = begun + len(ids), rest
        counts = np.diff(words.offsets.to_numpy() if len(words) else np.zeros(1, np.int32))
        # the words of all texts, and after each text's the end, which is the pool's last entry
        last = np.cumsum(counts + 1) - 1
        order = np.full(len(which) + len(counts), len(names), np.int64)
        inside = np.ones(len(order), bool)
        inside[last] = False
        order[inside] = which
        long = sizes[order]
        return _spread(pool, begins[order], long), np.cumsum(long)[last]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(text: str) -> Iterator[str]:
    """Parts of a long text that end at white space; a word is never cut."""
    at = 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        while to < len(text) and text[to] not in " \t\n\v\f\r":
            to += 1
        yield text[at:to]
        at = to


def _encode_long(encoder: Encoder, text: str, end: int) -> np.ndarray:
    parts = [encoder.encode(pa.array([part]), end)[0][:-1] for part in _pieces(text)]
    return np.concatenate([*parts, np.array([end], np.uint32)])


def _tokens(path: str, end: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            texts = batch.column(len(names))
            sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
                if b == a + 1 and sizes[a] - (sizes[a - 1] if a else 0) > CHUNK:
                    ids = _encode_long(encoder, texts[a].as_py(), end)
                    ends = np.array([len(ids)])
                else:
                    ids, ends = encoder.encode(texts.slice(a, b - a), end)
                offsets = np.concatenate([[0], ends])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], pa.array(np.diff(offsets), pa.int64()), data.cast(pa.binary())], [*names, "tokens", "ids"])
                a = b

    return run


def encode_documents(docs: DataFrame, path: str, end: int = END, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, digest (of the text), tokens and ids of every row: the text's token ids and then ``end``, as little-endian unsigned 32-bit numbers.

    A null text is empty and has the end alone; a null source is the source ''. ``path`` is a file that every executor can open, of a tokenizer that never joins words
    over white space (space and 0x09-0x0D)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.xxhash64(body).alias("digest"), body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, _tokens(path, end, ["doc_id", "source", "digest"]), f"doc_id {kind}, source string, digest long, tokens long, ids binary")


def running_sums(rows: DataFrame, keys: list[str], run: str, order: list[str], amount: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of ``amount`` over all earlier rows of the same ``keys`` in the order of (``run``, ``order``), and ``out``_of, the sum over all of them.

    ``run`` numbers runs of a bounded number of rows. Sums are taken within runs, over the runs of a group of GROUP, and over the groups, so the largest
    window holds a key's rows divided by those of a run and by GROUP."""
    sums = rows.groupBy(*keys, run).agg(F.sum(amount).alias("__sum")).withColumn("__group", F.floor(F.col(run) / GROUP))
    before = lambda by, at: F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = sums.groupBy(*keys, "__group").agg(F.sum("__sum").alias("__sum")).select(*keys, "__group", before(keys, "__group").alias("__outer"), F.sum("__sum").over(Window.partitionBy(*keys)).alias(f"{out}_of"))
    inner = sums.select(*keys, run, "__group", before([*keys, "__group"], run).alias("__inner"))
    first = inner.join(outer, [*keys, "__group"]).select(*keys, run, (F.col("__inner") + F.col("__outer")).alias("__first"), f"{out}_of")
    inside = Window.partitionBy(*keys, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__local", F.sum(amount).over(inside) - F.col(amount))
    return local.join(first, [*keys, run]).withColumn(out, F.col("__local") + F.col("__first")).drop("__local", "__first")


def _windows(queued: DataFrame, length: int, targets: Mapping[str, float], sizes: Mapping[str, int], total: int) -> DataFrame:
    """``queued`` (source, upto: the tokens of its queue to its end, size: those of the whole queue) with the window in which each document leaves.

    At a moment m every source that still has documents has gained its share of m tokens; the windows passed by then are filled by what all sources have gained."""
    named, rest = sum(sizes.values()), total - sum(sizes.values())
    left = 1 - sum(targets.values())
    if targets and (min(targets.values()) <= 0 or left < -1e-9 or (rest and left < 1e-9)):
        raise ValueError("targets are positive shares that leave something for the sources that they don't name")
    moment = F.col("upto") / F.col("size") * F.lit(float(rest) / left if targets and rest else float(total))
    for name, share in targets.items():
        moment = F.when(F.col("source") == name, F.col("upto") / F.lit(float(share))).otherwise(moment)
    gained = F.col("moment")
    if targets:
        gained = sum((F.least(F.lit(float(sizes.get(n, 0))), F.col("moment") * F.lit(float(t))) for n, t in targets.items()), F.least(F.lit(float(rest)), F.col("moment") * F.lit(left)) if rest else F.lit(0.0))
    return queued.withColumn("moment", moment).withColumn("window", F.ceil(gained / F.lit(float(length))).cast("long")).drop("moment")


def place(tokens: DataFrame, length: int = LENGTH, targets: Mapping[str, float] | None = None) -> DataFrame:
    """row and begin: where each document's first token stands in the order of all tokens, from 0 without gaps.

    ``tokens`` is a table of row (a number of its own for each), doc_id, source, digest and tokens. ``targets`` are shares of some sources; the others share what is left by their sizes,
    and by default all go by their sizes, so that every window has the corpus's own proportions to the end. With targets a source may run out; the others then go on in
    their proportions. Queues go by a hash of id and text, so the order of rows with ids depends on no partitioning; rows without an id are spread by ``row``."""
    runs = max(1, -(-tokens.count() // RUN_DOCS))
    hashed = tokens.withColumn("h", F.xxhash64("doc_id", "digest", F.when(F.col("doc_id").isNull(), F.col("row"))))
    cut = hashed.withColumn("run", F.floor(F.shiftrightunsigned("h", 32) * F.lit(runs) / F.lit(2**32)))
    queued = running_sums(cut, ["source"], "run", ["h", "doc_id", "digest", "row"], "tokens", "sent").withColumn("upto", F.col("sent") + F.col("tokens")).withColumnRenamed("sent_of", "size")
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    sizes = {r["source"]: r["n"] for r in tokens.filter(F.col("source").isin(*targets)).groupBy("source").agg(F.sum("tokens").alias("n")).collect()} if targets else {}
    dealt = _windows(queued, length, targets or {}, sizes, total).select("row", "source", "upto", "tokens", "window").withColumn("run", F.floor(F.col("window") / RUN_WINDOWS))
    return running_sums(dealt, [], "run", ["window", "source", "upto", "row"], "tokens", "begin").select("row", "begin")


def tail_bounds(total: int, length: int) -> list[int]:
    """Where sequences begin after the last whole one, and the end of all: runs of falling powers of two."""
    bounds, at = [total // length * length], total % length
    while at:
        part = 1 << (at.bit_length() - 1)
        bounds.append(bounds[-1] + part)
        at -= part
    return bounds


def cut_pieces(placed: DataFrame, total: int, length: int = LENGTH) -> DataFrame:
    """Pieces of documents (with tokens, ids and begin) within one sequence each: start, length, ids, doc_tokens, sequence_id, offset and sequence_tokens; no narrow dependence on other rows."""
    bounds = tail_bounds(total, length)
    whole, a, b = bounds[0], F.col("begin"), F.col("begin") + F.col("tokens")
    none = F.array().cast("array<bigint>")
    first, last = F.expr(f"(begin div {length} + 1) * {length}L"), F.expr(f"least(begin + tokens - 1, {whole}L) div {length} * {length}L")
    inner = F.when(first <= last, F.sequence(first, last, F.lit(length).cast("long"))).otherwise(none)
    tail = F.array(*[F.lit(x).cast("long") for x in bounds[1:]]) if bounds[1:] else none
    cuts = F.concat(inner, F.filter(tail, lambda x: (x > a) & (x < b)))
    at = placed.withColumn("__cuts", cuts).withColumns({"__from": F.concat(F.array(a), "__cuts"), "__to": F.concat("__cuts", F.array(b))})
    part = lambda g, i: F.struct((g - a).alias("start"), (F.get("__to", i) - g).alias("length"), F.substring("ids", ((g - a) * 4 + 1).cast("int"), ((F.get("__to", i) - g) * 4).cast("int")).alias("ids"), g.alias("g"))
    kept = [c for c in placed.columns if c not in ("ids", "begin", "tokens")]
    each = at.select(*kept, F.col("tokens").alias("doc_tokens"), F.explode(F.transform("__from", part)).alias("p")).select(*kept, "doc_tokens", "p.*")
    # the number of the last bound at or before the piece, counted from the first, which ends the whole sequences
    later = F.size(F.filter(tail, lambda x: x <= F.col("g"))).cast("long")
    begun = F.when(F.col("g") < whole, F.expr(f"g div {length} * {length}L")).otherwise(F.get(F.array(*[F.lit(x).cast("long") for x in bounds]), later.cast("int")))
    ends = F.when(F.col("g") < whole, F.col("__begun") + length).otherwise(F.get(F.array(*[F.lit(x).cast("long") for x in [*bounds[1:], total]]), later.cast("int")))
    numbered = each.withColumn("__begun", begun).withColumn("sequence_id", F.when(F.col("g") < whole, F.expr(f"g div {length}")).otherwise(F.lit(whole // length) + later))
    return numbered.withColumns({"offset": F.col("g") - F.col("__begun"), "sequence_tokens": ends - F.col("__begun")}).drop("g", "__begun")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, targets: Mapping[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: doc_id, source, doc_tokens, start, length, ids (little-endian unsigned 32-bit numbers), sequence_id, offset and sequence_tokens.

    Every document is there whole, cut only where a sequence ends. Sequences are numbered from 0 in their order, are full but for the last ones, and have no padding. Null and empty texts
    are the ``end`` alone; repeated rows are documents each; ties go by the queue's hash; other columns are not read; an empty table gives an empty result. A long text goes through the tokenizer
    in parts of about 1 MB that end at white space; a single longer word is encoded whole by the library."""
    space = Workspace(docs.sparkSession, "packing")
    coded = space.write(encode_documents(docs, path, end, doc_id, text, source).withColumn("row", F.monotonically_increasing_id()), "tokens", compression="zstd")
    narrow = coded.select("row", "doc_id", "source", "digest", "tokens")
    placed = space.write(place(narrow, length, targets), "places")
    total = narrow.agg(F.sum("tokens")).first()[0] or 0
    return cut_pieces(coded.join(placed, "row").drop("row", "digest"), total, length)
