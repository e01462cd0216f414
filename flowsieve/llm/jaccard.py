"""Exact similarity join on sets of word shingles by parity sketches.

Sets of a and b shingles with |A n B| >= p |A u B| differ in at most (a + b)(1 - p) / (1 + p) shingles. Sizes fall
into bands whose ends have the ratio p, so similar sets share a band or are neighbours; each set is sketched for
its own band and the next. For a band that allows t differences, shingles are dealt by hash over P > t cells, and
each cell is the XOR of its shingles' hashes: the number of cells that differ is at most the number of shingles
that differ, so at least P - t cells agree. Of two sets of P cells that agree in P - t, the first t + 1 in any one
order of all possible cells meet. The order depends on a cell's content alone: cells with many shingles that are not
common come first (the most telling), cells of common passages and empty ones last; only those t + 1 cells are join
keys. A set's own t is what it and its largest possible partner in a scheme may differ in, as each of two sets finds their first common cell among as many of
its own cells as differ, and one more. Which shingles are common is learned from a bounded sample; it decides how fast the join is, never what it finds. Candidates then face the Hamming distance of 1024-bit parity sketches, which
is at most the number of differing shingles as well, and at last the sets themselves. Every step but the last
only rules out pairs that cannot be similar, so no link is lost.

Equal sets meet as one class before any join. Keys are packed per map task, bucket and part (fewer parts with more buckets: a class is named once in each that it has keys in), and joined with numpy by
sorting, one part at a time and at most about ``HELD_KEYS`` unpacked keys at a time. In a group of more than ``PAIRED`` classes
with one key, each is first held against the most central one, that with the smallest share of uncommon shingles (``late`` below).
Members that turn out not to be in its component are then held against all that met the same central class, in blocks of bounded
shingles that carry the sets themselves: a block verifies pairs of different components only, joins components as it finds links and
returns no more links than it has members, so no step ever emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .components import components
from .workspace import Workspace, arrow_map, even_buckets, files_for, salted_join, shuffle_width

WIDTH = 5
PAIRED = 8
#: Keys that a map task gathers before it writes them out; parts of a bucket, joined one after the other, at most and at least; parts of all buckets between those; keys unpacked at once.
FLUSH_KEYS, PARTS, LEAST_PARTS, CELLS, HELD_KEYS = 1 << 19, 16, 4, 256, 1 << 20
#: Shingles on either side of a block; least and most bits of the map of wanted texts, as powers of two.
BLOCK_SHINGLES, LEAST_BITS, MOST_BITS = 1 << 20, 22, 25
SKETCH_WORDS = 16
_U = tn.U64


def differences(total: int, percent: int) -> int:
    """Shingles that two sets of ``total`` shingles together may differ in at most."""
    return total * (100 - percent) // (100 + percent)


class Bands:
    """Bands of set sizes: [low, high] with low / high about the threshold; bands are numbered from 0."""

    def __init__(self, percent: int):
        self.percent, self.highs = percent, []

    def of(self, n: int) -> int:
        while not self.highs or self.highs[-1] < n:
            low = (self.highs[-1] if self.highs else 0) + 1
            self.highs.append(low * 100 // self.percent)
        return int(np.searchsorted(self.highs, n))

    def scheme(self, band: int) -> tuple[int, int]:
        """Differences t allowed between a band and the one below, or within the one below, and the number of cells."""
        while len(self.highs) <= band:
            self.of(self.highs[-1] + 1 if self.highs else 1)
        t = differences(self.highs[band] + (self.highs[band - 1] if band else 0), self.percent)
        return t, t + 1 + (t > 0) * (2 + t // 4)

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """Schemes by which a set of n shingles meets all that are similar: band, differences t from any of them at most, and the number of cells.

        Sets of its own band and the next meet it by the next band's, those of the band below by its own."""
        band = self.of(n)
        found = [(band + 1, differences(n + n * 100 // self.percent, self.percent), self.scheme(band + 1)[1])]
        below = self.highs[band - 1] if band else 0
        if 100 * below >= self.percent * n:
            found.append((band, differences(n + below, self.percent), self.scheme(band)[1]))
        return found


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text: runs of ``width`` words, A-Z lower-cased; a text of fewer words is one run."""
    for chunk in tn.string_chunks(column):
        starts, ends, of_doc = chunk.words()
        words = tn.span_hashes(chunk.data, starts, ends, tn.LOWER)
        del starts, ends
        runs = tn.window_hashes(words, width)
        short = {int(i): tn.window_hashes(words[of_doc[i] : of_doc[i + 1]], int(of_doc[i + 1] - of_doc[i])) for i in np.flatnonzero((np.diff(of_doc) > 0) & (np.diff(of_doc) < width))}
        del words
        for i in range(chunk.n):
            a, b = int(of_doc[i]), int(of_doc[i + 1])
            if b - a >= width:
                own = runs[a : b - width + 1]
                own.sort()
                yield chunk.first + i, own[np.append(True, own[1:] != own[:-1])]
            elif b > a:
                yield chunk.first + i, short[i] ^ _U(b - a)
            else:
                yield chunk.first + i, np.zeros(0, _U)


def set_mark(shingles: np.ndarray) -> int:
    """64-bit class id of a set, as a signed number."""
    return int(tn.mix64(np.add.reduce(tn.mix64(shingles ^ _U(0x5851F42D4C957F2D)), keepdims=True) + _U(len(shingles))).view(np.int64)[0])


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Parity sketch: each shingle flips one of the bits."""
    odd = np.bincount((shingles >> _U(64 - 10)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def cell_keys(shingles: np.ndarray, rare: np.ndarray, band: int, t: int, cells: int) -> np.ndarray:
    """The first t + 1 cells of a set in the common order, as 64-bit keys. ``rare``: 1 for shingles that are not common."""
    cell = ((shingles >> _U(32)) * _U(cells)) >> _U(32)
    order = np.argsort(cell.astype(np.uint16) if cells < 65536 else cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    count = np.diff(np.append(first, len(cell)))
    keys = tn.mix64(np.bitwise_xor.reduceat(shingles[order], first) ^ tn.mix64(cell[first] * _U(1 << 20) + _U(band)) ^ (count.astype(_U) << _U(40)))
    if len(keys) > t + 1:
        return keys[np.lexsort((keys, -count, -np.add.reduceat(rare[order], first)))[: t + 1]]
    if len(keys) < t + 1:
        empty = np.setdiff1d(np.arange(cells, dtype=_U), cell[first])
        none = np.sort(tn.mix64(tn.mix64(empty * _U(1 << 20) + _U(band))))
        keys = np.concatenate([keys, none[: t + 1 - len(keys)]])
    return keys


#: kind 0: a document; 1: packed keys of a bucket, later a candidate pair of classes.
_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
    ("bits", pa.list_(pa.int64())), ("keys", pa.binary()), ("sets", pa.binary()), ("runs", pa.binary()), ("ranks", pa.binary()),
])
_DDL = "kind int, bucket int, part int, doc_id long, th long, n long, a long, b long, bits array<long>, keys binary, sets binary, runs binary, ranks binary"


def _rows(length: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in _SCHEMA], schema=_SCHEMA)


def common_shingles(docs: DataFrame, width: int, docs_sampled: int = 4000, least_docs: int = 4, most: int = 1 << 16) -> np.ndarray:
    """Sorted hashes of at most ``most`` shingles that at least ``least_docs`` of ``docs_sampled`` documents hold (those with the lowest text hashes)."""
    chosen = docs.select("__th").distinct().orderBy("__th").limit(docs_sampled)
    texts = docs.join(F.broadcast(chosen), "__th", "left_semi").dropDuplicates(["__th"]).select("__text")  # at most docs_sampled hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    counted = arrow_map(texts, run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs)
    top = counted.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()["h"].to_numpy()
    return np.sort(top.view(_U))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def parts_of(buckets: int) -> int:
    """Parts of each bucket: a class is named once in each part that it has keys in, and a row is written for each part that a flush has keys in."""
    return min(PARTS, max(LEAST_PARTS, CELLS // buckets))


def _sketcher(percent: int, width: int, codes: list[int], common):
    buckets, numbers = len(codes), np.array(codes, np.int32)
    parts = parts_of(buckets)

    def flush(keys: list, marks: list, ranks: list) -> pa.RecordBatch:
        sizes = np.array([len(k) for k in keys])
        key, doc = np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes)
        mark, rank = np.array(marks, np.int64), np.array(ranks, np.uint16)
        bucket = (key % _U(buckets)).astype(np.int64)
        key = key >> _U(16)
        cell = bucket * parts + (key % _U(parts)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        key, doc, cell = key[order], doc[order], cell[order]
        low = key.view(np.uint8).reshape(-1, 8)[:, :6]
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out = {"kind": [], "bucket": [], "part": [], "keys": [], "sets": [], "runs": [], "ranks": []}
        for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
            run = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
            out["kind"].append(1)
            out["bucket"].append(int(numbers[cell[a] // parts]))
            out["part"].append(int(cell[a] % parts))
            out["keys"].append(low[a:b].tobytes())
            out["sets"].append(mark[doc[a:b][run]].tobytes())
            out["ranks"].append(rank[doc[a:b][run]].tobytes())
            out["runs"].append(np.diff(np.append(run, b - a)).astype(np.uint32).tobytes())
        return _rows(len(out["kind"]), **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        keys: list[np.ndarray] = []
        marks: list[int] = []
        ranks: list[int] = []
        held = 0
        for batch in batches:
            ns, own, bits = [], [], []
            for _, s in shingle_sets(batch.column(2), width):
                mark = set_mark(s)
                ns.append(len(s))
                own.append(mark)
                bits.append(parity_bits(s))
                if not len(s) or mark in seen:
                    continue  # its class has spoken in this flush
                seen.add(mark)
                rare = (~_among(s, common.value)).astype(np.int32)
                mine = np.concatenate([cell_keys(s, rare, *scheme) for scheme in bands.schemes(len(s))])
                keys.append(mine)
                marks.append(mark)
                ranks.append(int(rare.sum()) * 65535 // len(s))
                held += len(mine)
                if held >= FLUSH_KEYS:
                    yield flush(keys, marks, ranks)
                    keys, marks, ranks, held = [], [], [], 0
                    seen = set()
            if ns:
                place = np.asarray(batch.column(0).fill_null(0)).astype(np.int64) ^ np.asarray(batch.column(1))  # copies of one text go apart
                spots = numbers[(tn.mix64(place.view(_U)) % _U(buckets)).astype(np.int32)]
                yield _rows(len(ns), kind=np.zeros(len(ns), np.int32), bucket=spots, part=np.full(len(ns), -1, np.int32), doc_id=batch.column(0), th=batch.column(1), n=ns, a=own, bits=bits)
        if keys:
            yield flush(keys, marks, ranks)

    return run


def group_pairs(key: np.ndarray, mark: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of keyed classes: a, b and whether the pair came from a large group. a is before b by (rank, mark)."""
    order = np.argsort(key)
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # keys of one class alone go at once
    key, mark, rank = key[order], mark[order], rank[order]
    order = np.lexsort((mark, rank, key))
    key, mark = key[order], mark[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])[: len(key)]
    key, mark = key[new], mark[new]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    sizes = np.diff(np.append(cuts, len(key)))
    a, b, late = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= PAIRED)]):
        at = cuts[sizes == size]
        for i, j in combinations(range(size), 2):
            a.append(mark[at + i])
            b.append(mark[at + j])
            late.append(np.zeros(len(at), bool))
    for at, size in zip(cuts[sizes > PAIRED], sizes[sizes > PAIRED], strict=True):
        b.append(mark[at + 1 : at + size])
        a.append(np.full(size - 1, mark[at]))
        late.append(np.ones(size - 1, bool))
    a, b, late = np.concatenate(a), np.concatenate(b), np.concatenate(late)
    order = np.lexsort((late, b, a))
    a, b, late = a[order], b[order], late[order]
    last = np.concatenate([(a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]])[: len(a)]  # the one from a large group, if any
    return a[last], b[last], late[last]


def _unpacked(held: list[tuple[bytes, bytes, bytes, bytes]], share: int, shares: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, marks and ranks of packed rows whose keys fall into a share of all."""
    keys, marks, ranks = [], [], []
    for packed, sets, runs, rank in held:
        low = np.frombuffer(packed, np.uint8).reshape(-1, 6)
        full = np.zeros((len(low), 8), np.uint8)
        full[:, :6] = low
        key, runs = full.view(_U).ravel(), np.frombuffer(runs, np.uint32)
        mark, own = np.repeat(np.frombuffer(sets, np.int64), runs), np.repeat(np.frombuffer(rank, np.uint16), runs)
        if shares > 1:
            mine = (key // _U(PARTS)) % _U(shares) == _U(share)
            key, mark, own = key[mine], mark[mine], own[mine]
        keys.append(key)
        marks.append(mark)
        ranks.append(own)
    return np.concatenate(keys), np.concatenate(marks), np.concatenate(ranks)


def _part_pairs(held: list[tuple[bytes, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Candidates of one part of a bucket; only a share of its keys is unpacked at a time."""
    shares = -(-sum(len(h[0]) // 6 for h in held) // HELD_KEYS)
    for share in range(shares):
        a, b, late = group_pairs(*_unpacked(held, share, shares))
        for i in range(0, len(a), 50_000):
            to = slice(i, i + 50_000)
            n = len(a[to])
            yield _rows(n, kind=np.ones(n, np.int32), a=a[to], b=b[to], n=late[to].astype(np.int64))


def _join_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, part): documents pass, the packed keys of a part become its candidates."""
    at, held = None, []
    for batch in batches:
        kind = np.asarray(batch.column(0))
        if (kind == 0).any():
            yield batch.filter(pa.array(kind == 0))
        for i in np.flatnonzero(kind == 1):
            here = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            if here != at and held:
                yield from _part_pairs(held)
                held = []
            at = here
            held.append(tuple(batch.column(c)[i].as_py() for c in (9, 10, 11, 12)))
    if held:
        yield from _part_pairs(held)


def _sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    table = lambda: pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(sets, pa.binary())], ["mark", "shingles"])
    for batch in batches:
        marks, sets, held = [], [], 0
        for _, s in shingle_sets(batch.column(0), width):
            marks.append(set_mark(s))
            sets.append(s.tobytes())
            held += len(s)
            if held >= BLOCK_SHINGLES // 4:
                yield table()
                marks, sets, held = [], [], 0
        if sets:
            yield table()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [len(np.intersect1d(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), assume_unique=True)) for x, y in zip(batch.column(3), batch.column(4), strict=True)]
        sizes = [[v.as_buffer().size // 8 for v in batch.column(c)] for c in (3, 4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.int64()), *[pa.array(x, pa.int64()) for x in sizes]], ["a", "b", "late", "common", "na", "nb"])


def _hamming(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)


def map_bits(wanted: int) -> int:
    """Bits of the map, as a power of two: sixteen or more a wanted text while the map may grow."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * wanted - 1).bit_length()))


def class_sets(wanted: DataFrame, most: int, docs: DataFrame, space: Workspace, width: int, tag: str) -> DataFrame:
    """(mark, shingles) of the classes ``wanted`` (id, th of the text to read; at most ``most``). Texts that no class wants stay where they are: a map
    rules them out before the shuffle; the exact join follows. The map grows with the wanted texts up to 2^MOST_BITS bits (2^(MOST_BITS - 6) rows); with many
    more wanted texts than that it lets most pass, which costs a shuffle of their texts and changes no result."""
    wanted = space.write(wanted.distinct(), f"wanted{tag}", files_for(most))
    n = wanted.count()
    bits = map_bits(n)
    spot = lambda i, t: F.pmod(F.xxhash64(i, t), F.lit(1 << bits))
    marked = wanted.select(spot("id", "th").alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m"))
    there = docs.withColumn("s", spot("__id", "__th")).withColumn("w", F.expr("cast(s div 64 as int)")).join(F.broadcast(marked), "w").filter("getbit(m, cast(s % 64 as int)) = 1")
    texts = there.join(wanted.withColumnRenamed("th", "wth"), there["__id"].eqNullSafe(F.col("id")) & (there["__th"] == F.col("wth")), "left_semi").select("__text")
    sets = arrow_map(texts, lambda it: _sets_of(it, width), "mark long, shingles binary")
    sets = space.write(sets, f"sets{tag}")
    if sets.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return sets
    single = space.write(sets.groupBy("mark").agg(F.first("shingles").alias("shingles")), f"single{tag}")  # the same id and text more than once
    space.drop(f"sets{tag}")
    return single


def verified_links(pairs: DataFrame, n_pairs: int, classes: DataFrame, docs: DataFrame, space: Workspace, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, late) among ``pairs``, and the pairs that are none (a, b, late): sketches first, then the sets of the classes that are left, read again from their texts."""
    side = lambda s: classes.select(F.col("mark").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}"), F.col("at").alias(f"at{s}"))
    near = salted_join(pairs, side("a"), "a", "b", n_pairs).join(side("b"), "b").withColumn("most", F.expr(f"((na + nb) * {100 - percent}) div {100 + percent}"))
    near = near.withColumn("maybe", (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_hamming(F.col("bitsa"), F.col("bitsb")) <= F.col("most")))
    near = space.write(near.select("a", "b", "late", "maybe", "ata", "atb"), "near")
    maybe = near.filter("maybe")
    wanted = maybe.select("ata.id", "ata.th").unionByName(maybe.select("atb.id", "atb.th"))
    sets = class_sets(wanted, 2 * n_pairs, docs, space, width, "1")
    full = maybe.select("a", "b", "late").join(sets.select(F.col("mark").alias("b"), F.col("shingles").alias("y")), "b")
    full = salted_join(full, sets.select(F.col("mark").alias("a"), F.col("shingles").alias("x")), "a", "b", n_pairs, counted=maybe).select("a", "b", "late", "x", "y")
    known = arrow_map(full, _common, "a long, b long, late boolean, common long, na long, nb long")
    found = known.select("a", "b", "late", (100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).alias("linked"))
    held = space.write(found, "held")  # a task verifies what one shuffle partition of sets holds, which Spark sizes by bytes
    for table in ("sets1", "single1"):
        space.drop(table)
    return held.filter("linked").drop("linked"), near.filter("not maybe").select("a", "b", "late").unionByName(held.filter("not linked").drop("linked"))


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, mark, own = (table[c].to_numpy() for c in ("side", "mark", "component"))
        sets = [np.frombuffer(s.as_buffer(), _U) for s in table["shingles"].combine_chunks()] if len(table) else []
        n = np.array([len(s) for s in sets], np.int64)
        bits = np.stack([parity_bits(s).view(_U) for s in sets]) if sets else np.zeros((0, SKETCH_WORDS), _U)
        root = np.unique(own, return_inverse=True)[1]  # the component of each row, as links are found
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        xb, xn, a, b = bits[x], n[x], [], []
        for j in y:
            apart = np.bitwise_count(xb ^ bits[j]).sum(axis=1, dtype=np.int64)
            fits = (apart * (100 + percent) <= (xn + n[j]) * (100 - percent)) & (100 * np.minimum(xn, n[j]) >= percent * np.maximum(xn, n[j])) & (root[x] != root[j])
            for i in x[fits][np.argsort(apart[fits], kind="stable")]:
                if root[i] != root[j]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (n[i] + n[j] - common):
                        root[root == root[i]] = root[j]
                        a.append(mark[i])
                        b.append(mark[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def second_look(met: DataFrame, classes: DataFrame, docs: DataFrame, space: Workspace, percent: int, width: int) -> DataFrame:
    """Links (a, b) between members that failed their central class (``odd``) and all that met the same one, where components differ.

    ``met``: a (the central class), mark, component, odd. Sides are cut into blocks of about BLOCK_SHINGLES shingles, so no task holds a whole group."""
    n = met.count()
    sized = met.join(classes.select("mark", "n", "at"), "mark")
    blocks = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / BLOCK_SHINGLES).cast("int")
    size = sized.groupBy("a").agg(blocks(F.sum("n")).alias("xs"), blocks(F.sum(F.when(F.col("odd"), F.col("n")))).alias("ys")).filter("ys > 0")
    groups = space.write(salted_join(met, size, "a", "mark", n), "groups", files_for(n))
    sets = class_sets(groups.join(classes, "mark", "left_semi").select("mark").distinct().join(classes, "mark").select("at.id", "at.th"), n, docs, space, width, "2")
    rows = groups.join(sets, "mark")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("mark"), F.col(n)).cast("int")
    kept = ["a", "mark", "component", "shingles"]
    sides = rows.select(*kept, other("ys").alias("y"), own("xs").alias("x"), F.lit(0).alias("side")).unionByName(rows.filter("odd").select(*kept, own("ys").alias("y"), other("xs").alias("x"), F.lit(1).alias("side")))
    return space.write(sides.groupBy("a", "y", "x").applyInArrow(_block_links(percent), "a long, b long").distinct(), "second", files_for(n))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, __th (hash of its text), n_shingles, class_mark (equal sets), component_id, first_th and __copies
    (rows with its set).

    component_id is the lowest doc_id that links reach, itself included; documents without words link with nothing
    and keep their own id. Null texts are empty. Null ids count as the highest: they never name a component that has another id.
    Repeated rows are documents with equal sets. (component_id, first_th) names the row to keep of each component. Other columns
    are not read. An empty table gives an empty result."""
    space = Workspace(docs.sparkSession, "jaccard")
    bare = docs.select(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__th"), F.col(text).alias("__text"))
    buckets = shuffle_width(docs.sparkSession)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(bare, width))
    packed = arrow_map(bare, _sketcher(percent, width, even_buckets(docs.sparkSession, buckets), common), _DDL).repartition(buckets, "bucket").sortWithinPartitions("bucket", "part")
    table = space.write(arrow_map(packed, _join_buckets, _DDL), "joined")
    counts = dict(table.groupBy("kind").count().collect())  # two rows
    n_docs, n_pairs = counts.get(0, 0), counts.get(1, 0)
    rows = table.filter("kind = 0").select("doc_id", "th", "n", F.col("a").alias("mark"), "bits")
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")
    grouped = rows.filter("n > 0").groupBy("mark").agg(F.min(at).alias("at"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies"))
    classes = space.write(grouped, "classes", files_for(n_docs))
    pairs = table.filter("kind = 1").groupBy("a", "b").agg(F.max(F.col("n") > 0).alias("late"))
    pairs = space.write(pairs, "pairs", files_for(n_pairs))
    links, failed = verified_links(pairs, n_pairs, classes, bare, space, percent, width)
    comps = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), space, "one")
    label = lambda name: comps.select(F.col("id").alias(name), F.col("component").alias(f"c{name}"))
    late = failed.withColumn("odd", F.lit(True)).unionByName(links.withColumn("odd", F.lit(False))).filter("late")
    late = salted_join(late, label("a"), "a", "b", n_pairs, how="left").join(label("b"), "b", "left")
    met = late.select("a", F.col("b").alias("mark"), F.coalesce("cb", "b").alias("component"), (F.col("odd") & (F.coalesce("ca", "a") != F.coalesce("cb", "b"))).alias("odd"))
    met = space.write(met, "met", files_for(n_pairs))
    if not met.filter("odd").isEmpty():
        again = second_look(met, classes, bare, space, percent, width)
        if not again.isEmpty():
            every = comps.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(again.select(F.col("a").alias("u"), F.col("b").alias("v")))
            comps = components(every, space, "two")
    of_class = classes.join(comps.select(F.col("id").alias("mark"), "component"), "mark", "left").select("mark", "at", "copies", F.coalesce("component", "mark").alias("component"))
    of_class = space.write(of_class, "named", files_for(n_docs))
    firsts = of_class.groupBy("component").agg(F.min("at").alias("first"))
    named = salted_join(of_class, firsts, "component", "mark", n_docs).select("mark", "first", "copies")
    worded = salted_join(rows.filter("n > 0"), named, "mark", "doc_id", n_docs)
    result = lambda df, id, th, copies: df.select(
        F.col("doc_id").alias(doc_id), F.col("th").alias("__th"), F.col("n").alias("n_shingles"), F.col("mark").alias("class_mark"), id.alias("component_id"), th.alias("first_th"), copies.alias("__copies")
    )
    every = result(worded, F.col("first.id"), F.col("first.th"), F.col("copies")).unionByName(result(rows.filter("n = 0"), F.col("doc_id"), F.col("th"), F.lit(1).cast("long")))
    return every.coalesce(files_for(n_docs, 1 << 14))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the lowest id; documents without words all stay.

    Only texts that may go, or may be there twice, are shuffled: a map (see ``class_sets``) rules the others out."""
    found = near_duplicates(docs, percent, width, doc_id, text)
    space = Workspace(docs.sparkSession, "kept")
    stays = F.col(doc_id).eqNullSafe(F.col("component_id")) & (F.col("__th") == F.col("first_th"))
    # of rows that stay only those with copies may be there twice
    touched = found.filter("n_shingles > 0").filter(~stays | (F.col("__copies") > 1)).groupBy(F.col(doc_id).alias("__kid"), F.col("__th").alias("__kth")).agg(F.max(stays).alias("__stays"), F.count(F.lit(1)).alias("__rows"))
    touched = space.write(touched.filter("not __stays or __rows > 1"), "touched", max(1, shuffle_width(docs.sparkSession) // 8))
    bits = map_bits(touched.count())
    spot = lambda i, t: F.pmod(F.xxhash64(i, t), F.lit(1 << bits))
    marked = touched.select(spot("__kid", "__kth").alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("__m"))
    rows = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("__s", spot(F.col(doc_id).cast("long"), F.col("__th"))).withColumn("__w", F.expr("cast(__s div 64 as int)"))
    rows = rows.join(F.broadcast(marked), "__w", "left").withColumn("__may", F.coalesce(F.getbit("__m", F.expr("cast(__s % 64 as int)")), F.lit(0)) == 1)
    may = rows.filter("__may")
    may = may.join(touched.hint("shuffle_hash"), may[doc_id].cast("long").eqNullSafe(F.col("__kid")) & (may["__th"] == F.col("__kth")), "left").filter("__stays is null or __stays")
    if not touched.filter("__stays").isEmpty():  # the same id and text more than once
        may = may.filter("__stays is null").unionByName(may.filter("__stays").dropDuplicates([doc_id, "__th"]))
    return rows.filter("not __may").select(*docs.columns).unionByName(may.select(*docs.columns))
