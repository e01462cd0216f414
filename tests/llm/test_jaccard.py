from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from util import awkward, crowded, empty, lower, words

from flowsieve.llm import components, jaccard
from flowsieve.llm.workspace import Workspace


def shingles(text, width=5):
    w = words(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    common = Counter(p for docs in by.values() for p in combinations(docs, 2))
    for (i, j), n in common.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 10**9), d if d is not None else 10**9)
    return sorted(((d, len(s), d if not s else None if low[find(i)] == 10**9 else low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def families(spark, seed):
    """Large families of edited copies around the threshold, with a passage that all documents share."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(500)]
    shared = " ".join(rng.choice(vocab, 40))
    rows = []
    for family in range(6):
        base = list(rng.choice(vocab, int(rng.integers(20, 160))))
        for _ in range(int(rng.integers(5, 60))):
            text = list(base)
            for _ in range(int(rng.integers(0, 6))):
                text[int(rng.integers(len(text)))] = f"e{int(rng.integers(60))}"
            rows.append((len(rows), " ".join(text) + (f" {shared}" if family % 2 else "")))
    rows += [(len(rows) + i, " ".join(rng.choice(vocab[:6], int(rng.integers(1, 9))))) for i in range(60)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = families(spark, seed)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_awkward_rows(spark):
    docs = crowded(awkward(spark))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    left = jaccard.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = [tuple(r) for r in left.select("doc_id", "text").collect()]
    worded = [r for r in kept if words(r[1])]
    groups = jaccard.near_duplicates(docs).filter("n_shingles > 0").select("component_id", "first_th").distinct().collect()
    assert len(worded) == len(groups) and len(kept) - len(worded) == sum(not words(t) for _, t in rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, 300, replace=False)) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        bits = np.bitwise_count((jaccard.parity_bits(a) ^ jaccard.parity_bits(b)).view(np.uint64)).sum()
        assert bits <= apart


def test_every_similar_pair_shares_a_key():
    rng, bands = np.random.default_rng(7), jaccard.Bands(80)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        extra = int(rng.integers(0, max(1, len(a) // 5) + 1))
        b = np.union1d(rng.choice(a, len(a) - int(rng.integers(0, extra + 1)), replace=False), rng.integers(0, 2**63, int(rng.integers(0, extra + 1))).astype(np.uint64))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
            keys = [{k for band in (bands.of(len(s)), bands.of(len(s)) + 1) for k in jaccard.cell_keys(s, np.ones(len(s), np.int32), band, *bands.scheme(band)).tolist()} for s in (a, b)]
            assert keys[0] & keys[1]


def test_a_set_takes_no_more_keys_than_its_own_differences():
    """Similar pairs of any sizes and any number of differences still share a key; all keys of a set are under half its shingles, and a few."""
    rng, bands = np.random.default_rng(9), jaccard.Bands(80)
    keys = lambda s: [k for scheme in bands.schemes(len(s)) for k in jaccard.cell_keys(s, np.ones(len(s), np.int32), *scheme).tolist()]
    for n in [*range(1, 60), *rng.integers(60, 900, 60).tolist()]:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert len(keys(a)) <= 0.48 * n + 4
        for lost in {0, n // 9, *rng.integers(0, n // 5 + 1, 3).tolist()}:  # most additions that n - lost shingles in common allow
            b = np.union1d(rng.choice(a, n - lost, replace=False), rng.integers(0, 2**63, (n - lost) * 100 // 80 - n).astype(np.uint64)) if (n - lost) * 100 >= 80 * n else a
            common = len(np.intersect1d(a, b))
            assert 100 * common >= 80 * (len(a) + len(b) - common)
            assert {*keys(a)} & {*keys(b)}


def test_packed_keys_do_not_grow_with_buckets():
    """Bytes of the keys of the same texts, dealt to few and to many buckets."""
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 600)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(range(300), pa.int64()), pa.array(texts)], ["__id", "__th", "__text"])

    class common:
        value = np.zeros(0, np.uint64)

    def size(buckets):
        rows = [r for b in jaccard._sketcher(80, 5, list(range(buckets)), common)(iter([batch])) for r in b.to_pylist() if r["kind"] == 1]
        assert sum(len(r["keys"]) for r in rows) // 6 <= 300 * (0.48 * 600 + 4)
        return sum(len(r[c]) for r in rows for c in ("keys", "sets", "ranks"))

    assert size(51) < 1.1 * size(12)
    assert [jaccard.parts_of(n) for n in (1, 12, 51, 3000)] == [16, 16, 5, 4]


def test_rows_that_repeat_give_one_set(spark):
    """A document there many times, with a near copy: its set is read once, and the result has a row for each."""
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(5, near)] * 40 + [(3, near + " x"), (9, "another text of six words")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_repeated_rows_without_words_stay(spark):
    rows = [(1, "", "a"), (1, "", "b"), (None, None, "c"), (None, None, "d"), (2, " \n", "e"), (2, " \n", "f"), (3, "one two three", "g"), (3, "one two three", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = sorted(r["source"] for r in jaccard.drop_near_duplicates(docs).collect())
    assert left[:6] == list("abcdef") and len(left) == 7


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {x: find(x) for x in up}


def test_empty(spark):
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    assert jaccard.drop_near_duplicates(empty(spark).withColumn("z", F.lit(1))).count() == 0


def test_rival_clusters_in_one_group(spark):
    """Two clusters of near copies that share a passage, so that they meet under one key, and a third that links them in part."""
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(4000)]
    shared, rows = list(rng.choice(vocab, 60)), []
    bases = [list(rng.choice(vocab, 240)) for _ in range(2)]
    for n, base in enumerate(bases):
        for _ in range(150):
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[int(rng.integers(len(text)))] = f"e{int(rng.integers(9999))}"
            rows.append((len(rows), " ".join(text + shared)))
    step = max(1, jaccard.BLOCK_SHINGLES)
    try:
        jaccard.BLOCK_SHINGLES = 20_000  # several blocks a side
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        jaccard.BLOCK_SHINGLES = step
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def block(members):
    table = {"a": [0] * len(members), "mark": [m[0] for m in members], "component": [m[1] for m in members], "shingles": [m[2].tobytes() for m in members], "side": [m[3] for m in members]}
    return jaccard._block_links(80)(pa.table(table))


def test_a_block_returns_no_more_links_than_members():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.union1d(np.delete(base, rng.integers(len(base), size=3)), rng.integers(0, 2**63, 3).astype(np.uint64)) for _ in range(900)]
    members = [(i, i, s, 0) for i, s in enumerate(sets)] + [(i, i, s, 1) for i, s in enumerate(sets)]
    links = block(members)
    assert len(links) == 899  # one component of all, and no more
    far = [(i, i, np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)), i % 2) for i in range(50)]
    assert len(block(far)) == 0


def test_keys_of_a_part_are_joined_in_shares():
    rng = np.random.default_rng(6)
    keys, marks = rng.integers(0, 2**47, 4000).astype(np.uint64) * np.uint64(jaccard.PARTS), np.arange(8000)
    keys = np.concatenate([keys, keys])
    packed = keys.view(np.uint8).reshape(-1, 8)[:, :6]
    held = [(packed.tobytes(), marks.astype(np.int64).tobytes(), np.ones(8000, np.uint32).tobytes(), np.zeros(8000, np.uint16).tobytes())]
    most = jaccard.HELD_KEYS
    try:
        jaccard.HELD_KEYS = 1000
        got = {(a, b) for r in jaccard._part_pairs(held) for a, b in zip(r["a"].to_pylist(), r["b"].to_pylist(), strict=True)}
    finally:
        jaccard.HELD_KEYS = most
    low = keys & np.uint64((1 << 48) - 1)
    by = {}
    for k, m in zip(low.tolist(), marks.tolist(), strict=True):
        by.setdefault(k, []).append(m)
    assert got == {(x, y) for g in by.values() for x, y in combinations(g, 2)}
