import zlib
from collections import Counter, defaultdict

from util import awkward, crowded, empty

from flowsieve.llm import sharding


def test_law_slots_and_sums(spark):
    rows = sharding.shard_documents(crowded(awkward(spark)), [1.0] * 24).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = [r["text"] or "" for r in awkward(spark).select("text").collect()]
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len(t.encode()) + 8, zlib.crc32(t.encode())) for t in texts)
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_weights(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'' text")
    got = Counter(r["shard"] for r in sharding.shard_documents(ids, [1.0, 2.0, 5.0]).select("shard").collect())
    assert all(abs(got[i] / 20_000 - w / 8) < 0.02 for i, w in enumerate([1, 2, 5]))


def test_empty(spark):
    assert sharding.shard_documents(empty(spark), [1.0, 1.0]).count() == 0
