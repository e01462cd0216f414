import math
from collections import Counter, defaultdict

import numpy as np
from util import awkward, crowded, empty, words

from flowsieve.llm import mixing


def targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in stopped]
        share = (total - sum(stopped.values())) / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if weight[s] * share > cap * sizes[s]]
        if not over:
            return stopped | {s: weight[s] * share for s in left}
        stopped |= {s: cap * sizes[s] for s in over}


def test_plan(spark):
    docs = crowded(awkward(spark))
    rows = mixing.mix_plan(docs).collect()
    sizes = defaultdict(int)
    for r in docs.select("text", "source").collect():
        sizes[r["source"]] += len(words(r["text"]))
    want = targets(sizes)
    assert len(rows) == docs.count()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    near_targets(rows)
    through_the_tree(rows, 16)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_plan(docs.repartition(3)).collect()), key=repr)


def near_targets(rows, cap=3):
    """Each source is at its target to the percent, or to the shortest document that it could still take."""
    by = defaultdict(list)
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= cap * r["size"] and r["copies"] == len(r["shards"])
        by[r["source"]].append(r)
    for own in by.values():
        target, taken = own[0]["target"], sum(r["taken"] for r in own)
        free = min((r["size"] for r in own if r["size"] and r["copies"] < cap), default=0)
        assert abs(taken - target) <= max(target / 100, free)


def through_the_tree(rows, shards, seed=7):
    """Where each document is a block, a shard holds as many of each source and class (power of two of the size) as the tree's leaf does."""
    quotas, held = Counter(), Counter()
    for r in rows:
        kind = r["source"] is None, r["source"] or "", math.frexp(r["size"])[1]
        quotas[kind] += r["copies"] if r["size"] else 0
        for s in r["shards"]:
            held[s, kind] += 1
    kinds = sorted(k for k in {(r["source"] is None, r["source"] or "", math.frexp(r["size"])[1]) for r in rows if r["size"]})
    dealt = mixing.splitting_tree(np.array([quotas[k] for k in kinds]), shards, seed)
    assert [[held[s, k] for k in kinds] for s in range(shards)] == dealt.tolist()


def planned(spark, **sources):
    """Plan of sources' documents of so many words, as rows."""
    rows, at = [], 0
    for name, sizes in sources.items():
        rows += [(at + i, name, int(n)) for i, n in enumerate(sizes)]
        at += len(sizes) + 7
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int").selectExpr("doc_id", "source", "repeat('x ', n) text", "'en' lang")
    return mixing.mix_plan(docs).collect()


def test_sources_with_one_very_long_document(spark):
    for at in (0, 500, 1000):
        rows = planned(spark, a=[3000] * 36, b=[10] * at + [26_000] + [10] * (1000 - at), c=[300] * 200 + [60_000])
        near_targets(rows)
        through_the_tree(rows, 16)


def test_heavy_tailed_sizes(spark):
    rng = np.random.default_rng(11)
    for _ in range(3):
        rows = planned(spark, **{s: np.minimum(1 + rng.pareto(0.8, n) * 5, 30_000) for s, n in (("a", 400), ("b", 300), ("c", 900), ("d", 3))})
        near_targets(rows)
        if all(r["source_size"] <= 1 << 16 for r in rows):
            through_the_tree(rows, 16)


def test_partial_quotas():
    rng = np.random.default_rng(4)
    for _ in range(300):
        words = [rng.integers(1 << c, 2 << c, (int(rng.integers(1, 4)), int(rng.integers(1, 30)))) for c in sorted(rng.choice(14, int(rng.integers(1, 6)), replace=False))]
        rest = float(rng.random() * sum(int(w[0].sum()) for w in words))
        taken = mixing.partial_quotas(words, rest)
        left = [int(x) for w, k in zip(words, taken, strict=True) for x in w.ravel()[k:]]
        assert abs(rest - sum(int(w.ravel()[:k].sum()) for w, k in zip(words, taken, strict=True))) <= min(left, default=max(int(w.max()) for w in words))


def test_few_blocks_hold_many_documents(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "concat('s', id % 2) source", "repeat('x ', cast(1 + id % 7 as int)) text", "'en' lang")
    rows = mixing.mix_plan(docs, blocks=50).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= own[0]["source_size"] / 50 + 7
        assert len({tuple(r["shards"]) for r in own}) > 10


def test_mix_has_the_copies_of_the_plan(spark):
    docs = awkward(spark)
    plan = mixing.mix_plan(docs, shards=4, blocks=200)
    mixed = mixing.mix(docs, plan, shards=4, extra=True)
    got, want = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"], r["text"]] += 1
        assert 0 <= r["mix_shard"] < 4
    texts = {(r["doc_id"], r["size"]): r["copies"] for r in plan.collect()}
    assert sum(got.values()) == sum(r["copies"] for r in plan.collect())
    for (d, t), n in got.items():
        if d is not None and d < 100_000:
            want[d, t] = texts[d, len(words(t))]
            assert n == want[d, t]


def test_rows_of_one_id_and_text_keep_their_sources(spark):
    rows = [(i, "a b c d", s, lang) for i in range(40) for s, lang in (("s0", "en"), ("s0", "de"), ("s1", "en"), ("s2", "fr"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    plan = mixing.mix_plan(docs, shards=4, blocks=20)
    want, got = defaultdict(int), defaultdict(int)
    for r in plan.collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    mixed = [tuple(r) for r in mixing.mix(docs, plan, shards=4).collect()]
    for d, _, s, _ in mixed:
        got[d, s] += 1
    assert got == {k: n for k, n in want.items() if n}
    assert {r[3] for r in mixed if r[2] == "s0"} == {"en", "de"}
    assert sorted(mixed) == sorted(tuple(r) for r in mixing.mix(docs.repartition(3), plan, shards=4).collect())


def test_tree_keeps_quotas():
    quotas = np.array([1000, 7, 0, 333])
    dealt = mixing.splitting_tree(quotas, 7, 1)
    assert (dealt.sum(axis=0) == quotas).all() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3
    assert (dealt == mixing.splitting_tree(quotas, 7, 1)).all()
    share = np.mean([mixing.splitting_tree(quotas, 2, s)[0] for s in range(200)], axis=0)
    assert abs(share[3] - 166.5) < 2


def test_empty(spark):
    assert mixing.mix_plan(empty(spark)).count() == 0
    assert mixing.mix(empty(spark), mixing.mix_plan(empty(spark))).count() == 0
    only = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_plan(only).collect()] == [0, 0]


def test_draws_from_very_many_blocks():
    quotas = np.array([10**10, 3 * 10**9, 7, 0, 10**10, *[196_608] * 300], np.int64)
    out = mixing.splitting_tree(quotas, 6, 1)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 3
    assert (abs(out[:, 0] - 10**10 / 6) < 10 * (10**10 / 6) ** 0.5).all()
    many = mixing.splitting_tree(np.full(6000, 196_608), 4, 2)  # sources of full size, beyond a thousand million blocks in all
    assert (many.sum(axis=0) == 196_608).all() and abs(many - 49_152).max() < 10 * 49_152**0.5


def test_draws_beyond_numpy_follow_its_law(monkeypatch):
    rng, cases = np.random.default_rng(3), [(50, 30, 20), (5, 1000, 600), (1000, 5, 999), (3, 4, 7), (9, 1, 0)]
    own = lambda *c: np.array([mixing._hypergeometric(rng, *c) for _ in range(4000)])
    numpys = [own(*c) for c in cases]
    monkeypatch.setattr(mixing, "NUMPY_MOST", 0)
    for (good, bad, sample), theirs in zip(cases, numpys, strict=True):
        drawn = own(good, bad, sample)
        assert drawn.min() >= max(0, sample - bad) and drawn.max() <= min(good, sample)
        assert abs(drawn.mean() - theirs.mean()) < 0.2 * max(0.5, theirs.std()) and abs(drawn.std() - theirs.std()) < 0.1 * max(1, theirs.std())
