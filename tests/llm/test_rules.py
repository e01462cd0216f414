from collections import Counter

import numpy as np
from util import SMALL, awkward, crowded, empty, words

from flowsieve.llm import rules


def brute(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(spark):
    docs = awkward(spark)
    got = rules.text_stats(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r["doc_id"], *brute(r["text"])) for r in docs.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_verdicts(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = crowded(awkward(spark))
    got = {r["doc_id"]: r for r in rules.judge(docs, labels).collect()}
    for k, r in got.items():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"]), k
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [got[k]["kept"] for k, q in known.items() if q == 1 and not got[k]["base_failed"]]
    assert np.mean(good) > 0.95
    learned = rules.learn_from(docs, labels)
    kept = rules.keep_good(awkward(spark), learned)
    assert kept.columns == awkward(spark).columns and kept.count() == sum(r["kept"] for r in rules.judge(awkward(spark), labels).collect())


def test_list_is_learned_and_pruned():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["a"] < 0.05)
    got = rules.learn_list(x, bad, rng.random(3000) < 0.33)
    hit = np.zeros(3000, bool)
    for r in got:
        hit |= rules.covers(r, x, 3000)
    assert (hit == bad).mean() > 0.98 and len(got) <= 4
    assert rules.learn_list(x, np.zeros(3000, bool), x["a"] < 0.3) == []


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.judge(empty(spark), labels).count() == 0
    assert rules.judge(awkward(spark), labels).filter("kept = base_failed").count() == 0
