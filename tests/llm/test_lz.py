import hashlib

import numpy as np
from util import awkward, crowded, empty

from flowsieve.llm import lz


def phrases(data):
    seen, out, start = set(), [], 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            out.append(data[start:end])
            start = end
    return out + ([data[start:]] if start < len(data) else [])


def test_phrases_of_the_parse():
    for text in ("", "a", "aaaaaaa", "abababababab", "the cat sat on the mat, the cat sat", "é" * 9):
        data = text.encode()
        p = lz.Parse().feed(data)
        ends = [*p.ends, *([len(data)] if len(data) > (p.ends[-1] if p.ends else 0) else [])]
        assert [data[a:b] for a, b in zip([0, *ends], ends, strict=False)] == phrases(data)
        cut = len(data) // 3
        assert lz.Parse().feed(data[:cut]).fork().feed(data[cut:]).ends == p.ends


def test_query_against_brute_force(spark):
    docs = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in lz.edited_likeness(crowded(docs)).collect()}
    sign = lambda t: lz.Parse().feed(t.encode()).signature()
    for i, (d, t) in enumerate(rows):
        other, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), lz.fingerprint(sign(t)), lz.fingerprint(sign(edited)), lz.likeness(sign(t), sign(edited)), lz.likeness(sign(t), sign(other)))
        assert tuple(got[d])[1:] == want
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_likeness_follows_the_phrase_sets():
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n)).encode()
    a, b = text(2000), text(1500)
    both = a[: len(a) // 2] + b
    one, two = set(phrases(a)), set(phrases(both))
    true = len(one & two) / len(one | two)
    assert abs(lz.likeness(lz.Parse().feed(a).signature(1024), lz.Parse().feed(both).signature(1024), 1024) - true) < 0.06


def test_all_rows_and_fingerprints(spark):
    docs = awkward(spark)
    assert lz.edited_likeness(docs).count() == docs.count()
    prints = {(r["text"] or ""): set() for r in docs.collect()}
    from pyspark.sql import functions as F

    for r in lz.fingerprints(docs.withColumn("t", F.coalesce("text", F.lit("")))).collect():
        prints[r["t"]].add(r["fingerprint"])
    assert all(len(s) == 1 for s in prints.values()) and prints[""] == {""}
    assert lz.fingerprint_likeness("", "") == 1.0 and lz.fingerprint_likeness("00000001", "") == 0.0


def test_empty_and_single(spark):
    assert lz.edited_likeness(empty(spark)).count() == 0
    one = lz.edited_likeness(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"aba").hexdigest()
