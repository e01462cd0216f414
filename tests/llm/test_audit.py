from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from util import SMALL, awkward, crowded, empty, words

from flowsieve.llm import audit
from flowsieve.llm import textnum as tn
from flowsieve.llm.queries import op12_filter_audit

LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    """Letters that each row fails, one document after the other."""
    out = []
    for r in rows:
        text, ws = r["text"] or "", words(r["text"])
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = r["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == text for o in rows)
        out.append({k for k, v in fails.items() if v})
    return out


def brute(rows, labels):
    """Applies the filters in every order, document by document."""
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    fails, want = failures(rows), {}
    for part in {r["source"] or "" for r in rows}:
        own = [(r["doc_id"], f) for r, f in zip(rows, fails, strict=True) if (r["source"] or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone, gone_before = [d for d in left if letter in d[1]], [d for d in own if letter in d[1] and set(order[: step - 1]) & d[1]]
                left = [d for d in left if letter not in d[1]]
                shapley[letter] += len(gone)
                want[part, order, step] = [len(left), len(gone), len(gone_before), sum(d[1] == {letter} for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for key in want:
            if key[0] == part:
                want[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in want.items()}


def found(made):
    rows = [tuple(r) for r in made.collect()]
    got = {r[:3]: r[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_filtering_in_every_order(spark):
    docs = awkward(spark).filter("doc_id is null or doc_id < 60 or doc_id > 100000")
    more = [(200_001, "twice the same row", "en", None, 1), (200_002, "A# B", "en", "src0", 1), (None, "twice the same row", "en", "src0", 1), (200_003, "x " * 300, "en", "", 1), (200_004, "é" * 30 + "AB", None, "src2", 1)]
    docs = crowded(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame([(100_004, 1, None), (100_004, 0, 1), (None, 1, 1), (200_002, None, 1), (1, None, None)], "doc_id long, quality long, toxic long"))
    got = found(audit.interaction_audit(audit.document_failures(docs, labels)))
    assert got == brute(docs.collect(), labels.collect())


def test_query_over_the_table(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    made = op12_filter_audit(spark, SMALL)
    assert dict(made.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    assert found(made) == brute(docs.collect(), labels.collect())


def test_a_text_of_many_documents(spark):
    docs = spark.range(3000).select((F.lit(5000) - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("own "), "id")).otherwise("same words").alias("text"), F.lit("s").alias("source"))
    made = audit.interaction_audit(audit.document_failures(docs, spark.createDataFrame([], LABELS)))
    row = made.filter("filter_order = 'EABCD' and step = 1").first()
    assert (row["removed"], row["kept"], row["shapley"]) == (1999, 1001, 1999 * 60)  # each of them fails A as well


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit.interaction_audit(audit.document_failures(empty(spark), labels)).count() == 0
    one = found(audit.interaction_audit(audit.document_failures(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), labels)))
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_other_filters_and_no_labels(spark):
    marked = spark.createDataFrame([("p", m) for m in (0, 1, 1, 3, 2, 3, 0, 0)], "part string, mask int")
    got = found(audit.interaction_audit(marked, "XY", ()))
    assert got == {("p", "XY", 1): (4, 4, 0, 2, 6), ("p", "XY", 2): (3, 1, 2, 1, 4), ("p", "YX", 1): (5, 3, 0, 1, 4), ("p", "YX", 2): (3, 2, 2, 2, 6)}


def test_counts_of_masks_are_exact(spark):
    rng = np.random.default_rng(1)
    masks = [int(x) for x in rng.integers(0, 32, 5000)]
    sums = audit.parity_sums(spark.createDataFrame([("p", m) for m in masks], "part string, mask int"))
    assert sums.select(audit.mask_counts(F.col("sums"), 32)).first()[0] == [Counter(masks)[m] for m in range(32)]


def test_long_and_odd_texts():
    texts = ["", None, "a " * 2_000_000, "é" * 500_000, " \n", "ab cd " * 100 + "x" * 300_000, "AB"]
    got = np.concatenate([audit.text_failures(c) for c in tn.string_chunks(pa.array(texts))]).tolist()
    want = [sum(1 << "ABCDE".index(x) for x in f) for f in failures([{"doc_id": None, "text": t} for t in texts])]
    assert got == want
