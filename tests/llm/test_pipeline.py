from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
from tokenizers import Tokenizer
from util import SMALL, awkward, crowded, empty

from test_jaccard import brute as near_brute
from test_lines import brute as line_brute
from test_mixing import near_targets

from flowsieve.llm import mixing, rules


def test_stages_take_effect_and_keep_columns(spark):
    docs, seen = awkward(spark), {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        seen[name] = (before, docs)
        if name != "tokenise":
            assert docs.columns == pipeline.COLUMNS, name
    before, after = seen["quality_rules"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    want = sorted(r["doc_id"] or -1 for r in rules.judge(before, labels).filter("kept").collect())
    assert sorted(r["doc_id"] or -1 for r in after.collect()) == want
    before, after = seen["line_dedup"]
    want = line_brute([(r["doc_id"], r["text"]) for r in before.collect()], 10, "none")
    assert sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=repr) == sorted(((d, t) for d, _, _, t in want), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["near_duplicates"]
    groups = near_brute([(r["doc_id"], r["text"]) for r in before.collect()])
    kept = [r["doc_id"] for r in after.collect()]
    assert sorted(map(repr, kept)) == sorted([repr(c) for c in {c for _, n, c in groups if n}] + [repr(d) for d, n, _ in groups if not n])
    before, after = seen["mix_sources"]
    plan = mixing.mix_plan(before, shards=pipeline.MIX_SHARDS).collect()
    near_targets(plan)
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in plan for _ in range(r["copies"]))
    before, after = seen["tokenise"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] or "" for r in before.collect()]
    assert sorted(r["ids"] for r in after.collect()) == sorted(e.ids for e in library.encode_batch(texts, add_special_tokens=False))
    assert after.filter("not exact").count() == 0


def test_run(spark):
    got = pipeline.run(spark, SMALL)
    assert got.count() > 0 and got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]


def test_empty(spark):
    docs = empty(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_extra_columns_are_not_carried(spark):
    docs = crowded(awkward(spark)).filter("doc_id < 100 or doc_id is null")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs if name == "quality_rules" else crowded(docs), SMALL)
        assert docs.columns == (pipeline.COLUMNS if name != "tokenise" else ["doc_id", "lang", "source", "n_tokens", "ids", "exact"])
    assert docs.count() > 0
