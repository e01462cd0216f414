from collections import defaultdict

import pytest
from util import awkward, crowded, empty, lower

from flowsieve.llm import lines
from flowsieve.llm.workspace import Workspace


def brute(rows, min_docs, keep):
    keyed = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t in rows]
    docs = defaultdict(set)
    for i, ks in enumerate(keyed):
        for k in ks:
            docs[k].add(i)
    seen, out = set(), []
    for (d, t), ks in zip(rows, keyed, strict=True):
        left, dropped = [], 0
        for x, k in zip((t or "").split("\n"), ks, strict=True):
            often = k and len(docs[k]) >= min_docs
            if often and (keep == "none" or k in seen):
                dropped += 1
            else:
                left.append(x)
            if often:
                seen.add(k)
        out.append((d, len(ks), dropped, "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_docs", "keep"), [(10, "none"), (2, "none"), (2, "first")])
def test_against_brute_force(spark, min_docs, keep):
    docs = awkward(spark).select("doc_id", "text")
    if keep == "first":
        docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id")
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in lines.dedup_lines(docs, min_docs, 1, keep).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=repr) == brute(rows, min_docs, keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_lines_are_cut(spark, keep, monkeypatch):
    monkeypatch.setattr(lines, "SAMPLED", 1)
    monkeypatch.setattr(lines, "HOT_DOCS", 3)
    rows = [(i, f"Same line\nown {i}\n same LINE \nrare {i % 40}\n") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in lines.dedup_lines(docs, 3, 1, keep).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=repr) == brute(rows, 3, keep)


def test_the_sorted_stream_decides(spark):
    """Ranges of hashes, sorted by document and position, are what the window goes through: no other exchange lies between."""
    plan = lines.dropped_lines(awkward(spark), Workspace(spark, "t"))._jdf.queryExecution().sparkPlan().toString()
    window, ranges = plan.index("Window ["), plan.index("RangePartitioning" if "RangePartitioning" in plan else "rangepartitioning")
    assert window < plan.index("Sort [") < ranges or window < ranges
    final = lines.dropped_lines(awkward(spark), Workspace(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    between = final[final.index("Window [") : final.index("rangepartitioning")]
    assert "hashpartitioning" not in between and "Sort [a" in between


def test_bitmap_and_clashes(spark):
    docs = crowded(awkward(spark))
    got = lines.dedup_lines(docs, 2)
    assert set(got.columns) == set(docs.columns) | {"n_lines", "n_dropped", "keep_bitmap"}
    for r in got.select("n_lines", "n_dropped", "keep_bitmap").collect():
        runs = r["keep_bitmap"]
        assert sum(runs) == r["n_lines"] and sum(runs[1::2]) == r["n_dropped"] and all(x > 0 for x in runs[1:])
    docs = spark.createDataFrame([(1, "a\nb\na\na\nc"), (2, "a\nx\na"), (3, "y\nz")], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_bitmap"], r["text"]) for r in lines.dedup_lines(docs, 2).collect()}
    assert found == {1: ([0, 1, 1, 2, 1], "b\nc"), 2: ([0, 1, 1, 1], "x"), 3: ([2], "y\nz")}


def test_a_very_long_text(spark):
    long = "\n".join(["again and again"] * 300_000 + ["once"])
    docs = spark.createDataFrame([(1, long), (2, "again and again\nelse")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(docs, 2).collect()}
    assert got == {1: (300_001, 300_000, "once"), 2: (2, 1, "else")}


def test_dropped_lines_far_apart(spark):
    text = "\n".join("common" if i in (70, 71, 500, 1999) else f"own {i}" for i in range(2000))
    rows = [(1, text), (2, "common"), (3, "x\n" * 130 + "common"), (4, "common\n" + "y")]
    got = [tuple(r) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=repr) == brute(rows, 2, "none")


def test_empty(spark):
    assert lines.dedup_lines(empty(spark)).count() == 0
