import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from util import SMALL

from flowsieve.llm import chat, queries

TREE = "id string, parent string, role string, text string, score double"


def test_query_against_brute_force(spark):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        said[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op10_chat(spark, SMALL).collect()}
    assert got.keys() == said.keys()
    for k, turns in said.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[k])[1:5] == want


def test_escapes_are_reversible(spark):
    texts = ["<|turn|>", r"<\|end|>", "<s></s>[INST][/INST]", r"<\\s>", "<<||", "[[INST]", "", "plain", "<|turn|>\n<|end|>\n", "\\", "<\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))
    turns = F.array(*[F.struct(F.lit(f"ro\n<|le{i}\\n").alias("role"), F.lit(t).alias("text")) for i, t in enumerate(texts)])
    got = spark.range(1).select(chat.parse_turns(chat.format_turns(turns)).alias("t")).first()["t"]
    assert [(r["role"], r["text"]) for r in got] == [(f"ro\n<|le{i}\\n", t) for i, t in enumerate(texts)]


def test_branches_ranks_and_broken_trees(spark):
    rows = [("a", None, "user", "q", 1.0), ("b", "a", "assistant", "good", 5.0), ("c", "a", "assistant", "bad", 1.0), ("d", "b", "user", None, None), ("x", "lost", "user", "orphan", 0.0), ("p", "r", "user", "loop", 0.0), ("r", "p", "user", "loop", 0.0), (None, "a", "user", "no id", 0.0)]
    df = spark.createDataFrame(rows, TREE).withColumn("root", F.lit("clash"))
    every = {r["leaf"]: (r["root"], r["rank"], r["n_turns"]) for r in chat.format_trees(df, score="score").collect()}
    assert every == {"d": ("a", 1, 3), "c": ("a", 2, 2), "x": ("x", 1, 1)}
    best = chat.format_trees(df, top=1, score="score").filter("root = 'a'").first()
    assert best["formatted"] == "<|turn|>user\nq<|end|>\n<|turn|>assistant\ngood<|end|>\n<|turn|>user\n<|end|>\n"
    assert [best["formatted"][s["start"] : s["start"] + s["chars"]] for s in best["loss_spans"]] == ["good"]


def test_long_chain_and_ties_of_turns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)] + [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, None, "system", None), (None, 1, "user", "x")]
    got = {r["n_turns"]: r["formatted"] for r in chat.format_trees(chat.conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert sorted(got) == [1, 3, 70] and got[70].count("<|end|>") == 70
    assert got[3].index("system") < got[3].index("a<|end") < got[3].index("b<|end")


def test_empty(spark):
    assert chat.format_trees(spark.createDataFrame([], TREE)).count() == 0


def test_roles_with_any_character(spark):
    roles = ["a\0b", "\\", "\\n", "\n", "\\\n", "\\\\n\n", "\0\\\0", "<|turn|>"]
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit("t").alias("text")) for r in roles])
    got = spark.range(1).select(chat.parse_turns(chat.format_turns(turns)).alias("t")).first()["t"]
    assert [r["role"] for r in got] == roles


def test_repeated_ids_count_once(spark):
    rows = [("a", None, "user", "q", 1.0), ("b", "a", "assistant", "one", 1.0), ("b", "a", "assistant", "one", 1.0), ("b", "a", "assistant", "other", 2.0), ("b", "z", "assistant", "zed", 0.0), ("c", "b", "user", "end", 0.0)]
    got = chat.format_trees(spark.createDataFrame(rows, TREE), score="score").collect()
    assert [(r["root"], r["leaf"], r["n_turns"]) for r in got] == [("a", "c", 3)] and "one" in got[0]["formatted"]


def test_nothing_hangs_on_a_cycle(spark):
    rows = [("p", "q", "user", "x", 0.0), ("q", "p", "user", "x", 0.0), ("r", "q", "user", "x", 0.0), ("s", "s", "user", "x", 0.0), ("t", None, "user", "x", 0.0)]
    assert [r["leaf"] for r in chat.format_trees(spark.createDataFrame(rows, TREE)).collect()] == ["t"]


def test_a_bushy_tree_against_brute_force(spark):
    import random

    rng = random.Random(5)
    parent = {i: rng.randrange(i) if i >= 4 else None for i in range(300)}
    score = {i: rng.randrange(9) / 2 for i in parent}
    rows = [(str(i), None if p is None else str(p), "user", f"t{i}", score[i]) for i, p in parent.items()]
    paths = defaultdict(list)
    for leaf in set(parent) - set(parent.values()):
        path = [leaf]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        paths[path[-1]].append((-sum(score[i] for i in path) / len(path), str(leaf), len(path)))
    want = {(str(root), leaf, k + 1, n) for root, own in paths.items() for k, (_, leaf, n) in enumerate(sorted(own)[:3])}
    got = chat.format_trees(spark.createDataFrame(rows, TREE), top=3, score="score").collect()
    assert {(r["root"], r["leaf"], r["rank"], r["n_turns"]) for r in got} == want


def test_a_very_long_text_and_extra_columns(spark):
    long = "[INST] word " * 400_000
    rows = [(1, 0, "user", long, "x", 5), (1, 1, "assistant", long + "!", "y", 6)]
    said = chat.conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string, n long"))
    r = chat.format_trees(said).withColumn("back", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert r["back"] == long + "!" and r["n_turns"] == 2
