import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_bpe import odd_texts
from tokenizers import Tokenizer
from util import SMALL, awkward, crowded, empty

from flowsieve.llm import packing
from flowsieve.llm.queries import op13_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENS = "row long, doc_id long, source string, digest long, tokens long"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_encodes_as_the_library(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    texts = [*odd_texts(), "It's we'LL  x", "á ́b ΑΣ ΣΑΣ", "x<|endoftext|>y <|startoftext|>", " 　 A\x85B"]
    encoder = packing.Encoder(PATH)
    for a in range(0, len(texts), 40):
        ids, ends = encoder.encode(pa.array(texts[a : a + 40]), 1)
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [want_ids(library, t) for t in texts[a : a + 40]]


def test_latin_words_are_cut_as_the_library_does(library):
    rnd = random.Random(5)
    letters = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA0, 0x300)])) + "'''aeioust'" + "$<|"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(4000)] + ["it's", "I'LL", "'s't", "x'", "<|", "A1b22'd", "<|ENDOFTEXT|>", "İstanbul", "ǅ", "ª1²"]
    ids, ends = packing.Encoder(PATH).encode(pa.array(words), 1)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [want_ids(library, w) for w in words]


def test_simple_words_are_cut_by_tables_and_take_the_model_alone(library, monkeypatch):
    """No such word goes the way of words one by one; long ones and those with apostrophes do."""
    rnd = random.Random(6)
    letters = [chr(c) for c in packing._PLAIN if chr(c) not in "'<" and len(chr(c).lower()) == 1]
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)] + ["A1b22", "x--Y", "ÀÉ", "²1½", "z" * packing.SHORT]
    texts = [" ".join(words[a : a + 7]) for a in range(0, len(words), 7)] + ["", "  \n ", " a  B "]
    encoder, slow = packing.Encoder(PATH), []
    monkeypatch.setattr(encoder, "_encode_words", lambda words: slow.extend(words) or packing.Encoder._encode_words(encoder, words))
    ids, ends = encoder.encode(pa.array([*texts, "it's <b> 中 " + "y" * (packing.SHORT + 1)]), 1)
    assert sorted(w for w in slow if w) == sorted(["it's", "<b>", "中", "y" * (packing.SHORT + 1)])
    assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(texts)] == [want_ids(library, t) for t in texts]
    assert ids[ends[-2] :].tolist() == want_ids(library, "it's <b> 中 " + "y" * (packing.SHORT + 1))


def test_long_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 100)
    text = "some words, \n and more's 12 " * 300 + "z" * 500 + " end"
    assert packing._encode_long(packing.Encoder(PATH), text, 1).tolist() == want_ids(library, text)


def check(pieces, texts, library, length):
    """Every id in one piece, sequences gapless and full but for powers of two."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"], p["doc_tokens"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    for n, own in sequences.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == length or (at < length and at & (at - 1) == 0), (n, at)
    spelled = Counter()
    for p in pieces:
        spelled[p["doc_id"], p["start"], p["length"], p["crc"]] += 1
    by_id = defaultdict(list)
    for doc_id, text in texts:
        by_id[doc_id].append(want_ids(library, text))
    assert sum(p["length"] for p in pieces) == sum(len(x) for own in by_id.values() for x in own)
    for (doc_id, start, size, crc), n in spelled.items():
        parts = [zlib.crc32(np.array(x[start : start + size], "<u4").tobytes()) for x in by_id[doc_id] if len(x) >= start + size]
        assert parts.count(crc) >= min(n, 1)
    return sequences


def test_query(spark, library):
    rows = op13_packing(spark, SMALL)
    assert dict(rows.dtypes) == dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check([r.asDict() | {"crc": r["ids_crc32"]} for r in rows.collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()], library, 2048)


def test_awkward_rows(spark, library):
    docs = crowded(awkward(spark))
    rows = packing.pack(docs, PATH, 256).withColumn("crc", F.crc32("ids")).collect()
    sequences = check([r.asDict() for r in rows], [tuple(r) for r in docs.select("doc_id", "text").collect()], library, 256)
    assert all({p["sequence_tokens"] for p in own} == {sum(p["length"] for p in own)} for own in sequences.values())
    assert sorted({r["source"] for r in rows}) == sorted({r[0] or "" for r in docs.select("source").collect()})


def rounds(queues, length, targets=None):
    """Deficit round-robin, one window after the other, in fractions: the documents in their order."""
    total = sum(map(sum, queues.values()))
    targets = targets or {}
    rest = sum(sum(q) for s, q in queues.items() if s not in targets)
    share = {s: Fraction(targets[s]).limit_denominator(1000) if s in targets else (1 - sum(Fraction(t).limit_denominator(1000) for t in targets.values())) * Fraction(sum(q), rest) for s, q in queues.items()}
    assert total == sum(map(sum, queues.values()))
    credit, at, out = dict.fromkeys(queues, Fraction(0)), dict.fromkeys(queues, 0), []
    while any(at[s] < len(q) for s, q in queues.items()):
        for s in sorted(queues):
            credit[s] += share[s] * length
            while at[s] < len(queues[s]) and queues[s][at[s]] <= credit[s]:
                credit[s] -= queues[s][at[s]]
                out.append((s, at[s]))
                at[s] += 1
    return out


def order_of(spark, queues, length, targets=None):
    """The order in which place() lays the documents; ids are chosen so that a queue's hash order is the list's order."""
    n = sum(map(len, queues.values()))
    hashes = spark.range(n).select("id", F.xxhash64(F.col("id"), F.lit(0).cast("long"), F.lit(None).cast("long")).alias("h")).orderBy(F.shiftrightunsigned("h", 32), "h").collect()
    ids = iter([r["id"] for r in hashes])
    rows = [(next(ids), s, i, t) for s, q in queues.items() for i, t in enumerate(q)]
    tokens = spark.createDataFrame([(d, d, s, 0, t) for d, s, _, t in rows], TOKENS)
    name = {d: (s, i, t) for d, s, i, t in rows}
    got = sorted((r["begin"], name[r["row"]]) for r in packing.place(tokens, length, targets).collect())
    at = 0
    for begin, (_, _, t) in got:
        assert begin == at
        at += t
    return [(s, i) for _, (s, i, _) in got]


def queues(seed, sizes):
    rng = np.random.default_rng(seed)
    return {s: [int(x) for x in rng.integers(1, 90, n)] for s, n in sizes.items()}


def test_order_is_that_of_deficit_round_robin(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_DOCS", 7)
    monkeypatch.setattr(packing, "RUN_WINDOWS", 2)
    monkeypatch.setattr(packing, "GROUP", 3)
    made = queues(1, {"a": 200, "b": 60, "": 5, "c": 1})
    made["b"][10] = 3000  # longer than many windows
    assert order_of(spark, made, 64) == rounds(made, 64)


def test_targets(spark):
    made = queues(2, {"a": 40, "b": 120, "c": 120, "d": 40})
    got = order_of(spark, made, 128, {"a": 0.5})
    size = lambda rows: Counter({s: sum(made[s][i] for x, i in rows if x == s) for s in made})
    first = size(got[:60])
    assert abs(first["a"] / sum(first.values()) - 0.5) < 0.05  # until a runs out
    late = size(got[100:])
    assert late["a"] == 0 and abs(late["b"] / sum(late.values()) - sum(made["b"]) / sum(sum(made[s]) for s in "bcd")) < 0.05
    with pytest.raises(ValueError, match="targets"):
        order_of(spark, made, 128, {"a": 1.0})


def test_every_window_has_the_proportions(spark):
    made = queues(3, {"a": 3000, "b": 1000, "c": 500})
    whole, seen = sum(map(sum, made.values())), Counter()
    for s, i in order_of(spark, made, 256):
        seen[s] += made[s][i]
        passed = sum(seen.values())
        assert all(abs(seen[x] - passed * sum(q) / whole) <= 256 + 2 * 90 for x, q in made.items())


def test_tail():
    assert packing.tail_bounds(0, 8) == [0] and packing.tail_bounds(16, 8) == [16] and packing.tail_bounds(15, 8) == [8, 12, 14, 15]


def test_same_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "sequence_id", "offset").collect())
    assert key(packing.pack(docs, PATH)) == key(packing.pack(docs.repartition(13, "text"), PATH))


def test_empty(spark):
    assert packing.pack(empty(spark), PATH).count() == 0
    one = packing.pack(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), PATH).collect()
    assert [(r["doc_tokens"], r["length"], r["sequence_id"], r["offset"], bytes(r["ids"])) for r in one] == [(1, 1, 0, 0, b"\x01\0\0\0")]
