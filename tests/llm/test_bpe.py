import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from util import awkward, crowded, empty

from flowsieve.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rnd = random.Random(4)
    ranges = [(32, 127), (0xA0, 0x500), (0x4E00, 0x9000), (0x1F300, 0x1F700), (9, 14)]
    made = ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(1, 150))) for _ in range(300)]
    return [*made, "", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>x", "\0special<|endoftext|>", "  \n\n\t  x  ", "é" * 300, "a" * 9000, "ab" * 4000, "I'll don't", *["z" * n for n in (1, 2, 3, 63, 64, 65, 127, 128)]]


def test_encodes_and_decodes_as_the_library(library):
    texts = odd_texts()
    want = library.encode_batch(texts, add_special_tokens=False)
    got = bpe.Encoder(bpe.vocabulary(PATH)).encode(texts)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_trees_of_one_and_of_many_agree():
    vocab, rnd = bpe.vocabulary(PATH), random.Random(9)
    tokens = [bytes(rnd.choice(b"theandingstion") for _ in range(rnd.randrange(1, 60))) for _ in range(500)]
    import numpy as np

    assert [np.frombuffer(x, np.int32).tolist() for x in bpe.encode_words(vocab, tokens)] == [bpe.encode_long(vocab, t) for t in tokens]


def test_windows_and_blocks_as_the_library(library, monkeypatch):
    for name, value in (("LONG", 300), ("WINDOW", 128), ("OVERLAP", 64), ("ABREAST", 3), ("CHUNK", 400), ("BLOCK", 7)):
        monkeypatch.setattr(bpe, name, value)
    rnd, encoder = random.Random(5), bpe.Encoder(bpe.vocabulary(PATH))
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(301, 3000))) for letters in ("ab", "etaoinsh", "aA", "-", "é中", "helo") for _ in range(12)]
    periods = [("".join(rnd.choice("abcdeh") for _ in range(n)) * 900)[: 2000 + n] for n in range(1, 40)]
    texts = [*made, *periods, *odd_texts(), " ".join([*made, *periods]), "<|endoftext|>".join(made)]
    assert [g.tolist() for g in encoder.encode(texts)] == [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    assert max(map(len, encoder.known)) <= bpe.REMEMBERED


def test_windows_that_do_not_meet(monkeypatch):
    vocab, word = bpe.vocabulary(PATH), b"haha" * 2000
    whole = bpe.encode_long(vocab, word)
    monkeypatch.setattr(bpe.Window, "meets", lambda *_: None)
    assert bpe.encode_windows(vocab, word).tolist() == whole  # each window starts at a token of the one before
    monkeypatch.setattr(bpe, "_window_after", lambda *_: None)
    assert bpe.encode_windows(vocab, word) == whole  # one tree


def test_query_columns(spark, library):
    docs = crowded(awkward(spark))
    got = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()
    texts = sorted((r["text"] or "") for r in docs.select("text").collect())
    assert sorted(r["decoded"] for r in got) == texts
    assert sorted(r["ids"] for r in got) == sorted(e.ids for e in library.encode_batch(texts, add_special_tokens=False))


def test_decodes_any_ids(spark, library):
    ids = [[50256, 162, 0], [], [11737], list(range(160, 200))]
    df = spark.createDataFrame([(x,) for x in [*ids, None]], "ids array<int>")
    assert [r["decoded"] for r in bpe.bpe_decode(df, PATH).collect()] == [*[library.decode(x, skip_special_tokens=False) for x in ids], None]


def test_empty(spark):
    assert bpe.bpe_encode(empty(spark), PATH).count() == 0
    assert spark.createDataFrame([([1, 22],)], "ids array<int>").select(bpe.id_digest()).first()[0] == spark.range(1).select(F.sha2(F.lit("1,22"), 256)).first()[0]
