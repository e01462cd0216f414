"""A text of 30 MB goes through the text operators in bounded memory. Each runs in a process of its own, whose peak is read at its end."""

import os
import subprocess
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
MAKE = """
import resource
import numpy as np, pyarrow as pa
from flowsieve.llm import bpe, jaccard, language, lz, rules, toxicity, textnum as tn
rng = np.random.default_rng(1)
vocab = np.array([f"w{i}" for i in range(200000)])
part = lambda: " ".join(vocab[(rng.pareto(1.1, 20000) * 5).astype(int) % 200000])
text = ""
while len(text) < 30 << 20:
    text = "\\n".join([text, *(part() for _ in range(50))])
column = pa.array([text])
del text
def encoder():
    import public_tokenizers
    return bpe.Encoder(bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
pieces = lambda e: np.array(e.vocab.pieces, dtype=object)
letters = lambda n: rng.choice(np.frombuffer(b"etaoinshrdlucmfwypvb", np.uint8), n).tobytes().decode()
SIZE = 2 << 20
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
"""
STEPS = {
    "statistics": "stats = rules.chunk_stats(next(tn.string_chunks(column))); assert stats['n_words'][0] > 5e6",
    "language": "m = language.Model(list('abcde'), np.full(5, -12, np.float32), np.arange(6) * 100, np.tile(np.arange(100, dtype=np.int32), 5), np.full(500, -3, np.float32)); m.infer(next(tn.string_chunks(column)))",
    "toxicity": "place = np.full(1 << 20, -1, np.int32); place[::1000] = np.arange(len(place[::1000])); toxicity._counted(next(tn.string_chunks(column)), place, 2000)",
    "shingles": "(_, s), = jaccard.shingle_sets(column); assert len(s) > 1e6",
    "tokens": "e = encoder(); a, = e.encode(column.to_pylist()); assert bpe.decode_all(pieces(e), [a])[0] == column[0].as_py()",
    "tokens_without_blanks": "column = pa.array([letters(SIZE)]); e = encoder(); a, = e.encode(column.to_pylist()); assert bpe.decode_all(pieces(e), [a])[0] == column[0].as_py()",
    "phrases": "assert len(lz.Parse().feed(column[0].as_py().encode()).signature()) == lz.SIGNATURE",
}


@pytest.mark.parametrize("step", STEPS)
def test_memory(step):
    code = f"{MAKE}\n{STEPS[step]}\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024 - before)"
    out = subprocess.run([sys.executable, "-c", code], cwd=HOME, capture_output=True, text=True, check=True)
    assert int(out.stdout) < 400
