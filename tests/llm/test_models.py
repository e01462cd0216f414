import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from util import SMALL, awkward, crowded, empty

from flowsieve.llm import language, queries, toxicity

MID = "/root/testdata/sf0.1"


def test_non_negative_learning_finds_the_boundary():
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(1.5, 1, (2000, 3)).astype(np.float32), rng.normal(-1.5, 1, (2000, 3)).astype(np.float32)
    xp, xu = positive[:600], np.concatenate([positive[600:1000], negative[:1600]])
    w, b = toxicity.nn_pu(xp, xu, 0.2)
    assert ((positive[1000:] @ w + b) > 0).mean() > 0.95 and ((negative[1600:] @ w + b) > 0).mean() < 0.05
    again = toxicity.nn_pu(xp, xu, 0.2)
    assert (again[0] == w).all() and again[1] == b


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = [r for r in queries.op1_toxicity(spark, MID).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for t, s in held if t], [s for t, s in held if not t]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
    assert np.mean(np.array(clean) >= 0.3) < 0.03 and np.mean(np.array(toxic) >= 0.3) > 0.6


def test_toxicity_of_awkward_rows(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = crowded(awkward(spark))
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["score"] is not None for r in rows)
    assert toxicity.score_documents(empty(spark), labels).count() == 0
    none = toxicity.score_documents(docs, labels.filter("toxic = 0")).collect()
    assert all(r["predicted"] == 0 for r in none)


def test_language_on_held_out_rows(spark):
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_language(spark, MID).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.99


def test_mixtures_and_selection(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs)
    text = {r["lang"]: r["text"] for r in docs.filter("length(text) > 1500").dropDuplicates(["lang"]).select("lang", "text").collect()}
    mixed = spark.createDataFrame([(1, text["en"][:1500] + " " + text["fr"][:500]), (2, text["de"][:1500])], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_shares"] for r in language.identify(mixed, model).collect()}
    assert set(got[1]) == {"en", "fr"} and 0.55 < got[1]["en"] < 0.9 and set(got[2]) == {"de"}


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    vocabulary = [["".join(w) for w in letters[rng.integers(0, 26, (30, 7))]] for _ in range(100)]
    rows = [(100 * i + k, " ".join(rng.choice(vocabulary[k], 40)), f"l{k}") for k in range(100) for i in range(9 if k < 64 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {d: lang for d, _, lang in rows}
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_documents(docs).collect()}
    assert {want[d] for d in got if got[d] == want[d]} == set(want.values())
    assert np.mean([got[d] == want[d] for d in want]) > 0.97


def mixture(words, steps=8):
    """Shares of the set with the highest penalised likelihood, by plain loops over all words' log-likelihoods."""
    like = [[math.exp(x - max(w)) for x in w] for w in words]

    def em(allowed):
        shares = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(words[0]))]
        for _ in range(steps):
            sums = [0.0] * len(shares)
            for w in like:
                whole = sum(x * q for x, q in zip(w, shares, strict=True))
                for k in allowed:
                    sums[k] += w[k] * shares[k] / max(whole, 1e-300)
            shares = [x / len(like) for x in sums]
        return shares, sum(math.log(max(1e-300, sum(x * q for x, q in zip(w, shares, strict=True)))) for w in like)

    n_lang = len(words[0])
    single = [sum(w[k] - max(w) for w in words) for k in range(n_lang)]
    best = max(range(n_lang), key=lambda k: single[k])
    want, value = [float(k == best) for k in range(n_lang)], single[best]
    full = em(range(n_lang))[0]
    order = sorted(range(n_lang), key=lambda k: -full[k])
    for k in range(2, n_lang + 1):
        shares, ll = em(order[:k])
        if ll - 0.5 * math.log(max(2, len(words))) * (k - 1) > value:
            want, value = shares, ll - 0.5 * math.log(max(2, len(words))) * (k - 1)
    return want


@pytest.mark.parametrize("n_lang", [4, 12])
def test_no_winning_set_is_left_out(n_lang):
    rng = np.random.default_rng(n_lang)
    held = rng.integers(3, 40, 150)
    words_of = np.append(0, np.cumsum(held))
    log = rng.normal(0, 1, (words_of[-1], n_lang)) * np.repeat(rng.uniform(0.3, 2.5, 150), held)[:, None]
    counts = rng.integers(1, 5, len(log))
    got = language.mixtures(log, words_of, np.arange(150), counts)
    for i in range(150):
        own = slice(words_of[i], words_of[i + 1])
        assert np.allclose(got[i], mixture(np.repeat(log[own], counts[own], axis=0).tolist()))


def mix64(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def mapped(text, kind):
    """Lower-cased bytes of a text, those that are no part of words as blanks."""
    return bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or kind(chr(b)) else 32 for b in (text or "").encode())


def test_language_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    grams = lambda w: [mix64(a | b << 8 | c << 16) >> 47 for a, b, c in zip(b" " + w, w, w[1:] + b" ", strict=False)]
    words = {r["doc_id"]: mapped(r["text"], str.isalpha).split(b" ") for r in docs}
    words = {d: [grams(w) for w in ws if w] for d, ws in words.items()}
    counts = defaultdict(Counter)
    for r in docs:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            counts[r["lang"]].update(g for w in words[r["doc_id"]] for g in w)
    names, seen = sorted(counts), len({g for c in counts.values() for g in c})
    whole = {k: c.total() + 0.5 * seen for k, c in counts.items()}
    log = {k: defaultdict(lambda k=k: float(np.float32(math.log(0.5 / whole[k]))), {g: float(np.float32(math.log((n + 0.5) / whole[k]))) for g, n in c.items()}) for k, c in counts.items()}
    rows = {r["doc_id"]: r for r in queries.op2_language(spark, SMALL).collect()}
    assert rows.keys() == words.keys()
    for d, ws in sorted(words.items())[::2]:
        if not ws or sum(map(len, ws)) > 30_000:
            continue
        shares = mixture([[sum(log[k][g] for g in w) / 3 for k in names] for w in ws])
        best = max(range(len(names)), key=lambda k: shares[k])
        assert (rows[d]["lang_pred"], round(rows[d]["score"], 3)) == (names[best], round(shares[best], 3)) or abs(rows[d]["score"] - shares[best]) < 1e-3


def test_toxicity_query_against_brute_force(spark):
    base = 0x9E3779B97F4A7C15 | 1
    number = lambda w: mix64((sum((b + 1) * pow(base, j, 2**64) for j, b in enumerate(w)) + len(w)) % 2**64) >> 44
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    docs = {d: t for d, t in docs.items() if len(t) < 20_000}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic").collect() if r["toxic"] is not None}
    features = {}
    for d, t in docs.items():
        raw = b" " + mapped(t, str.isalnum) + b" "
        pieces = [raw[i : i + 5] for i in range(len(raw) - 4)]
        features[d] = Counter([number(w) for w in raw.split(b" ") if w] + [mix64(int.from_bytes(p, "little")) >> 44 for p in pieces if 32 not in p[1:4]])
    learn = [d for d in docs if zlib.crc32(str(d).encode()) % 4 != 2]
    toxic = [d for d in learn if labels.get(d)]
    known = [d for d in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    prior = sum(labels[d] for d in known) / len(known)
    in_p, in_u = Counter(f for d in toxic for f in features[d]), Counter(f for d in learn for f in features[d])
    worth = {}
    for f, n in in_p.items():
        p, u = n / len(toxic), in_u[f] / len(learn)
        low = p - math.sqrt(p * (1 - p) / len(toxic))
        high = (max(0, u - prior * p) + math.sqrt((u + 1 / len(learn)) / len(learn))) / (1 - prior)
        if low > 10 * high:
            worth[f] = low * math.log(max(low, 1e-12) / high)
    top = sorted(sorted(worth), key=lambda f: -worth[f])[:1024]
    values = lambda ds: np.array([[math.log1p(features[d][f]) for f in top] for d in ds]).reshape(len(ds), len(top))
    xp, xu, w, m, v = values(toxic), values(learn), np.zeros(len(top) + 1), 0.0, 0.0
    w[-1] = math.log(prior / (1 - prior))
    plus = lambda x: np.column_stack([x, np.ones(len(x))])
    for t in range(1, 401):
        zp, zu = plus(xp) @ w, plus(xu) @ w
        slope = lambda x, z, sign: plus(x).T @ (-sign / (1 + np.exp(sign * z))) / len(x)
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        rest = slope(xu, zu, -1) - prior * slope(xp, zp, -1)
        g = (prior * slope(xp, zp, 1) + rest if negative >= 0 else -rest) + 1e-3 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(frame, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    for d, z in zip(docs, plus(values(list(docs))) @ w, strict=True):
        assert abs(got[d] - 1 / (1 + math.exp(-z))) < 5e-3


@pytest.mark.parametrize("text", [None, "", "123 !!", "· —"])
def test_no_letters(spark, text):
    model = language.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    r = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_language_of_awkward_rows(spark):
    docs = crowded(awkward(spark))
    assert language.identify_documents(docs).count() == docs.count()
    assert language.identify_documents(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in language.identify_documents(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang is null")).collect()} <= {"und"}
