"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and a sample of all documents (U, toxic ones among them) train a linear classifier
with numpy. With class prior pi and logistic losses, the risk of negatives is estimated as R_u(-) - pi R_p(-); where that falls
below zero, which no true risk can, the step goes against it instead of along it. Features are whole words and five-byte
pieces of words, lower-cased, so inflected forms of a stem share features. The few that tell classes apart are chosen by
prior-corrected document frequencies; a document's values are log(1 + count).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .workspace import arrow_map

BITS = 20
GRAM = 5
_MAP = tn.LOWER.copy()
_MAP[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _features(chunk: tn.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of a chunk, and the document of each, some at a time: first all whole words, then the pieces."""
    raw = _MAP[chunk.data]
    starts, ends, of_doc = tn.Chunk(chunk.first, raw, chunk.offsets).words()
    number = lambda hashes: (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    for low in range(0, len(starts), tn.BLOCK):
        part = slice(low, low + tn.BLOCK)
        yield number(tn.span_hashes(raw, starts[part], ends[part])), np.searchsorted(of_doc, np.arange(low, min(low + tn.BLOCK, len(starts))), side="right") - 1
    # one blank before and after every document, so pieces may touch a word's border but never another document
    padded = np.full(len(raw) + 2 * chunk.n, 32, np.uint8)
    for i, (a, b) in enumerate(zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)):
        padded[a + 2 * i + 1 : b + 2 * i + 1] = raw[a:b]
    doc_ends = chunk.offsets[1:] + 2 * np.arange(1, chunk.n + 1)
    n = max(0, len(padded) - GRAM + 1)
    for low in range(0, n, tn.BLOCK):
        high = min(low + tn.BLOCK, n)
        piece, whole = np.zeros(high - low, np.uint64), np.ones(high - low, bool)
        for k in range(GRAM):
            b = padded[low + k : high + k]
            piece |= b.astype(np.uint64) << np.uint64(8 * k)
            if 0 < k < GRAM - 1:
                whole &= b != 32
        at = np.flatnonzero(whole)
        yield number(tn.mix64(piece[at])), np.searchsorted(doc_ends, at + low, side="right")


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of (cells, counts) and their counts in all."""
    cells, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return cells, np.bincount(at, np.concatenate([n for _, n in found]) if found else None, len(cells)).astype(np.int64)


def _counted(chunk: tn.Chunk, place: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, chosen feature, count) of a chunk; ``place`` has the chosen features' places and -1."""
    found = []
    for ids, docs in _features(chunk):
        own = place[ids]
        hit = own >= 0
        found.append(np.unique(docs[hit] * kept + own[hit], return_counts=True))
    cell, count = _merged(found)
    return cell // kept, cell % kept, count


@dataclass
class Model:
    place: np.ndarray = field(default_factory=lambda: np.full(1 << BITS, -1, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bias: float = -20.0

    def scores(self, chunk: tn.Chunk) -> np.ndarray:
        docs, own, count = _counted(chunk, self.place, len(self.weights))
        z = np.full(chunk.n, self.bias)
        np.add.at(z, docs, self.weights[own] * np.log1p(count))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def nn_pu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-3, floor: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk. Deterministic."""
    d = xp.shape[1]
    w = np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def side(x: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        """Mean logistic loss of the label ``sign`` and its gradient."""
        z = np.clip(sign * (x @ w[:-1].astype(x.dtype) + w[-1]), -60, 60)
        pull = -sign / (1 + np.exp(z)) / len(x)
        return float(np.logaddexp(0, -z).mean()), np.append(pull.astype(x.dtype) @ x, pull.sum())

    for t in range(1, steps + 1):
        (_, gp), (pn, gpn), (un, gun) = side(xp, 1.0), side(xp, -1.0), side(xu, -1.0)
        negative = un - prior * pn
        g = prior * gp + gun - prior * gpn if negative >= -floor else -(gun - prior * gpn)
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def choose(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float, most: int, sigmas: float = 1.0, ratio: float = 10.0) -> np.ndarray:
    """Features of toxic text by document frequencies in P and U. What U holds beyond the prior's share of P is clean text's own; a feature is
    chosen where a low estimate of its share of toxic text is ``ratio`` times a high one of its share of clean text, the most telling first."""
    n_p, n_u = max(n_p, 1), max(n_u, 1)
    in_p, in_u = p / n_p, u / n_u
    low = in_p - sigmas * np.sqrt(in_p * (1 - in_p) / n_p)
    high = (np.maximum(0, in_u - prior * in_p) + sigmas * np.sqrt((in_u + 1 / n_u) / n_u)) / (1 - prior)
    worth = np.where(low > ratio * high, low * np.log(np.maximum(low, 1e-12) / high), 0)
    top = np.argsort(-worth, kind="stable")[:most]
    return np.sort(top[worth[top] > 0])


def document_frequencies(rows: DataFrame, among: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """How many texts of ``rows`` (text) have each feature, and the texts in all. ``among``: which features count (default: all); the
    others are not shuffled or sent to the driver."""
    shared = None if among is None else rows.sparkSession.sparkContext.broadcast(among)  # 2^BITS flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for chunk in tn.string_chunks(batch.column(0)):
                seen += chunk.n
                cells = [np.unique((docs << BITS | ids)[slice(None) if shared is None else shared.value[ids]]) for ids, docs in _features(chunk)]
                held += np.bincount(np.unique(np.concatenate(cells)) & ((1 << BITS) - 1) if cells else np.zeros(0, np.int64), minlength=1 << BITS)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(held[there], seen))], ["key", "n"])

    found = arrow_map(rows, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 2^BITS + 1 rows
    keys, counts = found["key"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[keys[keys >= 0]] = counts[keys >= 0]
    return out, int(counts[keys < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_any: int = 6000, features: int = 1024, parts: int = 8, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Trains on at most ``max_toxic`` confirmed rows and ``max_any`` of all rows, those with the lowest hashes of their ids. Features are chosen by
    their document frequencies in the confirmed rows and in all of ``docs``. The prior is the toxic share of all labelled rows. Without
    toxic labels nothing is toxic. The driver gets the counts of the confirmed rows' features and the chosen values, no texts."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model()
    prior = min(max(toxic / n, 1e-3), 0.9)
    lowest = lambda ids, most: ids.orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = lowest(known.filter("toxic = 1").select("id"), max_toxic).withColumn("kind", F.lit(1)).unionByName(lowest(docs.select(F.col(doc_id).alias("id")).filter("id is not null").distinct(), max_any).withColumn("kind", F.lit(0)))
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("id")).select("id", "kind", F.col(text).alias("text"))  # at most max_toxic + max_any ids
    rows = rows.repartition(parts, "id").sortWithinPartitions("id", "kind", "text")
    in_p, seen_p = document_frequencies(rows.filter("kind = 1").select("text"))
    in_u, seen_u = document_frequencies(docs.select(F.col(text).alias("text")), in_p > 0)  # others can't be chosen
    if not seen_p or not seen_u:
        return Model()
    top = choose(in_p, in_u, seen_p, seen_u, prior, features)
    if not len(top):
        return Model()
    place = np.full(1 << BITS, -1, np.int32)
    place[top] = np.arange(len(top))
    shared = docs.sparkSession.sparkContext.broadcast(place)  # 2^BITS numbers
    kept = len(top)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tn.string_chunks(batch.column(2)):
                own, feats, counts = _counted(chunk, shared.value, kept)
                cuts = np.searchsorted(own, np.arange(chunk.n + 1))
                part = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feats, pa.int64())), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(counts, pa.int64()))],
                    ["id", "kind", "feats", "counts"],
                )

    got = arrow_map(rows, values, "id long, kind int, feats array<long>, counts array<long>").toArrow().sort_by([("kind", "ascending"), ("id", "ascending")])
    sides = []
    for kind in (1, 0):
        part = got.filter(pa.compute.equal(got["kind"], kind)).combine_chunks()
        x = np.zeros((len(part), kept), np.float32)
        for i, (f, c) in enumerate(zip(part["feats"], part["counts"], strict=True)):
            x[i, np.asarray(f.values)] = np.log1p(np.asarray(c.values))
        sides.append(x)
    weights, bias = nn_pu(sides[0], sides[1], prior)
    return Model(place, weights, bias)


def toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) in place of the text; null and empty texts get the score of no evidence."""
    rest = [c for c in docs.columns if c not in (text, out)]
    source = docs.select(*rest, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size that BITS and the number of features fix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(c) for c in tn.string_chunks(batch.column(len(rest)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*rest, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return arrow_map(source, run, ", ".join([*fields, f"`{out}` double"]))


def remainder(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Ids whose crc32 modulo 4 is 2 are held out of training, as are null ids.

    Null and empty texts get the score of no evidence. Equal texts have equal scores, whatever their ids; repeated rows stay, each with its score.
    Other columns are not read, so their names are free. An empty table gives an empty result; without toxic labels every score is near 0."""
    learn = F.coalesce(remainder(doc_id, 4) != 2, F.lit(False))
    model = fit(docs.filter(learn), labels.filter(learn), doc_id=doc_id, text=text, **options)
    scored = toxicity(docs.select(doc_id, F.col(text).alias("text")), model)
    return scored.select(F.col(doc_id), F.coalesce(remainder(doc_id, 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
