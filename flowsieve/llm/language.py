"""Language identification by mixture inference.

Each language is a distribution over byte trigrams within words, so every word has a likelihood in every language.
A document is a mixture: expectation-maximisation over its distinct words and their counts estimates the share of each language. The set of languages is
chosen by penalised likelihood: the k largest shares are fitted again for k = 1, 2, ... and the set wins whose log-likelihood less
log(words) / 2 for each further language is highest. The largest share of that set names the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .workspace import arrow_map
from .toxicity import remainder

BITS = 17
#: Each byte of a word is in three trigrams, so their likelihoods count a word three times over.
OVERLAP = 3.0
UNKNOWN = "und"
#: Words times languages whose likelihoods are held at once; a document beyond that goes alone.
CELLS = 1 << 21
#: Words whose trigrams are held at once.
WORDS = 1 << 16
_MAP = tn.LOWER.copy()
_MAP[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def _trigrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all bytes of the words [start, end), and the first trigram of each word."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.repeat(starts - first, sizes) + np.arange(sizes.sum())
    own = raw[at].astype(np.uint64)
    before, after = np.full(len(at), 32, np.uint64), np.full(len(at), 32, np.uint64)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[first + sizes - 1] = 32, 32
    return (tn.mix64(before | own << np.uint64(8) | after << np.uint64(16)) >> np.uint64(64 - BITS)).astype(np.int64), first


def _distinct_words(chunk: tn.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes; start, end and count of each document's distinct words; of each document the first of them (one more at the end)."""
    raw = _MAP[chunk.data]
    starts, ends, of_doc = tn.Chunk(chunk.first, raw, chunk.offsets).words()
    found = []
    for low in range(0, max(1, len(starts)), tn.BLOCK):
        part = slice(low, low + tn.BLOCK)
        docs = np.searchsorted(of_doc, np.arange(low, min(low + tn.BLOCK, len(starts))), side="right")
        hashes = tn.span_hashes(raw, starts[part], ends[part]) ^ tn.mix64(docs.astype(np.uint64))
        own, place, counts = np.unique(hashes, return_index=True, return_counts=True)
        found.append((own, place + low, counts))
    hashes, place, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    counts, place = np.bincount(at, counts, len(first)).astype(np.int64), place[first]
    order = np.argsort(place)
    place, counts = place[order], counts[order]
    return raw, starts[place], ends[place], counts, np.searchsorted(place, of_doc)


def _has_letter(chunk: tn.Chunk) -> np.ndarray:
    plain = tn.sums_between(_ASCII_LETTER[chunk.data], chunk.offsets) > 0
    wide = tn.sums_between(chunk.data >= 128, chunk.offsets) > 0
    for i in np.flatnonzero(~plain & wide):
        plain[i] = any(c.isalpha() for c in chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return plain


@dataclass
class Model:
    languages: list[str]
    unseen: np.ndarray  # log-likelihood, in each language, of a trigram that it does not have
    cuts: np.ndarray  # the trigrams of language k are grams[cuts[k]:cuts[k + 1]], and their log-likelihoods logs[...]
    grams: np.ndarray
    logs: np.ndarray

    def word_likelihoods(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihoods of words, words x languages; trigrams are held for WORDS words at a time."""
        tables = np.repeat(self.unseen[:, None], 1 << BITS, axis=1)
        for k in range(len(self.languages)):
            own = slice(self.cuts[k], self.cuts[k + 1])
            tables[k, self.grams[own]] = self.logs[own]
        out = np.empty((len(starts), len(self.languages)))
        for low in range(0, len(starts), WORDS):
            grams, first = _trigrams(raw, starts[low : low + WORDS], ends[low : low + WORDS])
            for k, table in enumerate(tables):
                out[low : low + WORDS, k] = np.add.reduceat(table[grams], first)
        return out / OVERLAP

    def infer(self, chunk: tn.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """documents x languages: shares after selection (rows of documents without letters are 0), and the chosen set."""
        raw, starts, ends, counts, words_of = _distinct_words(chunk)
        shares = np.zeros((chunk.n, len(self.languages)))
        known = _has_letter(chunk) & (np.diff(words_of) > 0)
        most, at = max(1, CELLS // max(1, len(self.languages))), 0
        while at < chunk.n and len(self.languages):
            to = max(at + 1, int(np.searchsorted(words_of, words_of[at] + most, side="right")) - 1)
            docs = np.flatnonzero(known[at:to])
            if len(docs):
                low, high = words_of[at], words_of[to]
                like = self.word_likelihoods(raw, starts[low:high], ends[low:high])
                shares[at + docs] = mixtures(like, words_of[at : to + 1] - low, docs, counts[low:high])
            at = to
        return shares, shares > 0


def _em(like: np.ndarray, cuts: np.ndarray, of: np.ndarray, n: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihoods (up to the rows' maxima) of documents whose distinct words are like[cuts[i]:cuts[i + 1]], each there n times."""
    total = np.add.reduceat(n, cuts)
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        r = like * shares[of]
        r *= (n / np.maximum(r.sum(axis=1), 1e-300))[:, None]
        shares = np.add.reduceat(r, cuts) / total[:, None]
    return shares, np.add.reduceat(n * np.log(np.maximum((like * shares[of]).sum(axis=1), 1e-300)), cuts)


def _slack(like: np.ndarray, cuts: np.ndarray, of: np.ndarray, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """How far the log-likelihood of any shares can lie above that of ``shares``, at most."""
    slopes = np.add.reduceat(like * (n / np.maximum((like * shares[of]).sum(axis=1), 1e-300))[:, None], cuts)
    return slopes.max(axis=1) - np.add.reduceat(n, cuts)


def mixtures(word_log: np.ndarray, words_of: np.ndarray, docs: np.ndarray, counts: np.ndarray, steps: int = 8, penalty: float = 0.5) -> np.ndarray:
    """Selected shares (documents x languages) of the documents ``docs``, from their distinct words' log-likelihoods and how often each is there."""
    take = np.concatenate([np.arange(words_of[d], words_of[d + 1]) for d in docs]) if len(docs) < len(words_of) - 1 else slice(None)
    like, n = word_log[take], counts[take].astype(float)
    held = np.diff(words_of)[docs]
    cuts = np.cumsum(held) - held
    of = np.repeat(np.arange(len(docs)), held)
    like = like - like.max(axis=1, keepdims=True)
    n_lang = like.shape[1]
    single = np.add.reduceat(like * n[:, None], cuts)
    np.exp(like, out=like)
    best = single.argmax(axis=1)
    chosen = np.eye(n_lang)[best]
    if n_lang == 1:
        return chosen
    full, full_ll = _em(like, cuts, of, n, np.ones((len(docs), n_lang)), steps)
    cost = penalty * np.log(np.maximum(np.add.reduceat(n, cuts), 2))
    value = single[np.arange(len(docs)), best]
    # The likelihood is concave in the shares, so its slopes at any shares bound it over all sets, converged or not.
    bound = np.minimum(full_ll + _slack(like, cuts, of, n, full), value + _slack(like, cuts, of, n, chosen))
    order = np.argsort(-full, axis=1, kind="stable")
    mixed = np.arange(len(docs))
    for k in range(2, n_lang + 1):
        mixed = mixed[bound[mixed] - cost[mixed] * (k - 1) > value[mixed]]  # no set of k or more languages can win elsewhere
        if not len(mixed):
            break
        own = np.concatenate([np.arange(cuts[i], cuts[i] + held[i]) for i in mixed])
        sub_held = held[mixed]
        sub_cuts, sub_of = np.cumsum(sub_held) - sub_held, np.repeat(np.arange(len(mixed)), sub_held)
        named = order[mixed, :k]
        shares, ll = _em(like[own[:, None], named[sub_of]], sub_cuts, sub_of, n[own], np.ones((len(mixed), k)), steps)
        gain = ll - cost[mixed] * (k - 1)
        won = gain > value[mixed]
        chosen[mixed[won]] = 0
        chosen[mixed[won][:, None], named[won]] = shares[won]
        value[mixed[won]] = gain[won]
    return chosen


def fit(docs: DataFrame, docs_per_language: int = 2000, parts: int = 8, smoothing: float = 0.5, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Trigram counts of about ``docs_per_language`` documents of each language, taken by the hash of their id. Every value of ``lang`` but null is a language."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    sizes = dict(known.groupBy(lang).count().collect())  # a row for each language
    languages = sorted(sizes)
    n = len(languages)
    if not n:
        return Model([], np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    shares = docs.sparkSession.createDataFrame([(name, k, docs_per_language / sizes[name]) for k, name in enumerate(languages)], "lang string, k long, share double")
    draw = F.pmod(F.xxhash64(F.lit("language"), doc_id), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = known.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw")).join(F.broadcast(shares), "lang")
    rows = rows.filter("draw < share").select("id", "k", "text").repartition(max(parts, n // 8), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.asarray(batch.column(1))
            for chunk in tn.string_chunks(batch.column(2)):
                raw = _MAP[chunk.data]
                starts, ends, of_doc = tn.Chunk(chunk.first, raw, chunk.offsets).words()
                own = np.repeat(kinds[chunk.first : chunk.first + chunk.n], np.diff(of_doc))
                found = []
                for low in range(0, len(starts), WORDS):
                    grams, _ = _trigrams(raw, starts[low : low + WORDS], ends[low : low + WORDS])
                    found.append(np.unique(np.repeat(own[low : low + WORDS], (ends - starts)[low : low + WORDS]) << BITS | grams, return_counts=True))
                keys, counts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])

    counted = arrow_map(rows, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # the trigrams that the languages have
    keys, counts = counted["key"].to_numpy(), counted["n"].to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(float)
    of, grams = keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32)
    seen = max(1, len(np.unique(grams)))
    whole = np.bincount(of, counts, n) + smoothing * seen
    logs = np.log((counts + smoothing) / whole[of]).astype(np.float32)
    return Model(languages, np.log(smoothing / whole).astype(np.float32), np.searchsorted(of, np.arange(n + 1)), grams, logs)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (its share of the words, 0 to 1) and lang_shares (map of the selected set) in place of the text.

    Texts that are null or have no letter are ``und`` with score 0, as are all without a trained language. Columns named like the results are replaced."""
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score", "lang_shares")]
    source = docs.select(*rest, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the trigrams that each language has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model_names = shared.value.languages
        for batch in batches:
            for chunk in tn.string_chunks(batch.column(len(rest))):
                shares, chosen = shared.value.infer(chunk)
                best = shares.argmax(axis=1) if names else np.zeros(chunk.n, int)
                known = chosen.any(axis=1)
                pred = [model_names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, shares[np.arange(chunk.n), best], 0.0) if names else np.zeros(chunk.n)
                sets = [[(names[k], float(s[k])) for k in np.flatnonzero(c)] for s, c in zip(shares, chosen, strict=True)]
                part = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], [*rest, "lang_pred", "score", "lang_shares"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return arrow_map(source, run, ", ".join([*fields, "lang_pred string, score double, lang_shares map<string,double>"]))


def identify_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and lang_shares of every row. Ids whose crc32 modulo 3 is 1 are held out of training, as are null ids.

    Texts that are null or have no letter are ``und`` with score 0. Equal texts get equal results; languages whose shares tie go by their names' order.
    Repeated rows stay, each with its result. Other columns are not read. An empty table gives an empty result, and without any value
    of ``lang`` every row is ``und``."""
    learn = F.coalesce(remainder(doc_id, 3) != 1, F.lit(False))
    model = fit(docs.filter(learn), text=text, lang=lang, doc_id=doc_id, **options)
    found = identify(docs.select(doc_id, F.col(text).alias("text")), model)
    return found.select(F.col(doc_id), F.coalesce(remainder(doc_id, 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_shares")
