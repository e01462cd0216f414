"""Byte-level BPE by segment trees over adjacent pair ranks.

A pretoken is an array of symbols; leaf i of its tree holds the rank of the pair (symbol i, next live symbol), or no rank.
Each inner node holds the lower rank of its children and, between equals, the left one, so the root names the leftmost
lowest-rank merge. A merge updates at most two leaves and their paths to the root, and the end is a root without a rank.
Distinct pretokens of a chunk of texts go through together: their trees are the rows of one array and each step merges one pair
in every row. A pretoken that is too long for that has the same tree to itself.

A pretoken of more than LONG bytes goes in overlapping windows, many side by side, so its trees stay small. Where merges only
build on earlier ones (checked when the vocabulary is read), ranks never fall while a text is merged, and so a sequence of tokens
is the encoding of its text exactly if each two neighbours are the encoding of theirs. Two windows are joined at a place where
both begin the same token: each two neighbours of the joined sequence are then neighbours in the encoding of one window.

The vocabulary file is a parameter (the JSON of the public ``tokenizers`` library). Ids follow that library: special tokens in
a text become their id, the rest is cut by the byte-level pattern, and merges go by rank.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import arrow_map

#: Fixed value: the cutting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Pretokens of more bytes get a tree of their own; distinct pretokens that a worker remembers; characters of text at once.
ROW_BYTES, CACHE, CHUNK = 64, 160_000, 1 << 19
#: Longest pretoken with one tree; bytes of a window and of its overlap with the next; windows side by side; pretokens of a text at once.
LONG, WINDOW, OVERLAP, ABREAST, BLOCK = 1 << 17, 2048, 256, 256, 1 << 17
#: Pretokens of more characters are not remembered.
REMEMBERED = 256


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda piece: bytes(letters[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = model["vocab"]
        self.pieces = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for piece, i in ids.items():
            if piece not in self.special:
                self.pieces[i] = to_bytes(piece)
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.width = len(self.pieces)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        code, result = left * self.width + right, np.array([ids[a + b] for a, b in merges], np.int64)
        _, first = np.unique(code, return_index=True)
        self.codes, self.ranks, self.results = code[first], first.astype(np.int32), result[first]
        self.result_of_rank = result
        self.rank_of = {int(c): int(r) for c, r in zip(self.codes, self.ranks, strict=True)}
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        made = np.full(self.width, -1, np.int64)  # the last merge that makes a token
        np.maximum.at(made, result, np.arange(len(result)))
        self.builds_up = bool((np.maximum(made[left], made[right]) < np.arange(len(result))).all())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NONE) if len(self.codes) else np.full(len(code), NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def encode_long(vocab: Vocabulary, word: bytes) -> list[int]:
    """One pretoken by its own tree."""
    n, ids = len(word), [int(vocab.byte_ids[b]) for b in word]
    leaves = 1 << max(0, (n - 1).bit_length())
    none, rank_of, width = int(NONE), vocab.rank_of, vocab.width
    tree = [none] * (2 * leaves)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def rank(i: int) -> int:
        j = after[i]
        return none if j >= n else rank_of.get(ids[i] * width + ids[j], none)

    for i in range(n):
        tree[leaves + i] = rank(i)
    for k in range(leaves - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = leaves + i
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    while tree[1] != none:
        lowest, k = tree[1], 1
        while k < leaves:
            k = 2 * k if tree[2 * k] == lowest else 2 * k + 1
        i = k - leaves
        j = after[i]
        ids[i] = int(vocab.result_of_rank[lowest])
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def encode_rows(vocab: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Pretokens of at most ROW_BYTES bytes, all trees side by side."""
    sizes = np.array([len(w) for w in words])
    leaves = 1 << int(max(1, int(sizes.max()) - 1)).bit_length() if len(words) else 1
    n = len(words)
    ids = np.full((n, leaves), -1, np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids[row, col] = vocab.byte_ids[flat]
    after = np.tile(np.arange(1, leaves + 1, dtype=np.int64), (n, 1))
    before = np.tile(np.arange(-1, leaves - 1, dtype=np.int64), (n, 1))
    tree = np.full((n, 2 * leaves), NONE, np.int32)
    more = col + 1 < np.repeat(sizes, sizes)
    tree[row[more], leaves + col[more]] = vocab.pair_ranks(ids[row[more], col[more]], ids[row[more], col[more] + 1])
    k = leaves
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    tree, ids, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
    depth = leaves.bit_length() - 1

    def put(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> None:
        base, k = rows * (2 * leaves), leaves + cols
        tree[base + k] = values
        for _ in range(depth):
            k = k >> 1
            tree[base + k] = np.minimum(tree[base + 2 * k], tree[base + 2 * k + 1])

    def ranks_at(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        nxt = after[rows * leaves + cols]
        out = np.full(len(rows), NONE, np.int32)
        has = nxt < sizes[rows]
        r, c, x = rows[has], cols[has], nxt[has]
        out[has] = vocab.pair_ranks(ids[r * leaves + c], ids[r * leaves + x])
        return out

    live = np.arange(n)
    while True:
        lowest = tree[live * (2 * leaves) + 1]
        going = lowest != NONE
        live, lowest = live[going], lowest[going]
        if not len(live):
            break
        base, k = live * (2 * leaves), np.ones(len(live), np.int64)
        for _ in range(depth):
            k = 2 * k
            k += tree[base + k] != lowest
        i = k - leaves
        at = live * leaves
        j = after[at + i]
        ids[at + i] = vocab.result_of_rank[lowest]
        ids[at + j] = -1
        beyond = after[at + j]
        after[at + i] = beyond
        inside = beyond < sizes[live]
        before[(at + beyond)[inside]] = i[inside]
        put(live, j, np.full(len(live), NONE, np.int32))
        put(live, i, ranks_at(live, i))
        prior = before[at + i]
        has = prior >= 0
        put(live[has], prior[has], ranks_at(live[has], prior[has]))
    kept = ids >= 0
    cuts = (np.cumsum(kept.reshape(n, leaves).sum(axis=1)) * 4).tolist()
    flat = ids[kept].astype(np.int32).tobytes()
    return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Window:
    """The tokens of a part of a pretoken and the places where they begin."""

    def __init__(self, vocab: Vocabulary, start: int, ids: np.ndarray):
        sizes = vocab.lengths[ids]
        self.ids, self.places, self.end = ids, start + np.cumsum(sizes) - sizes, start + int(sizes.sum())

    def meets(self, other: Window, since: int) -> int | None:
        """The first place from ``since`` on where both begin the same token."""
        places, mine, its = np.intersect1d(self.places, other.places, assume_unique=True, return_indices=True)
        same = places[(places >= since) & (self.ids[mine] == other.ids[its])]
        return int(same[0]) if len(same) else None

    def between(self, a: int, b: int) -> np.ndarray:
        return self.ids[np.searchsorted(self.places, a) : np.searchsorted(self.places, b)]


def _window_after(vocab: Vocabulary, word: bytes, last: Window, since: int) -> tuple[Window, int] | None:
    """A window that begins where a token of the last one's end begins, and with the same token."""
    at = last.places[last.places >= max(since, last.end - OVERLAP)]
    for place in at[:16].tolist():
        found = Window(vocab, place, np.array(encode_long(vocab, word[place : place + WINDOW + OVERLAP]), np.int32))
        if found.ids[0] == last.ids[np.searchsorted(last.places, place)]:
            return found, place
    return None


def encode_windows(vocab: Vocabulary, word: bytes) -> list[int] | np.ndarray:
    """One very long pretoken by windows; with one tree where the vocabulary doesn't allow that or windows can't be joined."""
    if not vocab.builds_up:
        return encode_long(vocab, word)
    step, out, last, since = WINDOW - OVERLAP, [], None, 0
    starts = range(0, max(1, len(word) - OVERLAP), step)
    for a in range(0, len(starts), ABREAST):
        own = starts[a : a + ABREAST]
        for start, ids in zip(own, encode_rows(vocab, [word[s : s + WINDOW] for s in own]), strict=True):
            here = Window(vocab, start, np.frombuffer(ids, np.int32))
            if last is not None:
                place = last.meets(here, since)
                if place is None:
                    found = _window_after(vocab, word, last, since)
                    if found is None:
                        return encode_long(vocab, word)
                    here, place = found
                out.append(last.between(since, place))
                since = place
            last = here
    return np.concatenate([*out, last.between(since, len(word))])


def encode_words(vocab: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids of distinct pretokens as 32-bit numbers; trees of like size go together."""
    out = [b""] * len(words)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(max(3, (len(w) - 1).bit_length()) if len(w) <= ROW_BYTES else 99, []).append(i)
    for size, own in by.items():
        if size == 99:
            for i in own:
                out[i] = np.asarray((encode_windows if len(words[i]) > LONG else encode_long)(vocab, words[i]), np.int32).tobytes()
        else:
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                for i, ids in zip(part, encode_rows(vocab, [words[i] for i in part]), strict=True):
                    out[i] = ids
    return out


class Encoder:
    """Encodes texts; remembers the ids of about CACHE distinct pretokens, those met last."""

    def __init__(self, vocab: Vocabulary):
        import regex

        self.vocab, self.known, self.older = vocab, {}, {}
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True))) if vocab.special else None

    def _parts(self, text: str) -> Iterator[tuple[int, int, str | None]]:
        """Runs of plain text and, between them, special tokens."""
        at = 0
        if self.specials is not None and any(s in text for s in self.vocab.special):
            for found in self.specials.finditer(text):
                yield at, found.start(), found.group()
                at = found.end()
        yield at, len(text), None

    def pretokens(self, text: str) -> Iterator[str]:
        for a, b, special in self._parts(text):
            yield from (m.group() for m in self.words.finditer(text, a, b))
            if special is not None:
                yield "\0special" + special

    def _cut(self, text: str) -> list[str]:
        if self.specials is None or not any(s in text for s in self.vocab.special):
            return self.words.findall(text)
        return list(self.pretokens(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A text of more than CHUNK characters is cut and encoded a block of pretokens at a time."""
        short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
        out = dict(zip(short, self._encode([self._cut(texts[i]) for i in short]), strict=True))
        for i in set(range(len(texts))) - set(short):
            rest, done = self.pretokens(texts[i]), []
            while block := list(islice(rest, BLOCK)):
                done += self._encode([block])
            out[i] = np.concatenate(done)
        return [out[i] for i in range(len(texts))]

    def _encode(self, cut: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for w in set(chain.from_iterable(cut)):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        plain = []
        for w in new:
            if w.startswith("\0special") and w[8:] in self.vocab.special:
                known[w] = np.array([self.vocab.special[w[8:]]], np.int32).tobytes()
            else:
                plain.append(w)
        for w, ids in zip(plain, encode_words(self.vocab, [w.encode() for w in plain]), strict=True):
            known[w] = ids
        get = known.__getitem__
        made = [np.frombuffer(b"".join(map(get, words)), np.int32) for words in cut]
        for w in plain:
            if len(w) > REMEMBERED:
                del known[w]
        return made


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """The encoder that the tasks of one Python worker share, one after the other."""
    return Encoder(vocabulary(path))


def decode_all(pieces: np.ndarray, ids: list[np.ndarray]) -> list[str]:
    """Texts of id arrays; bytes that are no UTF-8 become U+FFFD."""
    return [b"".join(b"".join(pieces[x[a : a + BLOCK]].tolist()) for a in range(0, len(x), BLOCK)).decode("utf-8", "replace") for x in ids]


def _encoder(path: str, at: int, names: list[str], out: str, decoded: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        pieces = np.array(encoder.vocab.pieces, dtype=object)
        for batch in batches:
            texts = batch.column(at).fill_null("")
            sizes = np.cumsum(np.asarray(pa.compute.utf8_length(texts)))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
                part = batch.slice(a, b - a)
                ids = encoder.encode(texts.slice(a, b - a).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                if decoded:
                    made.append(pa.array(decode_all(pieces, ids), pa.string()))
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != at], *made], [*names, out, *([decoded] if decoded else [])])
                a = b

    return run


def bpe_encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the text replaced by its token ids (array of int); null or empty texts have none.

    ``decoded`` names a further column for the text that the ids decode to, made in the same pass. ``path`` is a file that every
    executor can open. Every text is encoded whole, however long; repeated rows alike. Columns named like the results are
    replaced. An empty table gives an empty result."""
    rest = [c for c in docs.columns if c not in (text, out, decoded)]
    source = docs.select(*rest, text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    made = [f"`{out}` array<int>", *([f"`{decoded}` string"] if decoded else [])]
    return arrow_map(source, _encoder(path, len(rest), rest, out, decoded), ", ".join([*fields, *made]))


def _decoder(path: str, at: int, names: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array(vocabulary(path).pieces, dtype=object)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = part.column(at)
                texts = decode_all(pieces, [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in ids])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t if x.is_valid else None for t, x in zip(texts, ids, strict=True)], pa.string())], [*names, out])

    return run


def bpe_decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded text of the ids; special tokens are spelled out, bytes that are no UTF-8 become U+FFFD. Null ids: null."""
    source = tokens.drop(out)
    at = source.columns.index(ids)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    return arrow_map(source, _decoder(path, at, source.columns, out), ", ".join([*fields, f"`{out}` string"]))


def id_digest(ids: str = "ids"):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
