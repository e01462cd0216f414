"""Quality rules: text statistics, and decision lists learned from labels by sequential covering.

Statistics come from one pass over whole texts. A decision list is a sequence of conjunctions of thresholds,
each grown on two thirds of the labelled rows by information gain and pruned on the rest; a row that a rule
covers is rejected. The list is applied as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .workspace import arrow_map

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines"]
STAT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)

_IS = {k: np.zeros(256, bool) for k in ("symbol", "upper", "mark", "digit")}
_IS["symbol"][list(SYMBOLS)] = True
_IS["upper"][65:91] = True
_IS["mark"][[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_IS["digit"][48:58] = True
_STARTS_CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def chunk_stats(chunk: tn.Chunk) -> dict[str, np.ndarray]:
    """The COUNTS of each document of a chunk."""
    data, offs = chunk.data, chunk.offsets
    starts, ends, of_doc = chunk.words()
    out = {"n_words": np.diff(of_doc), "word_chars": tn.sums_between(_STARTS_CODE_POINT[data] & tn.IS_WORD[data], offs)}
    for name, kind in (("n_symbols", "symbol"), ("n_upper", "upper"), ("n_marks", "mark"), ("n_digits", "digit")):
        out[name] = tn.sums_between(_IS[kind][data], offs)
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offs[:-1], breaks + 1])
    line_docs = np.concatenate([np.arange(chunk.n), np.searchsorted(offs, breaks, side="right") - 1])
    order = np.lexsort((line_starts, line_docs))
    line_starts, line_docs = line_starts[order], line_docs[order]
    line_ends = np.concatenate([line_starts[1:] - 1, [0]])
    last = np.concatenate([line_docs[1:] != line_docs[:-1], [True]])
    line_ends[last] = offs[line_docs[last] + 1]
    out["n_lines"] = np.bincount(line_docs, minlength=chunk.n)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = tn.span_hashes(data, line_starts, line_ends)
    words = tn.span_hashes(data, starts, ends)
    del starts, ends
    windows = tn.window_hashes(words, 3)
    del words
    line_cuts = np.searchsorted(line_docs, np.arange(chunk.n + 1))
    dup, repeat = np.zeros(chunk.n, np.int64), np.zeros(chunk.n, np.int64)
    for i in range(chunk.n):
        own = lines[line_cuts[i] : line_cuts[i + 1]][worded[line_cuts[i] : line_cuts[i + 1]]]
        if len(own) > 1:
            dup[i] = len(own) - len(np.unique(own))
        a, b = of_doc[i], of_doc[i + 1]
        if b - a > 3:
            w = windows[a : b - 2]
            by = np.argsort(w, kind="stable")
            ordered = w[by]
            same = ordered[1:] == ordered[:-1]
            del ordered
            if same.any():
                twice = np.zeros(len(w), bool)
                twice[by[1:][same]] = True
                twice[by[:-1][same]] = True
                covered = np.zeros(b - a, bool)
                for k in range(3):
                    covered[k : k + len(w)] |= twice
                repeat[i] = covered.sum()
    out["n_dup_lines"], out["n_repeat_words"] = dup, repeat
    return out


def text_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all but those named like a count) with the COUNTS of the text; null counts as empty."""
    names = [c for c in docs.columns if c not in COUNTS] if keep is None else keep
    source = docs.select(*names, *([] if text in names else [F.col(text).alias("__text")]))
    at = names.index(text) if text in names else len(names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tn.string_chunks(batch.column(at)):
                stats = chunk_stats(chunk)
                part = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *[pa.array(stats[c], pa.int64()) for c in COUNTS]], [*names, *COUNTS])

    return arrow_map(source, run, f"{schema}, {STAT_SCHEMA}" if schema else STAT_SCHEMA)


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


#: Features that rules may test: name and (numerator, denominator) of the counts; a denominator of 0 counts as 1.
FEATURES: dict[str, tuple[str, str]] = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "words": ("n_words", ""),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if not bottom else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def feature_values(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: counts[a].astype(float) / (np.maximum(counts[b], 1) if b else 1) for k, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def column(self) -> Column:
        return feature(self.name) > self.threshold if self.above else feature(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, thresholds: dict[str, np.ndarray], most: int) -> Rule:
    rule: Rule = ()
    hit = np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        if n == 0 or p == 0:
            break
        now, best, pick = math.log2(p / (p + n)), 0.0, None
        for name, cuts in thresholds.items():
            where = np.searchsorted(cuts, x[name][hit], side="left")  # cuts below the value
            ps = np.bincount(where[bad[hit]], minlength=len(cuts) + 1).cumsum()[:-1]  # bad rows at or below each cut
            ns = np.bincount(where[~bad[hit]], minlength=len(cuts) + 1).cumsum()[:-1]
            for above, pp, nn in ((False, ps, ns), (True, p - ps, n - ns)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - now), 0)
                if len(gain) and gain.max() > best + 1e-9:
                    best, pick = float(gain.max()), Condition(name, above, float(cuts[int(gain.argmax())]))
        if pick is None:
            break
        seen = x[pick.name][hit]  # the threshold goes to the middle of the gap that it lies in
        middle = (seen[seen <= pick.threshold].max() + seen[seen > pick.threshold].min()) / 2
        pick = Condition(pick.name, pick.above, float(middle))
        rule, hit = (*rule, pick), hit & pick.holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covers(rule, x, len(bad))
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9, least_cover: int = 3, n_cuts: int = 64) -> list[Rule]:
    """Sequential covering: each rule is grown where ``fold`` is false, pruned from its end where it is true, and kept while it is
    precise enough on both together; its rows leave before the next. Deterministic; no rule from labels of one kind."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    thresholds = {}
    for name, v in x.items():
        u = np.unique(v)
        if len(u) > 1:
            mids = (u[1:] + u[:-1]) / 2
            thresholds[name] = mids if len(mids) <= n_cuts else np.unique(mids[np.linspace(0, len(mids) - 1, n_cuts).astype(int)])
            # quantiles of the bad rows as well, where thresholds matter
            if bad.any():
                thresholds[name] = np.unique(np.concatenate([thresholds[name], np.quantile(v[bad], np.linspace(0, 1, n_cuts)), np.quantile(v[~bad], np.linspace(0, 1, n_cuts)) if (~bad).any() else []]))
    sub = lambda keep: ({k: v[keep] for k, v in x.items()}, bad[keep])
    while len(rules) < most_rules and bad[left].any():
        gx, gb = sub(left & ~fold)
        rule = _grow(gx, gb, thresholds, most_conditions)
        if not rule:
            break
        px, pb = sub(left & fold)
        if pb.any():
            rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, px, pb))
        ax, ab = sub(left)
        hit = covers(rule, ax, len(ab))
        if hit.sum() < least_cover or ab[hit].mean() < least_precision:
            break
        rules.append(rule)
        left[np.flatnonzero(left)[hit]] = False
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression: false where the first rule that covers the row rejects it, true where none does."""
    expr = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        expr = F.when(test, F.lit(False)) if expr is None else expr.when(test, F.lit(False))
    return F.lit(True) if expr is None else expr.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", label: str = "quality", **options) -> list[Rule]:
    """A decision list from the statistics of labelled rows: at most ``max_rows`` of them, those with the lowest hash of the id, go to the driver."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = stats.withColumnRenamed(doc_id, "__sid").join(F.broadcast(sample), F.col("__id") == F.col("__sid")).filter(~base_failed())
    rows = rows.select("__id", "__label", (F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(3)) == 0).alias("__fold"), *COUNTS)
    got = rows.toArrow().sort_by("__id")
    counts = {c: got[c].to_numpy() for c in COUNTS}
    return learn_list(feature_values(counts), got["__label"].to_numpy() == 0, got["__fold"].to_numpy(zero_copy_only=False).astype(bool), **options)


def learn_from(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_rows: int = 20_000) -> list[Rule]:
    """The decision list of a labelled sample of ``docs``; only the sample's texts are counted."""
    bare = docs.select(F.col(doc_id), F.col(text).alias("text"))
    known = labels.filter(F.col("quality").isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id)).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(max_rows)
    sample = bare.join(F.broadcast(known), doc_id, "left_semi")  # at most max_rows ids
    return fit(text_stats(sample, keep=[doc_id]), labels, max_rows, doc_id)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_rows: int = 20_000) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept for every row of ``docs``.

    Null or empty texts have no words and fail the base rules, as do all of fewer than 50 words. Repeated rows are judged alike.
    Without labels (or labels of one kind) the list is empty and only the base rules reject. Only the labelled sample's texts
    are read to learn; every text is read to be judged. An empty table gives an empty result."""
    rules = learn_from(docs, labels, doc_id, text, max_rows)
    stats = text_stats(docs.select(F.col(doc_id), F.col(text).alias("text")), keep=[doc_id])
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass the base rules and the list, in one pass and without a join. Columns named like a count are lost."""
    return text_stats(docs, text).filter(~base_failed() & verdict(rules)).drop(*COUNTS)
