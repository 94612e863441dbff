"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are fitted here on a bounded sample of labelled rows, with monotonic constraints on the
statistics whose direction is known, and flattened into node arrays; a block of documents is scored
by stepping all rows through all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sampling, text

WINDOW = 5
KEEP_AT = 0.5
#: Statistics in model order, and +1 or -1 where quality may only rise or fall with them.
FEATURES = (("log_words", 0), ("word_length", 0), ("symbol_share", -1), ("symbols_a_word", -1), ("dup_line_share", -1), ("repeat_share", -1), ("distinct_share", 0), ("upper_share", -1), ("digit_share", 0), ("sign_share", -1), ("letter_share", 1), ("bar_words", -1), ("bang_words", -1), ("line_words", 0), ("top_word_share", -1))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL, _UPPER, _DIGIT, _ALPHA, _SIGN = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(mask)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def repeat_words(codes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of every text that lie in a ``window``-word sequence found twice or more in that text."""
    n = len(codes)
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    covered = np.zeros(n + 1, np.int64)
    if n >= window:
        c = text.odd_constants(window + 1, 11)
        h = text.mix(codes.astype(np.uint64) + np.uint64(1))
        key = texts[: n - window + 1].astype(np.uint64) * c[window]
        for k in range(window):
            key = key + h[k : n - window + 1 + k] * c[k]
        key = text.mix(key)
        whole = np.flatnonzero(texts[: n - window + 1] == texts[window - 1 :])
        _, inverse, counts = np.unique(key[whole], return_inverse=True, return_counts=True)
        hit = whole[counts[inverse] > 1]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    return _sums(np.cumsum(covered)[:-1] > 0, first)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(base columns, features): one value or row a text. Null counts as empty."""
    w = text.words(texts)
    data, offsets, n = w.data, w.offsets, w.counts
    lead = np.concatenate([[0], np.cumsum(_LEAD[data])])
    chars = np.concatenate([[0], np.cumsum(lead[w.ends] - lead[w.starts])])
    word_chars = chars[w.first[1:]] - chars[w.first[:-1]]
    symbols = _sums(_SYMBOL[data], offsets)
    starts, ends = text.runs(data, offsets, data != 10)
    lines = text.strings(data, starts, ends).dictionary_encode() if len(starts) else pa.array([], pa.string()).dictionary_encode()
    words_upto = np.searchsorted(w.starts, np.stack([starts, ends])) if len(starts) else np.zeros((2, 0), np.int64)
    full = words_upto[1] > words_upto[0]
    owner = (np.searchsorted(offsets, starts, "right") - 1)[full]
    key = owner * np.int64(len(lines.dictionary) + 1) + lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    _, at = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[at] = False
    dup_lines, n_lines = (np.bincount(owner, weights, len(n)).astype(np.int64) for weights in (again, np.ones(len(key))))
    repeats = repeat_words(w.codes, w.first)
    pairs = w.texts * np.int64(len(w.vocabulary) + 1) + w.codes
    kinds, counts = np.unique(pairs, return_counts=True)
    whose = kinds // np.int64(len(w.vocabulary) + 1)
    distinct, top = np.bincount(whose, minlength=len(n)), np.zeros(len(n), np.int64)
    np.maximum.at(top, whose, counts)
    last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    bang, bar = last == ord("!"), (last == ord("|")) & (w.ends - w.starts == 1)
    some, size, letters = np.maximum(n, 1), np.maximum(word_chars, 1), _sums(_ALPHA[data], offsets)
    base = {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats}
    values = [np.log1p(n), word_chars / some, symbols / size, symbols / some, dup_lines / np.maximum(n_lines, 1), repeats / some, distinct / some, _sums(_UPPER[data], offsets) / np.maximum(letters, 1), _sums(_DIGIT[data], offsets) / size, _sums(_SIGN[data], offsets) / size, letters / np.maximum(np.diff(offsets), 1), _sums(bar, w.first) / some, _sums(bang, w.first) / some, np.log1p(n / np.maximum(n_lines, 1)), top / some]
    return base, np.column_stack(values).astype(float)


@dataclass
class Trees:
    """All trees in flat arrays; an inner node's children are ``left`` and ``left + 1``, a leaf's ``left`` is 0."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        while (self.left[node] > 0).any():
            right = x[rows, self.feature[node]] > self.cut[node]
            node = np.where(self.left[node] > 0, self.left[node] + right, node)
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = tuple(s for _, s in FEATURES), trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0, ridge: float = 2.0) -> Trees:
    """Boosted histogram trees for the logistic loss.

    A split on a signed feature is taken only if its children's values are ordered by the sign, and
    their midpoint bounds what lies below, so the whole score is monotone in that feature.
    """
    rows, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)] if rows else [np.zeros(0)] * width
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]) if rows else np.zeros((0, width), int)
    share = min(max(float(y.mean()) if rows else 0.5, 0.01), 0.99)
    base = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [], [], [], [], []
    margin = np.full(rows, base)

    def node() -> int:
        for column in (feature, cut, left, value):
            column.append(0)
        return len(feature) - 1

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(min(max(-g / (h + ridge), low), high))

    for _ in range(trees if rows else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        work = [(roots[-1], np.arange(rows), 0, -np.inf, np.inf)]
        while work:
            at, own, level, low, high = work.pop()
            g, h = grad[own].sum(), hess[own].sum()
            value[at] = rate * weight(g, h, low, high)
            best = (1e-3, None)
            for f in range(width) if level < depth else ():
                if not len(cuts[f]):
                    continue
                gl, hl = (np.cumsum(np.bincount(binned[own, f], v[own], len(cuts[f]) + 1))[:-1] for v in (grad, hess))
                gr, hr = g - gl, h - hl
                vl, vr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
                bad = (hl < least) | (hr < least) | (signs[f] * (vr - vl) < 0)
                own_value = weight(g, h, low, high)
                gain = np.where(bad, -np.inf, gain + g * own_value + 0.5 * (h + ridge) * own_value**2)
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (gain[b], (f, b, vl[b], vr[b]))
            if best[1] is None:
                margin[own] += value[at]
                continue
            f, b, vl, vr = best[1]
            feature[at], cut[at], left[at] = f, cuts[f][b], node()
            node()
            goes = binned[own, f] > b
            mid = (vl + vr) / 2
            bounds = ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid)) if signs[f] < 0 else ((low, high), (low, high))
            for k, rows_k in enumerate((own[~goes], own[goes])):
                work.append((left[at] + k, rows_k, level + 1, *bounds[k]))
    return Trees(np.array(feature, int), np.array(cut, float), np.array(left, int), np.array(value, float), np.array(roots, int), base)


def model(docs: DataFrame, labels: DataFrame, most: int = sampling.SAMPLE) -> Trees:
    """Trees fitted on about ``most`` labelled rows at most; without labels they keep everything."""
    sample = sampling.labelled(docs, labels, "quality", most)

    def measure(batches) -> Iterator[pa.RecordBatch]:
        for b in text.blocks(batches, "text"):
            x = statistics(b.column("text"))[1]
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), b.column("label").cast(pa.int64()), b.column("doc_id").cast(pa.int64())], names=["x", "label", "doc_id"])

    rows = sample.mapInArrow(measure, "x array<double>, label long, doc_id long").toPandas().sort_values("doc_id")
    if not len(rows):
        return Trees(*(np.zeros(0, t) for t in (int, float, int, float, int)), base=10.0)
    return fit(np.stack(rows["x"].to_numpy()), rows["label"].gt(0).to_numpy().astype(float))


def judged(docs: DataFrame, trees: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, base columns, base_failed, quality_score, kept) for every row.

    A document fails the base rules with fewer than 10 words or more than 20 % of its words in
    repeated windows; null and empty texts therefore fail. Equal texts are judged alike.
    """

    def judge(batches) -> Iterator[pa.RecordBatch]:
        for b in text.blocks(batches, "text"):
            base, x = statistics(b.column("text"))
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            p = trees.probability(x) if len(trees.roots) else np.full(len(x), 1 / (1 + np.exp(-trees.base)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(base[c].astype(np.int64)) for c in BASE), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))], names=["doc_id", *BASE, "base_failed", "quality_score", "kept"])

    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, quality_score double, kept boolean"
    return docs.mapInArrow(judge, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
