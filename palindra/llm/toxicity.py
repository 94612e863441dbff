"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, drops accents, maps homoglyphs to Latin letters, undoes digit and sign
substitutions and turns all else into single spaces; a word of letters and digits is read both with
and without its digits. The lexicon holds whole words
and word beginnings with log-odds weights learnt from labelled documents; phrases in which a term is
harmless are matched in the same pass and cancel it. A logistic model of the summed weights and of
the weights per word gives the score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sampling, storage, text

THRESHOLD = 0.7
LEAST_ODDS = 1.5
#: nats by which a term must separate the labels beyond what the best of all terms tested does by chance
MARGIN = 4.0
BEGINNINGS = (4, 5, 6, 7)
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l", "ß": "ss", "ø": "o", "ł": "l", "đ": "d"}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}


class _Letters(dict):
    """Lazily filled table for str.translate: any character to its folded form."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = ""
        if unicodedata.category(c) not in ("Cf", "Mn"):
            for x in unicodedata.normalize("NFKD", c).lower():
                x = HOMOGLYPHS.get(x, x)
                out += x if x.isalnum() or c in SUBSTITUTES else "" if unicodedata.category(x[0]) == "Mn" else " "
        self[code] = out
        return out


_LETTERS = _Letters()


def fold(value: str) -> str:
    """Words of folded letters with one space before, between and after them.

    A word of which at most a third are letters is first taken for no disguised word and loses the rest.
    """
    return _readings(value)[0]


def _readings(value: str) -> tuple[str, str]:
    """(the folded text, other readings of its words that mix letters with digits or signs, each after a bar).

    Such a word may be a disguise or not: it is read with its digits and signs as letters and without them.
    """
    out, other = [], []
    for w in value.translate(_LETTERS).split():
        if w.isalpha():
            out.append(w)
            continue
        core = w.strip("!|$@")
        letters = sum(c.isalpha() for c in core)
        if letters:
            # signs at the ends may be punctuation or letters
            undone, whole = ("".join(SUBSTITUTES.get(c, c if c.isalnum() else "") for c in x) for x in (core, w))
            bare = "".join(c for c in core if c.isalpha())
            out.append(undone if letters * 3 > len(core) else bare)
            other += sorted({undone, whole, bare} - {out[-1]})
    return f" {' '.join(out)} ", "".join(f"| {w} " for w in other)


def training_row(doc_id: Column) -> Column:
    """True where a document may be learnt from: crc32 of its id's text leaves a remainder other than 1.

    A null id counts as one, though no label can name it.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(True))


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """(term, clean, toxic, clean_hits, toxic_hits) of rows (text, label): documents and occurrences by label.

    ``terms_of()`` gives a function from folded words to a Counter; tasks count, Spark sums.
    """
    sums = ("clean", "toxic", "clean_hits", "toxic_hits")

    def count(batches) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        of = terms_of()
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                y = int(y > 0)
                for term, n in of(fold(t or "").split()).items():
                    own = seen.setdefault(term, [0, 0, 0, 0])
                    own[y] += 1
                    own[2 + y] += n
        if seen:
            columns = zip(*seen.values())
            yield pa.RecordBatch.from_pydict({"term": list(seen), **{c: pa.array(v, pa.int64()) for c, v in zip(sums, columns)}})

    return rows.mapInArrow(count, f"term string, {', '.join(f'{c} long' for c in sums)}").groupBy("term").agg(*(F.sum(c).alias(c) for c in sums))


def _gain(base: Column | float) -> Column:
    """Nats by which splitting the documents on a term explains their labels better than the share ``base`` does."""
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    return F.when(F.col("toxic") > 0, F.col("toxic") * F.log(rate / base)).otherwise(0) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - base))).otherwise(0)


def learn_terms(sample: DataFrame) -> dict[str, float | None]:
    """Terms with weights from a bounded sample (text, label): ' word ' or ' beginning'; exception phrases have None.

    A weight is the log ratio of a term's occurrences per word in toxic and in other documents. A term
    must separate the documents by more than the logarithm of the number of terms tested, which the
    best of as many useless ones would do by chance, and ``MARGIN`` nats, at any size of the sample. No word
    is taken for a term without such evidence, so a sample with few toxic documents gives none. A phrase of a term and a neighbouring word is an exception if it lies in clean documents by as much
    more than the term alone.
    """

    def every():
        def of(words: list[str]) -> Counter:
            terms = Counter(f" {w} " for w in words if len(w) > 2)
            for w in words:
                terms.update(f" {w[:k]}" for k in BEGINNINGS if len(w) > k)
            terms[""] = len(words)
            return terms

        return of

    rows = sample.dropDuplicates(["text", "label"]).select("text", "label")
    counts = _counted(rows, every)
    n = counts.where("term = ''").first()
    if n is None or not n.toxic or not n.clean:
        return {}
    base = n.toxic / (n.clean + n.toxic)
    odds = F.log((F.col("toxic_hits") + 0.5) / (n.toxic_hits + 1)) - F.log((F.col("clean_hits") + 0.5) / (n.clean_hits + 1))
    tested = storage.materialize(counts.where(f"term <> '' AND toxic >= 2 AND toxic > {base} * (clean + toxic)").select("term", "toxic", "clean", _gain(base).alias("gain"), odds.alias("odds")), "toxicity-terms")
    least = math.log(max(1, tested.count())) + MARGIN
    found = tested.where(f"gain >= {least} AND odds >= {LEAST_ODDS}").collect()  # of a bounded sample
    seen = {r.term: (r.toxic, r.odds) for r in found}
    longest: dict[str, int] = {}
    for t, (k, _) in seen.items():
        for size in BEGINNINGS:
            if size + 1 < len(t):
                longest[t[: size + 1]] = max(k, longest.get(t[: size + 1], 0))
    # a beginning stays if it stands for more than its commonest continuation; a term that adds nothing to its beginning goes
    kept = {t: w for t, (k, w) in seen.items() if t.endswith(" ") or k > 1.1 * longest.get(t, 0)}
    kept = {t: w for t, w in kept.items() if not any(kept.get(t[: k + 1], -1) >= w - 1 for k in BEGINNINGS if k + 1 < len(t))}
    return kept | dict.fromkeys(_learn_exceptions(rows, kept))


def _learn_exceptions(rows: DataFrame, terms: dict[str, float]) -> list[str]:
    """Phrases of a term and the word before or after it that make it harmless."""

    def phrases():
        lexicon = Lexicon(terms)

        def of(words: list[str]) -> Counter:
            hit = [bool(lexicon.matches(f" {w} ")) for w in words]
            near = Counter(f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x != y)
            near[""] = any(hit)
            return near

        return of

    if not terms:
        return []
    counts = _counted(rows, phrases).where("clean + toxic >= 2")
    counts = storage.materialize(counts, "toxicity-phrases")
    whole = counts.where("term = ''").first()  # its hits are the documents with a term
    if whole is None or not whole.toxic_hits or not whole.clean_hits:
        return []
    rate = whole.toxic_hits / (whole.toxic_hits + whole.clean_hits)
    tested = counts.where(f"term <> '' AND toxic < {rate} * (clean + toxic)")
    least = math.log(max(1, tested.count())) + MARGIN
    return [r.term for r in tested.where(_gain(rate) >= least).select("term").collect()]  # of a bounded sample


class Lexicon:
    """The automaton over terms and exception phrases; built once a task."""

    def __init__(self, terms: dict[str, float | None], exceptions: tuple[str, ...] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(t, (len(t), w))
        for e in exceptions:
            if (phrase := fold(e)).strip():
                self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[float]:
        """The weight of the strongest term at each place of a folded text, without what lies in an exception phrase."""
        if self.empty:
            return []
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        if not free:
            return list(best.values())
        # phrases may overlap: their union, in order
        begins, ends = (np.array(x) for x in zip(*sorted(free)))
        ends = np.maximum.accumulate(ends)
        places = np.array(list(best))
        at = np.searchsorted(begins, places, "right") - 1
        return [w for w, p, k in zip(best.values(), places, at) if k < 0 or p >= ends[k]]

    def features(self, value: str) -> tuple[float, float]:
        """(summed weights, weights per hundred words and 50 more)."""
        if self.empty:
            return 0.0, 0.0
        folded, other = _readings(value)
        total = float(sum(self.matches(folded + other)))
        return total, 100 * total / (49 + folded.count(" "))


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic model of the squashed features, by Newton's method."""
    x, y = squash(features), labels.astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) / max(1, len(y)) * np.eye(len(w))
        w += np.clip(np.linalg.solve(hess, x.T @ (y - p) - ridge * w), -4, 4)
    return [float(v) for v in w]


def squash(features: np.ndarray) -> np.ndarray:
    """Bounded and logarithmic forms of the summed weights and of the weights per hundred words."""
    total, share = features[:, 0], features[:, 1]
    return np.column_stack([np.ones(len(features)), 1 - np.exp(-total / 4), np.log1p(total), 1 - np.exp(-share), np.log1p(share)])


def model(docs: DataFrame, labels: DataFrame, most: int = sampling.SAMPLE) -> tuple[dict[str, float | None], list[float]]:
    """(terms, weights) learnt from about ``most`` labelled training rows at most (see ``training_row``)."""
    sample = sampling.labelled(docs, labels, "toxic", most, training_row(F.col("doc_id")))
    sample = storage.materialize(sample, "toxicity-sample")
    terms = learn_terms(sample)

    def measure(batches) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for b in batches:
            rows = [lexicon.features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), b.column("label").cast(pa.int64())], names=["total", "share", "label"])

    rows = sample.mapInArrow(measure, "total double, share double, label long").toPandas()
    if not rows["label"].gt(0).any():
        return terms, [-4.0, 0.0, 0.0, 0.0, 0.0]
    return terms, fit(rows[["total", "share"]].to_numpy(), rows["label"].gt(0).to_numpy())


def scored(docs: DataFrame, terms: dict[str, float | None], weights: list[float], exceptions: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with a column score (0 to 1) of every whole text; null is empty and scores the base rate."""
    columns = [c for c in docs.columns if c != "score"]

    def score(batches) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, exceptions)
        for b in text.blocks(batches, "text"):
            x = np.array([lexicon.features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-squash(x) @ np.array(weights)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(p)], names=[*columns, "score"])

    schema = docs.select(columns).schema.add("score", "double")
    return docs.select(columns).mapInArrow(score, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    terms, weights = model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, terms, weights)
    return out.select("doc_id", (~training_row(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
