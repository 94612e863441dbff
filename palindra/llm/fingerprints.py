"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction.

A sketch of a document's five-word shingles holds all hashes in the lowest ``1/SCALE`` of the hash
range, whatever the document's size. It is written as "n:digest:limit:hashes": the number of distinct
shingles, a sum that names the whole set, the limit below which all hashes are held, and the hashes
in base 64. Two sketches are compared below the smaller of their limits, which gives the likeness and
the containment of very unequal documents too, and the union of two sketches is the sketch of the union.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import ordering, text

SIZE = 5
SCALE = 2
#: Hashes are of six bytes: among 10**8 shingles a foreign one is found with a probability below 10**-6.
_BITS = 48
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_in_edited double, held_in_next double"


@dataclass
class Sketch:
    """``hashes`` ascending: all shingle hashes below ``limit``.

    ``n`` counts the distinct shingles and ``digest`` names their set; of a union n is a lower bound
    and the digest is 0, unknown.
    """

    n: int
    digest: int
    limit: int
    hashes: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, scale: int = SCALE) -> Sketch:
        """The sketch of ascending distinct 64-bit shingle hashes."""
        short, limit = hashes >> np.uint64(64 - _BITS), (1 << _BITS) // scale
        return Sketch(len(hashes), int(hashes.sum(dtype=np.uint64)), limit, np.unique(short[: np.searchsorted(short, np.uint64(limit))]))

    def text(self) -> str:
        """The written form; :meth:`parse` gives the same sketch, of unions too."""
        six = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        return f"{self.n}:{self.digest:x}:{self.limit:x}:{base64.b64encode(six.tobytes()).decode()}"

    @staticmethod
    def parse(value: str) -> Sketch:
        n, digest, limit, digits = value.split(":")
        six = np.frombuffer(base64.b64decode(digits), np.uint8).reshape(-1, 6)
        eight = np.zeros((len(six), 8), np.uint8)
        eight[:, 2:] = six
        return Sketch(int(n), int(digest, 16), int(limit, 16), eight.view(">u8").ravel().astype(np.uint64))

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both documents' shingles together."""
        limit = min(self.limit, other.limit)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(max(self.n, other.n), 0, limit, both[both < np.uint64(limit)])

    def compare(self, other: Sketch) -> tuple[float, float]:
        """(likeness, containment of this one in the other).

        Sets of one digest are equal, empty ones too; of others that have no hash below the limit nothing is known, which counts as 0.
        """
        if self.n == other.n and self.digest == other.digest and (self.digest or not self.n):
            return 1.0, 1.0
        limit = np.uint64(min(self.limit, other.limit))
        a, b = (s.hashes[: np.searchsorted(s.hashes, limit)] for s in (self, other))
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common / max(1, len(a) + len(b) - common), common / max(1, len(a))


def sketches(texts: pa.Array, size: int = SIZE, scale: int = SCALE) -> list[Sketch]:
    """A sketch of every text; null and wordless texts have an empty one."""
    hashes, first = text.shingles(text.words(texts), size)
    out = []
    for d in range(len(first) - 1):
        own = np.sort(hashes[first[d] : first[d + 1]])
        out.append(Sketch.of(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own, scale))
    return out


def edited(value: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the beginning of the next text."""
    half = len(value) // 2
    return value[: len(value) - half] + following[:half]


def compare_with_next(docs: DataFrame, size: int = SIZE, scale: int = SCALE, partitions: int | None = None) -> DataFrame:
    """Per row of ``docs``: fingerprints of its text and of its edited text, and their likeness.

    The next document is the next row by ascending doc_id (a null first, equal ids by text), after
    the last the first; a single document follows itself. Null texts are empty; empty tables give no
    rows; other columns are not read. The texts are shuffled once, into ranges of doc_id.
    """
    rows = docs.select("doc_id", "text")
    n = partitions or max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def walk(batches) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose follower is still to come, with its sketch
        for block in text.blocks(batches, "text"):
            made = sketches(block.column("text"), size, scale)
            rows_ = list(zip(block.column("doc_id").to_pylist(), (t or "" for t in block.column("text").to_pylist()), made, block.column("range").to_pylist(), block.column("tail").to_pylist()))
            pairs = []
            for row in rows_:
                if held is not None and held[3] == row[3]:
                    pairs.append((held, row))
                held = None if row[4] else row
            changed = [edited(a[1], b[1]) for a, b in pairs]
            out = []
            for (a, b), e, s in zip(pairs, changed, sketches(pa.array(changed, pa.string()), size, scale)):
                near, held_in = a[2].compare(s)
                near_next, held_in_next = a[2].compare(b[2])
                out.append((a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), a[2].text(), s.text(), near, near_next, held_in, held_in_next))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *(pa.float64(),) * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return ordering.with_followers(rows, "doc_id", n).mapInArrow(walk, COLUMNS)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
