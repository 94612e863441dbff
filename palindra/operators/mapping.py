"""Peptides on proteins: one scan for the places of wanted seeds, verification by seed, coverage and target-decoy tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palindra.operators.lineage import once

SEED = 8
#: Letters that a place carries along at most; longer peptides are verified on their proteins.
AHEAD = 32
#: Marks of the seeds of one length, and the multiplier that spreads them.
SLOTS, _STEP = 1 << 20, 40503
#: Letters A to Z of the longest peptides that have a mark each, so that a marked place needs no other look; 26^4 is below ``SLOTS``.
EXACT = 4
#: Letters of proteins that are looked at together.
_LETTERS = 1 << 20


def _slot(seed: Column) -> Column:
    """The mark of a seed by its letters' code points; seeds of other lengths have marks of their own."""
    n = F.length(seed)
    return F.aggregate(F.sequence(F.lit(1), n), n.cast("long"), lambda acc, at: (acc * _STEP + F.ascii(F.substr(seed, at, F.lit(1)))).bitwiseAND(F.lit(SLOTS - 1).cast("long")))


def marks(wanted: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """(by length of seed, which of ``SLOTS`` marks are wanted; the most letters of a peptide), from (sequence, seed).

    Spark sets the bits, so one map of ``SLOTS`` bits a length of seed comes to the driver, however many seeds there are.
    """
    return _bits(wanted, _slot(F.col("seed")))


def _code(short: Column) -> Column:
    """The mark of up to ``EXACT`` letters A to Z, which no others of that length have."""
    return F.aggregate(F.sequence(F.lit(1), F.length(short)), F.lit(0).cast("long"), lambda acc, at: acc * 26 + F.ascii(F.substr(short, at, F.lit(1))) - ord("A"))


def _bits(wanted: DataFrame, mark: Column) -> tuple[dict[int, np.ndarray], int]:
    return _bitmaps(wanted.select(F.length("seed").alias("size"), mark.alias("mark"), F.length("sequence").alias("most")))


def _bitmaps(rows: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """(by size, which of ``SLOTS`` marks rows (size, mark, most) have; the greatest ``most``)."""
    slot = F.col("mark") + 1
    rows = rows.select("size", F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"), "most")
    found = rows.groupBy("size", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"), F.max("most").alias("most")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little").view(bool)
        out.setdefault(r["size"], np.zeros(SLOTS, bool))[(r.bucket - 1) * len(bits) : r.bucket * len(bits)] = bits
    return out, max((r.most for r in found), default=0)


def _blocks(batches) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, texts) of proteins that are looked at together."""
    for b in batches:
        texts = b.column("seq").to_pylist()
        low = 0
        while low < len(texts):
            high, letters = low, 0
            while high < len(texts) and (high == low or letters + len(texts[high]) <= _LETTERS):
                letters += len(texts[high])
                high += 1
            yield b.slice(low, high - low), texts[low:high]
            low = high


def _marked(texts: list[str], wanted: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(letters, places in the joined texts, numbers of their texts, marks) of wanted peptides that have a mark each, by their length."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) - ord("A")
    known = (codes >= 0) & (codes < 26)
    ends = np.cumsum([len(t) for t in texts])
    for size, marked in wanted.items():
        n = len(codes) - size + 1
        if n <= 0:
            continue
        code, good = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(size):
            code = code * 26 + codes[j : j + n]
            good &= known[j : j + n]
        at = np.flatnonzero(good)
        at = at[marked[code[at]]]
        owner = np.searchsorted(ends, at, "right")
        inside = at + size <= ends[owner]
        at, owner = at[inside], owner[inside]
        yield size, at, owner, code[at]


def marked_places(proteins: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """(sequence, protein_id, start, end) of the places of short peptides that have a mark each (:func:`_code`): a scan without a shuffle."""
    shared = proteins.sparkSession.sparkContext.broadcast(wanted)  # a fixed number of bits

    def found(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        for size, at, owner, code in _marked(texts, shared.value):
            each, which = np.unique(code, return_inverse=True)
            names = pa.array(["".join(chr(ord("A") + int(c) // 26**j % 26) for j in range(size - 1, -1, -1)) for c in each], pa.string())
            start = (at - begins[owner]).astype(np.int32)
            for low in range(0, len(at), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which[part])), ids.take(pa.array(owner[part])), pa.array(start[part]), pa.array(start[part] + np.int32(size))], names=["sequence", "protein_id", "start", "end"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches):
            yield from found(rows.column("protein_id"), texts)

    kind = proteins.schema["protein_id"].dataType.simpleString()
    return proteins.select("protein_id", "seq").where("seq <> ''").mapInArrow(run, f"sequence string, protein_id {kind}, start int, end int")


def seeded(proteins: DataFrame, wanted: dict[int, np.ndarray], ahead: int, k: int = SEED) -> DataFrame:
    """(protein_id, pos, seed, ahead) of the places, from 0, whose first letters bear a wanted mark: one scan, only hits come out.

    Seeds under ``k`` letters are whole peptides and need nothing ahead of them.
    """
    shared = proteins.sparkSession.sparkContext.broadcast(wanted)  # a fixed number of bits

    def found(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        text = "".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        left = ends[owner] - np.arange(len(codes))
        parts: list[tuple[np.ndarray, int]] = []
        for size, marked in shared.value.items():
            n = len(codes) - size + 1
            if n > 0:
                slot = np.full(n, size, np.int64)
                for j in range(size):
                    slot = slot * _STEP + codes[j : j + n] & SLOTS - 1
                parts.append((np.flatnonzero(marked[slot] & (left[:n] >= size)), size))
        at = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in parts)])
        seeds = [text[p : p + size] for places, size in parts for p in places.tolist()]
        reach = np.concatenate([np.zeros(0, np.int64), *(np.minimum(p + ahead, ends[owner[p]]) if size == k else p + size for p, size in parts)])
        whole = [text[p:to] for p, to in zip(at.tolist(), reach.tolist())]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner[at])), pa.array((at - (ends - sizes)[owner[at]]).astype(np.int32)), pa.array(seeds, pa.string()), pa.array(whole, pa.string())], names=["protein_id", "pos", "seed", "ahead"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches):
            yield found(rows.column("protein_id"), texts)

    kind = proteins.schema["protein_id"].dataType.simpleString()
    return proteins.select("protein_id", "seq").where("seq <> ''").mapInArrow(run, f"protein_id {kind}, pos int, seed string, ahead string")


def locate(peptides: DataFrame, proteins: DataFrame, k: int = SEED, salts: int | None = None) -> DataFrame:
    """(sequence, protein_id, start, end) of every occurrence of distinct peptides, end exclusive.

    A peptide's seed is its first ``k`` letters, or all if it is shorter. One scan of the proteins finds the places whose letters bear
    the mark of a wanted seed; only those are shuffled. They meet the peptides of their seed, dealt by seed and place to ``salts`` tasks (by
    default one in sixteen shuffle partitions, 8 at least), so that a common seed is no single task's, and are verified on the letters
    ahead or, beyond ``AHEAD``, on the protein. Equal peptides are searched once; empty ones have no place.

    Peptides of up to ``EXACT`` letters A to Z, which have most places, come out of a scan of their own and are not shuffled.
    """
    exact, found = _searched(peptides, proteins, k, salts)
    places = marked_places(proteins, exact)
    if found is None:
        return places
    return places.union(found) if exact else found


def _searched(peptides: DataFrame, proteins: DataFrame, k: int = SEED, salts: int | None = None) -> tuple[dict[int, np.ndarray], DataFrame | None]:
    """(marks of the peptides that have one each, by length; the places of all others, None if there are none)."""
    asked = peptides.select("sequence").where("sequence <> ''").distinct()
    short = F.col("sequence").rlike(f"\\A[A-Z]{{1,{EXACT}}}\\z")
    exact = _bits(asked.where(short).withColumn("seed", F.col("sequence")), _code(F.col("seed")))[0]
    wanted = asked.where(~short).withColumn("seed", F.substring("sequence", 1, k))
    marked, most = marks(wanted)
    if not marked:
        return exact, None
    salts = salts or max(8, int(proteins.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    hits = seeded(proteins, marked, min(most, AHEAD), k)
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = hits.withColumn("salt", F.pmod("pos", F.lit(salts)).cast("int")).join(salted, ["seed", "salt"])
    found = found.where(F.col("ahead").startswith(F.substring("sequence", 1, AHEAD))).select("sequence", "protein_id", "pos")
    if most > AHEAD:
        found = once(found)
        long = F.length("sequence") > AHEAD
        checked = found.where(long).join(proteins.select("protein_id", "seq"), "protein_id")
        checked = checked.where(F.substr("seq", F.col("pos") + 1, F.length("sequence")) == F.col("sequence")).select("sequence", "protein_id", "pos")
        found = found.where(~long).union(checked)
    return exact, found.select("sequence", "protein_id", F.col("pos").alias("start"), (F.col("pos") + F.length("sequence")).alias("end"))


def with_decoys(proteins: DataFrame) -> DataFrame:
    """Proteins and their reversals, told apart by is_decoy; decoy ids begin with decoy_."""
    own = proteins.select(F.col("protein_id").cast("string").alias("protein_id"), "seq", F.lit(False).alias("is_decoy"))
    return own.union(own.select(F.concat(F.lit("decoy_"), "protein_id"), F.reverse("seq"), F.lit(True)))


def tags(peptides: DataFrame, locations: DataFrame) -> DataFrame:
    """(sequence, tag): T, D, TD or NoMatch, from locations with is_decoy."""
    hit = locations.groupBy("sequence").agg(F.max(~F.col("is_decoy")).alias("t"), F.max("is_decoy").alias("d"))
    both = peptides.select("sequence").distinct().join(hit, "sequence", "left")
    return both.select("sequence", F.when(F.col("t") & F.col("d"), "TD").when(F.col("t"), "T").when(F.col("d"), "D").otherwise("NoMatch").alias("tag"))


def pair_tag(a, b):
    """The tag of a pair: T and T is T, D and D is D, no match of either is NoMatch, else TD."""
    return F.when((a == "NoMatch") | (b == "NoMatch"), "NoMatch").when((a == "T") & (b == "T"), "T").when((a == "D") & (b == "D"), "D").otherwise("TD")


def _alone(proteins: DataFrame, exact: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of peptides that have a mark each, by length, those that stand in one protein only: a table of fixed size a task, no row a place."""
    shared = proteins.sparkSession.sparkContext.broadcast(exact)

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = {size: np.zeros(SLOTS, np.int64) for size in shared.value}
        for _, texts in _blocks(batches):
            for size, _, owner, code in _marked(texts, shared.value):
                seen[size] = np.minimum(seen[size] + np.bincount(np.unique(owner * SLOTS + code) % SLOTS, minlength=SLOTS), 2)
        for size, n in seen.items():
            mark = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mark), size, np.int32)), pa.array(mark), pa.array(n[mark])], names=["size", "mark", "n"])

    rows = proteins.select("seq").where("seq <> ''").mapInArrow(run, "size int, mark long, n long")
    one = rows.groupBy("size", "mark").agg(F.sum("n").alias("n")).where("n = 1")
    return _bitmaps(one.select("size", "mark", F.lit(0).alias("most")))[0]


def _swept(proteins: DataFrame, own: DataFrame | None, make: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``make`` gives for blocks of rows (protein_id, seq, ...) with the columns of ``own``, a row a protein, null where it has none.

    Only proteins that are in ``own`` are shuffled to it, and those few that bear the mark of one; the others pass in the scan.
    """
    rows = proteins.select("protein_id", "seq").where("seq <> '' AND protein_id IS NOT NULL")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block, texts in _blocks(batches):
            yield make(block, texts)

    if own is None:
        return rows.mapInArrow(run, schema)
    own = once(own)
    slot = F.pmod(F.xxhash64("protein_id"), F.lit(SLOTS))
    marked = _bitmaps(own.select(F.lit(0).alias("size"), slot.alias("mark"), F.lit(0).alias("most")))[0].get(0, np.zeros(SLOTS, bool))
    shared = rows.sparkSession.sparkContext.broadcast(marked)  # a fixed number of bits

    def part(wanted: bool, batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value[b.column("_slot").to_numpy()] == wanted)).drop_columns(["_slot"])

    named = rows.withColumn("_slot", slot)
    touched = named.mapInArrow(lambda batches: part(True, batches), rows.schema).join(own, "protein_id", "left")
    return touched.mapInArrow(run, schema).union(named.mapInArrow(lambda batches: run(part(False, batches)), schema))


def _depths(block: pa.RecordBatch, texts: list[str], places: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(how many places cover each letter of the joined texts, lengths of the texts), of short ``places`` and the lists ``spans`` of the rows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    step = np.zeros(sizes.sum() + 1, np.int64)
    for size, at in places:
        step += np.bincount(at, minlength=len(step)) - np.bincount(at + size, minlength=len(step))
    if "spans" in block.schema.names:
        spans = block.column("spans")
        begin = np.repeat(np.cumsum(sizes) - sizes, spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = spans.flatten()
        low, high = (begin + flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        step += np.bincount(low, minlength=len(step)) - np.bincount(high, minlength=len(step))
    return np.cumsum(step)[:-1], sizes


def _repeated_ids(proteins: DataFrame) -> bool:
    return not proteins.groupBy("protein_id").count().where("count > 1").isEmpty()


def peptide_coverage(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """:func:`coverage` of all places of ``peptides``, counted where a protein lies: places of short peptides have no row."""
    if _repeated_ids(proteins):
        return coverage(locate(peptides, proteins), proteins)  # its places lie in several rows
    exact, found = _searched(peptides, proteins)
    shared = proteins.sparkSession.sparkContext.broadcast((exact, _alone(proteins, exact)))
    own = None
    if found is not None:
        found = once(found.where("protein_id IS NOT NULL"))
        per = found.groupBy("sequence").agg((F.min("protein_id") == F.max("protein_id")).alias("alone"))
        each = found.groupBy("sequence", "protein_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(per, "sequence")
        own = each.groupBy("protein_id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sum(F.col("alone").cast("long")).alias("alone"), F.count("*").alias("all"))

    def make(block: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        exact, alone = shared.value
        sums = {c: block.column(c).fill_null(0).to_numpy(zero_copy_only=False).copy() if c in block.schema.names else np.zeros(len(texts), np.int64) for c in ("alone", "all")}
        places = []
        for size, at, owner, code in _marked(texts, exact):
            pairs = np.unique(owner * SLOTS + code)
            sums["all"] += np.bincount(pairs // SLOTS, minlength=len(texts))
            if size in alone:
                sums["alone"] += np.bincount(pairs // SLOTS, alone[size][pairs % SLOTS], len(texts)).astype(np.int64)
            places.append((size, at))
        depth, sizes = _depths(block, texts, places)
        covered = np.add.reduceat((depth > 0).astype(np.int64), np.cumsum(sizes) - sizes)
        out = pa.RecordBatch.from_arrays([block.column("protein_id"), *map(pa.array, (covered, sizes, sums["alone"], sums["all"]))], names=["protein_id", "covered", "total", "n_unique", "n_total"])
        return out.filter(pa.array(sums["all"] > 0))

    kind = proteins.schema["protein_id"].dataType.simpleString()
    out = _swept(proteins, own, make, f"protein_id {kind}, covered long, total long, n_unique long, n_total long")
    return out.select("protein_id", "covered", "total", F.round(F.col("covered") / F.col("total"), 6).alias("rate"), "n_unique", (F.col("n_total") - F.col("n_unique")).alias("n_nonunique"), "n_total")


def peptide_depth(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """:func:`depth` of all places of ``peptides``, counted where a protein lies: places of short peptides have no row."""
    if _repeated_ids(proteins) or not proteins.where("protein_id IS NULL").isEmpty():
        return depth(locate(peptides, proteins))
    exact, found = _searched(peptides, proteins)
    shared = proteins.sparkSession.sparkContext.broadcast(exact)
    own = None if found is None else found.groupBy("protein_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def make(block: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        deep, sizes = _depths(block, texts, ((size, at) for size, at, _, _ in _marked(texts, shared.value)))
        begins = np.cumsum(sizes) - sizes
        new = np.concatenate([[True], deep[1:] != deep[:-1]])
        new[begins] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(deep))
        start, end = start[deep[start] > 0], end[deep[start] > 0]
        owner = np.searchsorted(begins, start, "right") - 1
        columns = [block.column("protein_id").take(pa.array(owner)), pa.array((start - begins[owner]).astype(np.int32)), pa.array((end - begins[owner]).astype(np.int32)), pa.array(deep[start])]
        return pa.RecordBatch.from_arrays(columns, names=["protein_id", "start", "end", "depth"])

    kind = proteins.schema["protein_id"].dataType.simpleString()
    return _swept(proteins, own, make, f"protein_id {kind}, start int, end int, depth long")


def coverage(locations: DataFrame, proteins: DataFrame) -> DataFrame:
    """(protein_id, covered, total, rate, n_unique, n_nonunique, n_total) of proteins with a location.

    Covered residues are the union of the intervals, merged by a running maximum inside each protein;
    unique peptides occur in one protein only. The locations are computed once for all of these.
    """
    locations = once(locations)
    spans = locations.select("protein_id", "start", "end").distinct()
    before = F.max("end").over(W.partitionBy("protein_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    own = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("before", F.lit(0))), F.lit(0))
    covered = spans.withColumn("before", before).groupBy("protein_id").agg(F.sum(own).cast("long").alias("covered"))
    each = locations.select("sequence", "protein_id").distinct()
    shared = each.groupBy("sequence").agg(F.count("*").alias("n"))
    counts = each.join(shared, "sequence").groupBy("protein_id").agg(F.sum((F.col("n") == 1).cast("long")).alias("n_unique"), F.sum((F.col("n") > 1).cast("long")).alias("n_nonunique"), F.count("*").alias("n_total"))
    out = covered.join(counts, "protein_id").join(proteins.select("protein_id", F.length("seq").cast("long").alias("total")), "protein_id")
    return out.select("protein_id", "covered", "total", F.round(F.col("covered") / F.col("total"), 6).alias("rate"), "n_unique", "n_nonunique", "n_total")


def coverage_summary(cover: DataFrame) -> DataFrame:
    """One row: proteins hit, fully covered, residues, and mean, least and greatest rate."""
    return cover.agg(F.count("*").alias("n_proteins"), F.sum((F.col("covered") == F.col("total")).cast("long")).alias("n_full"), F.sum("covered").alias("covered"), F.sum("total").alias("total"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"))


def depth(locations: DataFrame) -> DataFrame:
    """(protein_id, start, end, depth): runs of residues that equally many places cover, end exclusive, without uncovered ones.

    A sweep over where places begin and end: no residue has a row of its own. Repeated rows count each.
    """
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"))))
    events = locations.select("protein_id", ends.alias("x")).groupBy("protein_id", F.col("x.at").alias("start")).agg(F.sum("x.step").alias("step")).where("step <> 0")
    over = W.partitionBy("protein_id").orderBy("start")
    runs = events.withColumns({"end": F.lead("start").over(over), "depth": F.sum("step").over(over.rowsBetween(W.unboundedPreceding, 0))})
    return runs.where("depth > 0").select("protein_id", "start", "end", "depth")


def counts(locations: DataFrame) -> DataFrame:
    """(protein_id, n_unique, n_nonunique, n_total, n_places): peptides of one protein and of several, all, and their places.

    A peptide with several places in a protein counts once; repeated rows count as one place.
    """
    each = once(locations.select("sequence", "protein_id", "start", "end").distinct().groupBy("sequence", "protein_id").agg(F.count("*").alias("places")))
    shared = each.groupBy("sequence").agg(F.count("*").alias("n"))
    alone = F.col("n") == 1
    sums = {"n_unique": F.sum(alone.cast("long")), "n_nonunique": F.sum((~alone).cast("long")), "n_total": F.count("*"), "n_places": F.sum("places")}
    return each.join(shared, "sequence").groupBy("protein_id").agg(*(v.alias(k) for k, v in sums.items()))
