"""Fingerprints, near-duplicates, line dedup, repeated strings and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palindra.llm import bounded, components, fingerprints, joins, line_dedup, near_dups, packing, storage, suffix_dedup, text, token_store, tokens

from . import fixture


def shingles(value, size):
    w = fixture.WORDS.findall(value or "")
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t0|.,'", max_size=40)), max_size=12))
def test_words_match_the_pattern(texts):
    w = text.words(pa.array(texts, pa.string()))
    got = [[w.vocabulary[int(c)].as_py() for c in w.codes[w.first[d] : w.first[d + 1]]] for d in range(len(texts))]
    assert got == [fixture.WORDS.findall(t or "") for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aBzé́ \n.,'!1٣’ﬁΣ-", max_size=60), max_size=6))
def test_piecewise_ids_equal_the_tokenizer(texts):
    enc = tokens.encoder(tokens.default_vocabulary())
    ids, first = enc.ids(pa.array(texts, pa.string()))
    assert [ids[s:e].tolist() for s, e in zip(first[:-1], first[1:])] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_met_again_are_kept():
    r = random.Random(3)
    enc = tokens.Encoder(tokens.default_vocabulary())
    enc.keep = 300
    common = fixture.vocabulary(60)
    for _ in range(12):
        texts = [" ".join(r.choice(common) if r.random() < 0.5 else f"{r.random():.9f}q" for _ in range(80)) for _ in range(3)]
        ids, first = enc.ids(pa.array(texts))
        assert [ids[s:e].tolist() for s, e in zip(first[:-1], first[1:])] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.known) < 800 and sum(w in enc.known for w in common) > 40
    enc.again[: len(enc.known)] = True
    enc.purge()
    assert not enc.known  # most were met again: all go


def test_special_token_text_is_encoded_whole():
    enc = tokens.encoder(tokens.default_vocabulary())
    texts = ["a <|endoftext|> b", "plain, text"]
    ids, first = enc.ids(pa.array(texts))
    assert [ids[s:e].tolist() for s, e in zip(first[:-1], first[1:])] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_fingerprints(spark):
    rows = fixture.corpus()
    got = fingerprints.compare_with_next(fixture.frame(spark, rows), partitions=4).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = Counter()
    for k, row in enumerate(order):
        value, following = row[1] or "", order[(k + 1) % len(order)][1] or ""
        want[(row[0], len(value), hashlib.sha256(fingerprints.edited(value, following).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    by_text = defaultdict(set)
    for row in rows:
        if row[0] is not None:
            by_text[row[1] or ""].add(by_id[row[0]][0].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    for k, row in enumerate(order):
        if row[0] is not None and len(by_id[row[0]]) == 1:
            value, following = row[1] or "", order[(k + 1) % len(order)][1] or ""
            for other, near in ((following, by_id[row[0]][0].near_next), (fingerprints.edited(value, following), by_id[row[0]][0].near_edited)):
                a, b = shingles(value, 5), shingles(other, 5)
                # a sample of half of the hashes: five standard deviations of its share, which is unknown if the sample is empty
                assert abs(near - jaccard(a, b)) <= 2.5 / max(1, len(a | b) / fingerprints.SCALE) ** 0.5
                assert near == jaccard(a, b) or near not in (0.0, 1.0) or len(a & b) < 40


def test_fingerprint_sketches_merge_and_contain():
    r, words = random.Random(2), fixture.vocabulary(3000)
    long, short = fixture.prose(r, words, 8000), fixture.prose(r, words, 300)
    a, b, both = fingerprints.sketches(pa.array([long + " " + short, short, long + " " + short]))
    assert b.compare(a)[1] > 0.95 and b.compare(a)[0] < 0.1
    assert a.merge(b).hashes.tolist() == both.hashes.tolist()
    again = fingerprints.Sketch.parse(a.text())
    assert (again.n, again.digest, again.limit, again.hashes.tolist()) == (a.n, a.digest, a.limit, a.hashes.tolist())


def test_merged_sketches_survive_their_text():
    r, words = random.Random(4), fixture.vocabulary(200)
    for k in range(300):
        a, b, c = fingerprints.sketches(pa.array([fixture.prose(r, words, r.randint(0, 40)) for _ in range(3)]), scale=1 + k % 5)
        union = a.merge(b)
        again = fingerprints.Sketch.parse(union.text())
        assert (again.n, again.digest, again.limit, again.hashes.tolist()) == (union.n, union.digest, union.limit, union.hashes.tolist())
        assert again.compare(c) == union.compare(c) and c.compare(again) == c.compare(union)
        if len(a.hashes):
            assert a.compare(union)[1] == 1.0


def test_the_sketch_keeps_a_fixed_fraction():
    r = np.random.default_rng(5)
    for n in (3, 300, 30000):
        hashes = np.unique(r.integers(0, 2**64 - 1, n, np.uint64))
        for scale in (1, 2, 8):
            s = fingerprints.Sketch.of(hashes, scale)
            assert s.hashes.tolist() == sorted({int(h) >> 16 for h in hashes if int(h) >> 16 < (1 << 48) // scale})
            assert s.compare(fingerprints.Sketch.of(hashes, scale)) == (1.0, 1.0)


def test_fingerprints_of_one_and_no_document(spark):
    one = fingerprints.compare_with_next(fixture.frame(spark, [(5, "abcd", None, None, None, None, None)], 1)).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(5, 4, 1.0)]
    assert fingerprints.compare_with_next(fixture.frame(spark, [], 1)).count() == 0


def brute_components(rows, size, num, den, lower):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = fixture.unique_ids(rows)
    sets = {r[0]: shingles((r[1] or "").translate(fold) if lower else r[1], size) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "least", "lower", "most"), [(3, (85, 100), True, 128), (5, (80, 100), False, 128), (3, (85, 100), True, 2)])
def test_near_duplicate_groups(spark, monkeypatch, size, least, lower, most):
    rows = fixture.corpus(seed=7)
    monkeypatch.setattr(joins, "BLOCK", 8)
    got = near_dups.groups(fixture.frame(spark, rows), size, least, lower, most).collect()
    want = brute_components(rows, size, *least, lower)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dups.groups(fixture.frame(spark, [], 1)).count() == 0
    assert near_dups.kept(fixture.frame(spark, [], 1)).count() == 0


def test_a_variant_group_without_a_linked_centre(spark, monkeypatch):
    """Long lists whose members fall into several components are compared block by block."""
    monkeypatch.setattr(joins, "BLOCK", 4)
    r, words = random.Random(11), fixture.vocabulary(800)
    base = fixture.prose(r, words, 80)
    rows = [(k, fixture.edited(r, base, words, r.choice([0.01, 0.03, 0.06, 0.1])), None, None, None, None, None) for k in range(80)]
    got = near_dups.groups(fixture.frame(spark, rows), 3, (85, 100), True, 6).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 85, 100, True)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200, 240)] + [(900, k) for k in range(300, 340)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 200 for k in range(200, 241)}, **{k: 300 for k in [*range(300, 340), 900]}}


def test_match_thresholds_lose_almost_nothing():
    for k in (near_dups.INDEXED, near_dups.COORDINATES):
        assert 0 < joins.matches_needed(k, 0.8) <= joins.matches_needed(k, 0.85) < k


def brute_lines(rows):
    rows = fixture.unique_ids([r for r in rows if r[1] is not None])
    first, lines = {}, []
    for i, value, *_ in rows:
        for k, line in enumerate(value.split("\n")):
            words = frozenset(fixture.WORDS.findall(line))
            if words:
                lines.append((i, k, words))
                first.setdefault(words, (i, k))
    kinds = sorted(first, key=first.get)
    best = dict(first)
    for x, a in enumerate(kinds):
        for b in kinds[:x]:
            common = len(a & b)
            if 5 * common >= 4 * (len(a) + len(b) - common):
                best[a] = min(best[a], first[b])
                break
    out = {}
    for i, value, *_ in rows:
        gone = {k: best[w][0] for j, k, w in lines if j == i and best[w] < (i, k)}
        kept = "\n".join(x for k, x in enumerate(value.split("\n")) if k not in gone)
        out[i] = (sum(j == i for j, _, _ in lines), len(gone), len(set(gone.values()) - {i}), min([i, *gone.values()]), kept)
    return out


@pytest.mark.parametrize(("longest", "most"), [(8192, 4), (8192, 1), (6, 2)])
def test_line_dedup(spark, longest, most):
    rows = fixture.corpus(seed=5)
    docs = fixture.frame(spark, rows)
    got = line_dedup.dedup(docs, longest=longest, most=most)
    assert got.columns[: len(docs.columns)] == docs.columns
    want = brute_lines(rows)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.text is not None and r.doc_id in want:
            assert (r.n_lines, r.n_removed, r.n_links, r.class_id, r.text) == want[r.doc_id]
    assert sum(r.n_removed for r in found) > 20


def crowded_lines():
    """Documents of lines that share their rarest words: long lists, with similar, nearly similar and equal lines."""
    rng, rows = random.Random(9), []
    for i in range(40):
        lines = []
        for _ in range(4):
            words = [f"rare{k}" for k in range(3)] + [f"some{rng.randrange(9)}" for _ in range(rng.randrange(4, 12))]
            rng.shuffle(words)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines), None, None, None, None, None))
    return rows


@pytest.mark.parametrize(("longest", "most"), [(8192, 1), (16, 1), (16, 3)])
def test_crowded_lists_of_lines(spark, longest, most):
    rows = crowded_lines()
    want = brute_lines(rows)
    found = line_dedup.dedup(fixture.frame(spark, rows), longest=longest, most=most).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.class_id, r.text) for r in found} == want
    assert 20 < sum(r.n_removed for r in found) < 150


def test_long_lists_need_pairs_of_blocks(spark, monkeypatch):
    """Without the jobs of two blocks, pairs are lost."""
    whole = joins.block_jobs
    monkeypatch.setattr(joins, "block_jobs", lambda *a, **b: whole(*a, **b).where("low = high"))
    rows = crowded_lines()
    found = line_dedup.dedup(fixture.frame(spark, rows), longest=16).collect()
    assert {r.doc_id: r.text for r in found} != {i: w[-1] for i, w in brute_lines(rows).items()}


@pytest.mark.parametrize("longest", [8192, 1])
def test_lines_with_one_sketch_are_told_apart(spark, longest):
    by_bit, shared = defaultdict(list), [f"common{k}" for k in range(9)]
    for w in (f"word{k}" for k in range(300)):
        data = np.frombuffer(w.encode(), np.uint8)
        by_bit[int(text.hash_runs(data, np.array([0]), np.array([len(data)]))[0] & np.uint64(127))].append(w)
    a, b = next(v for v in by_bit.values() if len(v) > 1)[:2]
    lines = line_dedup.Lines(pa.array([" ".join([*shared, a]), " ".join([*shared, b])]))
    assert (lines.sketches()[0] == lines.sketches()[1]).all() and (lines.sums()[0] != lines.sums()[1]).any()
    rows = [(i, " ".join([*shared, w]), None, None, None, None, None) for i, w in enumerate([a, b])]
    found = line_dedup.removals(fixture.frame(spark, rows, 2).selectExpr("doc_id AS doc", "text"), longest=longest).collect()
    assert [tuple(r) for r in found] == [(1, 0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \né", max_size=90), max_size=6), st.integers(0, 200))
def test_hashes_of_words(texts, n):
    texts.append("x" * n + " " + "x" * (n + 1))
    data, offsets = text.flat(pa.array(texts, pa.string()))
    starts, ends = text.runs(data, offsets, ~text.space(data))
    got = list(text.hash_runs(data, starts, ends))
    words = [w for t in texts for w in fixture.WORDS.findall(t)]
    assert [words.index(w) for w in words] == [got.index(h) for h in got]


def test_lines_in_global_order():
    classes = np.random.default_rng(1).integers(0, 3, 1 << bounded.COUNT_BITS).astype(np.uint16)
    x = line_dedup.Lines(pa.array(["a b c a\n\n d e", None, "b a"]), classes)
    assert list(x.owner) == [0, 0, 2] and list(x.number) == [0, 2, 0] and list(x.size) == [3, 2, 2]
    for s, e in zip(x.first[:-1], x.first[1:]):
        keys = list(zip(classes[bounded.count_slots(x.hashes[s:e])], x.hashes[s:e]))
        assert keys == sorted(set(keys))
    # hashes that differ only below the key's bits
    h = np.array([5, 4, 5, 1 << 63], np.uint64)
    assert list(h[line_dedup._sorted(np.array([0, 0, 0, 1]), None, h)]) == [4, 5, 5, 1 << 63]


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup(fixture.frame(spark, [], 1)).count() == 0


def brute_repeats(rows):
    seen, out = {}, {}
    for i, value, *_ in fixture.unique_ids(rows):
        data = (value or "").encode()
        gone = np.zeros(len(data), bool)
        new = set()
        for s in range(len(data) - 49):
            if data[s : s + 50] in seen:
                gone[s : s + 50] = True
            else:
                new.add(data[s : s + 50])
        seen.update(dict.fromkeys(new))
        edge = np.diff(np.concatenate([[0], gone, [0]]).astype(int))
        out[i] = (len(data), int(gone.sum()), list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1))), bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.LIST, 3])
def test_repeated_strings(spark, most):
    r = random.Random(4)
    rows = fixture.corpus(seed=9) + [(2000 + k, ("ab" * r.randint(10, 90)) + "é" * r.randint(0, 80), None, None, None, None, None) for k in range(25)]
    found = suffix_dedup.dedup(fixture.frame(spark, rows), most).collect()
    want = brute_repeats(rows)
    assert len(found) == len(rows)
    for x in found:
        if x.doc_id is not None:
            assert (x.n_bytes, x.n_removed, [(s.start, s.length) for s in x.spans], bytes(x.kept)) == want[x.doc_id]
        else:
            assert x.n_removed == 0
    assert sum(x.n_removed for x in found) > 10_000


def test_repeated_strings_of_an_empty_table(spark):
    assert suffix_dedup.dedup(fixture.frame(spark, [], 1)).count() == 0


def test_packing_is_a_partition_of_all_ids(spark):
    rows = fixture.corpus(seed=3)
    pieces = packing.pack(packing.encode(fixture.frame(spark, rows, 2)), shard_tokens=6000).collect()
    enc = tokens.encoder(tokens.default_vocabulary()).tokenizer
    want = Counter()
    for i, value, *_ in rows:
        want[(i, tuple(enc.encode(value or "", add_special_tokens=False).ids + [1]))] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for i, parts in by_doc.items():
        ids = Counter()
        for p in parts:
            ids.update(np.frombuffer(p.ids, "<u4").tolist())
            assert len(p.ids) == 4 * p.length
        total = Counter()
        for (j, value), n in want.items():
            if j == i:
                for _ in range(n):
                    total.update(value)
        assert ids == total
        if sum(n for (j, _), n in want.items() if j == i) == 1:
            parts.sort(key=lambda p: p.start)
            whole = next(v for (j, v) in want if j == i)
            assert tuple(np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist()) == whole
            assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
            assert all(p.doc_tokens == len(whole) for p in parts)
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for spans in windows.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= packing.WINDOW
    short = sum(packing.WINDOW - sum(n for _, n in s) > 0 for s in windows.values())
    assert short <= 2
    assert packing.pack(packing.encode(fixture.frame(spark, [], 1))).count() == 0


def plain_windows(scores_of, left, ids, first, window):
    """(row, start, length) in order, one neighbour at a time: the best that fits, then a part of the best that is left."""
    left, start, room, out, seed, turn = list(left), [0] * len(left), 0, [], None, None
    while any(left):
        if not room:
            row = turn if turn is not None and left[turn] else next(u for u in range(len(left)) if left[u])
            room, turn, fresh = window, None, True
        else:
            fresh, scores = False, scores_of(seed)
            fits = [u for u in range(len(left)) if left[u] and scores[u] > 0 and left[u] <= room]
            some = [u for u in range(len(left)) if left[u]]
            row = min(fits, key=lambda u: (-scores[u], u)) if fits else min(some, key=lambda u: (-scores[u], u))
        n = min(room, left[row])
        if fresh:
            at = first[row] + start[row]
            seed = ids[at : at + n]
        out.append((row, start[row], n))
        start[row], left[row], room = start[row] + n, left[row] - n, room - n
        turn = row if not room and left[row] else None
    return out


@pytest.mark.parametrize(("seed", "at_once"), [(1, 256), (2, 1), (3, 2), (4, 5)])
def test_packing_takes_the_best_neighbours_in_turn(seed, at_once, monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", at_once)
    r = np.random.default_rng(seed)
    size = r.integers(1, 40, 60)
    first = np.concatenate([[0], np.cumsum(size)])
    ids = r.integers(0, 25, first[-1]).astype(np.uint32)
    ids[first[10] : first[11]] = ids[first[20] : first[20] + size[10]] if size[20] >= size[10] else ids[first[10] : first[11]]
    idf = np.linspace(0.1, 2.0, 25).astype(np.float32)
    packer = packing.Packer(idf, 20.0, 64, 0)
    got = [(p[0], p[1], p[2]) for p in packer.shard(list(range(60)), ids, first)]
    index = packing.Index(ids, first, idf, 20.0)
    assert got == plain_windows(index.scores, size, ids, first, 64)


def test_shards_are_bounded_in_rows_too(monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    table = pa.table({"doc_id": list(range(50)), "ids": pa.array([b"abcd"] * 50, pa.binary())})
    for n in (3, 7, 20, 50):
        found = [b.column("doc_id").to_pylist() for b in packing.shards(table.to_batches(n), 4 << 20)]
        assert all(len(f) <= 7 for f in found) and sum(found, []) == list(range(50))


def test_packing_prefers_lexical_neighbours():
    r = random.Random(1)
    topics = [np.array([100 * t + k for k in range(60)]) for t in range(4)]
    docs = [r.choices(topics[k % 4].tolist(), k=50) for k in range(40)]
    ids = np.array([x for d in docs for x in d], np.uint32)
    packer = packing.Packer(np.ones(500, np.float32), 50.0, 250, 0)
    pieces = packer.shard(list(range(40)), ids, np.arange(0, 2001, 50))
    by_window = defaultdict(Counter)
    for p in pieces:
        by_window[p[5]][p[0] % 4] += 1
    assert all(len(c) == 1 for c in by_window.values())


def packed(spark, docs, partitions, window, **settings):
    """The documents of every window, for documents (lists of ids) dealt to the partitions in order."""
    rows = [(k, np.array(d, "<u4").tobytes()) for k, d in enumerate(docs)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "doc_id long, ids binary")
    windows = defaultdict(set)
    for p in packing.pack(frame, window, **settings).collect():
        windows[p.sequence_id].add(p.doc_id)
    return list(windows.values())


def test_packing_retrieves_by_frequent_terms(spark):
    r = random.Random(7)
    docs = [r.sample(range(1000 * (k % 3) + 2, 1000 * (k % 3) + 52), 50) for k in range(9)]
    assert sorted(map(sorted, packed(spark, docs, 1, 150))) == [[0, 3, 6], [1, 4, 7], [2, 5, 8]]


def test_packing_brings_copies_of_all_partitions_together(spark):
    r = random.Random(8)
    docs = [r.sample(range(2, 400), 50) for _ in range(40)] * 4
    windows = packed(spark, docs, 4, 200, shard_tokens=2000)
    assert sum({k % 40 for k in w} == {min(w) % 40} and len(w) == 4 for w in windows) >= 30


def test_packing_names_by_content():
    rows = [[5, 7, 9], [9, 7, 5, 5], [], [3]]
    first = np.cumsum([0, *map(len, rows)])
    got = packing.names(np.array([x for d in rows for x in d], np.uint32), first, np.arange(10)[::-1].astype(np.int64))
    assert got.tolist() == [[0, 2, 4], [0, 2, 4], [packing.ALONE] * 3, [6, packing.ALONE, packing.ALONE]]


def test_shards_join_batches():
    sizes = [3, 4, 1, 9, 2, 2, 2, 30, 1]
    rows = pa.table({"ids": pa.array([b"x" * n for n in sizes], pa.binary())})
    for n in (1, 2, 9):
        found = [[len(x) for x in b.column("ids").to_pylist()] for b in packing.shards(rows.to_batches(n), 9)]
        assert sum(found, []) == sizes and all(sum(s) <= 9 or len(s) == 1 for s in found)
        assert all(sum(a) + b[0] > 9 for a, b in zip(found, found[1:]))


def test_token_store_round_trip(spark):
    rows = fixture.corpus(seed=6)
    path = storage.new_path(spark, "orc")
    token_store.write(fixture.frame(spark, rows), path)
    got = sorted(token_store.read(spark, path).collect(), key=lambda r: r.start)
    enc = tokens.encoder(tokens.default_vocabulary()).tokenizer
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, row in zip(got, order, strict=True):
        ids = enc.encode(row[1] or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (row[0], at, len(ids), ids)
        at += len(ids)
    sums = {r.start: r.ids_crc32 for r in token_store.digests(token_store.read(spark, path)).collect()}
    assert all(sums[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert token_store.lookup(spark, path, [order[-1][0]]).count() == 1
    empty = storage.new_path(spark, "orc")
    token_store.write(fixture.frame(spark, [], 1), empty)
    assert token_store.read(spark, empty).count() == 0


def test_bounded_tables(spark):
    rows = spark.range(0, 5000, numPartitions=3)
    keys = lambda b: b.column("id").to_numpy().view(np.uint64)
    table = bounded.bloom(rows, keys, 18)
    assert bounded.passes(table, np.arange(5000, dtype=np.uint64)).all()
    assert bounded.passes(table, np.arange(10**6, 10**6 + 5000, dtype=np.uint64)).mean() < 0.1
