"""Doublets and cluster labels against sequential loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palindra import chemistry
from palindra.kernels import peaklists
from palindra.operators import doublets, mapping
from palindra.sources import readers, writers

SPECTRA = "spectrum int, peaks array<struct<mz:double,inten:double>>, charge int, label string"


def plain(peaks, most):
    """Doublets in turn: the light peak takes the larger intensity, heavy ones go unless they are light to another."""
    peaks = sorted(peaks)
    unit = lambda x: int(x * 1e5 + 0.5)
    charges = range(1, min(3, most) + 1)
    near = {u + d for c in charges for u in (unit(0.036 / c), unit(0.072 / c)) for d in range(-1500, 1501)}
    inten, label, heavy = [h for _, h in peaks], [0] * len(peaks), set()
    for i, (mz, own) in enumerate(peaks):
        if mz > 1500:
            break
        for j in range(i + 1, len(peaks)):
            gap = peaks[j][0] - mz
            if gap > 0.6:
                break
            if gap > 0 and unit(gap) in near and peaks[j][1] <= 2 * own and own <= 2 * peaks[j][1]:
                inten[i] = max(inten[i], peaks[j][1])
                heavy.add(j)
                heavy.discard(i)
                errors = [min(1, abs(gap - 0.036 / c), abs(gap - 0.072 / c)) for c in charges]
                label[i] = 1 if gap > 0.036 else errors.index(min(errors)) + 1
    return [(peaks[k][0], inten[k], label[k]) for k in range(len(peaks)) if k not in heavy]


def crowded(r, n):
    peaks = []
    for _ in range(n):
        mz = r.choice([r.uniform(100, 1600), r.uniform(1499.9, 1500.1)])
        peaks.append((mz, r.uniform(1, 9)))
        while r.random() < 0.6:
            mz += r.choice([0.036, 0.072, 0.018, 0.012, 0.024]) + r.uniform(-0.02, 0.02)
            peaks.append((mz, r.uniform(1, 9)))
    r.shuffle(peaks)
    return peaks


def test_doublets_equal_the_loop(spark):
    r = random.Random(5)
    rows = [(k, crowded(r, r.randint(0, 40)), k % 4, "clash") for k in range(24)] + [(90, None, 1, ""), (91, [(5.0, 1.0)], 2, "")]
    frame = spark.createDataFrame(rows, SPECTRA).repartition(3)
    got = {x.spectrum: x for x in doublets.merged(frame, charges=F.col("charge")).collect()}
    assert len(got) == len(rows)
    for spectrum, peaks, charge, label in rows:
        assert got[spectrum].label == label
        if peaks is None:
            assert got[spectrum].peaks is None
        else:
            assert [tuple(p) for p in got[spectrum].peaks] == plain(peaks, max(1, charge))


def test_a_chain_of_three(spark):
    rows = [(1, [(500.0, 4.0), (500.036, 5.0), (500.072, 6.0), (700.0, 1.0)], 1, "")]
    got = doublets.merged(spark.createDataFrame(rows, SPECTRA)).first().peaks
    assert [tuple(p) for p in got] == [(500.0, 6.0, 1), (500.036, 6.0, 2), (700.0, 1.0, 0)] or [p.mz for p in got] == [500.0, 500.036, 700.0]


def test_features(spark):
    peaks = [(100.0, 3.0), (100.01, 9.0), (100.04, 2.0), (200.0, 4.0), (200.03, 6.0), (300.0, 1.0), (300.036, 2.0)]
    got = spark.createDataFrame([(1, peaks, 1, ""), (2, [], 1, ""), (3, peaks[:2], 1, "")], SPECTRA).select(doublets.features(F.col("peaks")).alias("f")).collect()
    assert [(round(x.mass_diff, 6), x.inten_ratio) for x in got[0].f] == [(0.01, 1.5), (0.03, 4.5), (0, 0), (0.03, 0.667), (0, 0), (0, 0), (0, 0)]
    assert got[1].f == [] and [(x.mass_diff, x.inten_ratio) for x in got[2].f] == [(0, 0)] * 2


def test_labels_stand_where_the_peaks_stand(spark):
    r = random.Random(2)
    rows = []
    for k in range(12):
        peaks = [(0.5, 99.0)] if k % 2 else []
        for _ in range(r.randint(0, 5)):
            mz, z, h = r.uniform(200, 900), r.randint(1, 3), r.uniform(50, 100)
            peaks += [(mz + n * 1.003 / z, h * 0.7**n) for n in range(r.randint(1, 4))]
        r.shuffle(peaks)
        rows.append((k, peaks, 2, "clash"))
    rows.append((99, None, 2, "clash"))
    got = {x.spectrum: x for x in doublets.labelled(spark.createDataFrame(rows, SPECTRA).withColumn("labels", F.lit(1)).repartition(3)).collect()}
    for spectrum, peaks, *_ in rows:
        if peaks is None:
            assert got[spectrum].labels is None
            continue
        order = sorted((p for p in peaks if p[0] >= chemistry.PROTON))
        cluster, charge = peaklists.isotope_clusters(np.array([m for m, _ in order]), np.array([h for _, h in order]), 3)
        numbers = {c: n for n, c in enumerate(sorted({c for c, z in zip(cluster, charge) if z}), 1)}
        want = {p: (1, numbers[c], z) if z else (0, 0, 0) for p, c, z in zip(order, cluster.tolist(), charge.tolist())}
        assert [tuple(x) for x in got[spectrum].labels] == [want.get(p, (0, 0, 0)) for p in peaks]


def test_labelled_singles():
    step = chemistry.NEUTRON
    m, h, lab = peaklists.labelled_singles(np.array([400.0, 400 + step / 2, 700.0, 900.0]), np.array([100.0, 60.0, 50.0, 7.0]), np.array([0, 1, 2, 0]), 3)
    want = sorted([(800 - chemistry.PROTON, 200.0, 1), (700.0, 100.0, 1), (1400 - chemistry.PROTON, 100.0, 1), (900.0, 7.0, 0)])
    assert [tuple(x) for x in zip(m, h, lab)] == [pytest.approx(w) for w in want]
    m, h, lab = peaklists.labelled_singles(np.array([500 - chemistry.WATER, 500.0]), np.array([30.0, 100.0]), np.array([0, 1]), 1)
    assert lab.tolist() == [0, 1] and len(m) == 2  # a loss of another label stays
    m, h, lab = peaklists.labelled_singles(np.array([500 - chemistry.WATER, 500.0]), np.array([30.0, 100.0]), np.array([1, 1]), 1)
    assert m.tolist() == [500.0] and h.tolist() == [260.0] and lab.tolist() == [1]
    m, h, lab = peaklists.labelled_singles(np.array([500.0, 500.004]), np.array([10.0, 30.0]), np.array([1, 0]), 1)
    assert m.tolist() == [pytest.approx(500.0024)] and h.tolist() == [50.0] and lab.tolist() == [1]
    assert [len(x) for x in peaklists.labelled_singles(np.zeros(0), np.zeros(0), np.zeros(0, int), 2)] == [0, 0, 0]


def test_labelled_writers(spark, tmp_path):
    peaks = [(100.0, 5.0, 1), (200.0, 7.0, 0)]
    base = spark.createDataFrame([("f.12.12.2.0.dta", 2, 3.5, 450.25, peaks)], "title string, charge int, rt double, prec_mz double, peaks array<struct<mz:double,inten:double,label:int>>")
    writers.mgf_with_doublets(base, str(tmp_path / "d"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "d")).collect())
    assert "NEUCODELABEL=110\n100.00000 5.00000\n100.03600 5.00000\n200.00000 7.00000\nEND IONS" in text
    labelled = doublets.labelled(base.withColumn("peaks", F.transform("peaks", lambda p: F.struct(p.mz.alias("mz"), p.inten.alias("inten")))))
    writers.annotated_mgf(labelled, str(tmp_path / "a"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "a")).collect())
    assert "UNFILTERED=0,0\nISOTOPE_CLUSTER=0,0\nISOTOPE_CHARGE=0,0\n100.00000" in text
    assert readers.mgf(spark, str(tmp_path / "a")).first().scan == 12


def test_depth_by_sweep(spark):
    r = random.Random(1)
    places = [(f"s{k % 7}", p, s, s + n) for k in range(200) for p, s, n in [(r.choice("xyz"), r.randrange(60), r.randrange(1, 20))]]
    places += [("a", "w", 0, 5), ("b", "w", 5, 9), ("b", "w", 5, 9)]
    frame = spark.createDataFrame(places, "sequence string, protein_id string, start int, end int")
    want = {}
    for _, p, s, e in places:
        for k in range(s, e):
            want[p, k] = want.get((p, k), 0) + 1
    rows = mapping.depth(frame).collect()
    assert {(x.protein_id, k): x.depth for x in rows for k in range(x.start, x.end)} == want
    assert all((x.protein_id, x.end) not in {(y.protein_id, y.start) for y in rows if y.depth == x.depth} for x in rows)
    got = {x.protein_id: x for x in mapping.counts(frame).collect()}
    distinct = set(places)
    of = {s: {p for t, p, *_ in distinct if t == s} for s in {x[0] for x in distinct}}
    for p, x in got.items():
        own = {s for s, q, *_ in distinct if q == p}
        assert (x.n_unique, x.n_total, x.n_places) == (sum(of[s] == {p} for s in own), len(own), sum(q == p for _, q, *_ in distinct))
