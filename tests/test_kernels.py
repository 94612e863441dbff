"""Kernels on hand-made and synthetic spectra."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palindra import chemistry
from palindra.config import Config
from palindra.functions import ions, sequences
from palindra.kernels import pairscore, peaklists, sequencing
from palindra.operators import mapping


def test_isotope_cluster_of_charge_two():
    mz = np.array([400.0, 400.0 + 1.003 / 2, 400.0 + 1.003, 700.0])
    inten = np.array([100.0, 60.0, 20.0, 50.0])
    cluster, charge = peaklists.isotope_clusters(mz, inten, 3)
    assert cluster.tolist() == [0, 0, 0, 1] and charge.tolist() == [2, 2, 2, 0]
    m, h = peaklists.deconvolve(mz, inten, cluster, charge)
    assert m.tolist() == [700.0, pytest.approx(800.0 - chemistry.PROTON)] and h.tolist() == [50.0, 100.0]
    assert peaklists.deconvolve(mz, inten, cluster, charge, add=True)[1].tolist() == [50.0, 180.0]


def test_a_rising_peak_does_not_join():
    cluster, _ = peaklists.isotope_clusters(np.array([500.0, 501.003, 502.006]), np.array([100.0, 90.0, 95.0]), 1)
    assert len(set(cluster)) == 1
    cluster, _ = peaklists.isotope_clusters(np.array([500.0, 501.003]), np.array([10.0, 100.0]), 1)
    assert len(set(cluster)) == 2


def test_short_lists():
    empty = np.zeros(0)
    assert peaklists.isotope_clusters(empty, empty, 2)[0].tolist() == []
    assert [x.tolist() for x in peaklists.merge_close(np.array([5.0]), np.array([2.0]))] == [[5.0], [2.0]]


def test_merge_and_losses():
    m, h = peaklists.merge_close(np.array([500.0, 500.005, 600.0]), np.array([1.0, 3.0, 2.0]))
    assert m.tolist() == [pytest.approx(500.00375), 600.0] and h.tolist() == [4.0, 2.0]
    m, h = peaklists.collapse_losses(np.array([500.0 - chemistry.WATER, 500.0]), np.array([30.0, 100.0]))
    assert m.tolist() == [500.0] and h.tolist() == [130.0]


def spectrum(sequence):
    b, y = sequencing.ladder(sequence)
    mz = np.sort(np.concatenate([b, y]))
    return mz, np.ones(len(mz)) * 100, chemistry.peptide_mass(sequence)


@pytest.mark.parametrize(("code", "a", "b"), [(0, "PEPTLDEGASK", "KPEPTLDEGAS"), (6, "GAVPEPTLDSK", "GAVPEPTLDS"), (8, "GAVPEPTLDS", "KGAVPEPTLDS")])
def test_mirror_pairs_score_at_their_shift(code, a, b):
    sides = [pairscore.Side.of(*spectrum(s)) for s in (a, b)]
    scores = pairscore.histogram(*sides)
    wanted = next(t for t in chemistry.MIRROR_TYPES if t.code == (1 if code == 0 else code))
    best = max(scores[pairscore.PLAIN.spot(wanted.b)], scores[pairscore.PLAIN.spot(wanted.y)])
    assert best >= 0.5 * scores.max()


@pytest.mark.parametrize("labelled", [False, True])
def test_histogram_equals_its_double_loop(labelled):
    r = np.random.default_rng(1)
    scale = pairscore.LABELLED if labelled else pairscore.PLAIN
    a, b = (pairscore.Side.of(np.sort(r.uniform(100, 900, 12)), r.uniform(1, 9, 12), 1000.0, 0.0, r.random(12) < 0.5) for _ in range(2))
    kind = next(t for t in scale.types if t.code == 4)
    b.mz[3], b.mz[5] = a.mz[2] - kind.b, a.mz[4] - kind.y
    weight, height = np.zeros(scale.bins + 1), np.zeros(scale.bins + 1)
    for i in range(len(a.mz)):
        for j in range(len(b.mz)):
            d = a.mz[i] - b.mz[j]
            if abs(d) <= scale.bins * scale.width / 2:
                k = int(math.trunc(d / scale.width + math.copysign(0.5, d))) + (scale.bins + 1) // 2
                w = 0.3 if a.original[i] == b.original[j] else 0.7
                weight[k] += w * (a.weight[i] + b.weight[j])
                own, other = w * a.weight[i] * a.inten[i], w * b.weight[j] * b.inten[j]
                height[k] += own + other
                if labelled:
                    is_b, is_y = k == scale.spot(kind.b), k == scale.spot(kind.y)
                    height[k] += own * (is_b and not a.label[i] or is_y and a.label[i]) + other * (is_y and not b.label[j] or is_b and b.label[j])
    assert np.allclose(pairscore.histogram(a, b, scale, [kind] if labelled else None), weight * height)


def test_bins_of_shifts():
    """The bin where a shift is read is that of the shift's own difference, but for labelled R, which lies one off."""
    for scale in (pairscore.PLAIN, pairscore.LABELLED):
        for t in scale.types:
            for d in (t.b, t.y):
                off = scale.spot(d) - int(scale.at(np.array([d]))[0])
                assert off == (1 if scale is pairscore.LABELLED and d == chemistry.R_LABELLED else 0)
    assert (pairscore.PLAIN.spot(0.0), pairscore.LABELLED.spot(chemistry.R_LABELLED)) == (10056, 8996)


def test_labelled_pairs_are_judged():
    """Labels are on y ions of the first digest and on b ions of its mirror, where they agree."""
    heavy = dict(chemistry.RESIDUES, K=chemistry.K_LABELLED, R=chemistry.R_LABELLED)

    def side(peptide, labelled_y):
        masses = np.array([heavy[c] for c in peptide])
        b, y = np.cumsum(masses)[:-1] + chemistry.PROTON, np.cumsum(masses[::-1])[:-1] + chemistry.WATER + chemistry.PROTON
        mz = np.concatenate([b, y])
        order = np.argsort(mz)
        label = np.concatenate([np.full(len(b), not labelled_y), np.full(len(y), labelled_y)])[order]
        return pairscore.Side.of(mz[order], np.full(len(mz), 100.0), masses.sum() + chemistry.WATER + chemistry.PROTON, 0.0, label)

    for code, a, b in ((0, "PEPTLDEGASK", "KPEPTLDEGAS"), (4, "PEPTLDEGASR", "KPEPTLDEGAS"), (6, "GAVPEPTLDSK", "GAVPEPTLDS"), (8, "GAVPEPTLDS", "KGAVPEPTLDS")):
        sides = side(a, True), side(b, False)
        kind, _, _, with_labels, _ = pairscore.score_pair(*sides, code, 0, True)
        assert kind == (code or 1)
        wrong = [pairscore.Side(s.mz, s.inten, s.weight, s.original, ~s.label) for s in sides]
        assert pairscore.score_pair(*wrong, code, 0, True)[3] < with_labels


@pytest.mark.parametrize("sequence", ["PEPTLDEK", "GAVSTNR"])
def test_noiseless_spectra_are_sequenced(sequence):
    mz, inten, mass = spectrum(sequence)
    flip = sequence[::-1]
    found = [s for _, s in sequencing.sequences(mz, inten, mass, sequencing.combinations(), 20)]
    assert sequence in found or flip in found
    found = [s for _, s in sequencing.beam(mz, inten / 100, mass)]
    assert sequence in found or flip in found


@pytest.mark.parametrize("lost", [(3, 4), (2, 3, 4)])
def test_gaps_of_several_residues_are_bridged(lost):
    sequence = "GASPVTLDEK"
    b, y = sequencing.ladder(sequence)
    keep = [k for k in range(len(b)) if k + 1 not in lost]
    mz = np.sort(np.concatenate([b[keep], y[::-1][keep]]))
    found = [s for _, s in sequencing.sequences(mz, np.full(len(mz), 100.0), chemistry.peptide_mass(sequence), sequencing.combinations(), 100)]
    assert sequence in found or sequence[::-1] in found


def test_compositions_and_their_orders():
    masses, names = sequencing.combinations(300.0)
    want = {"".join(c) for n in range(1, 6) for c in itertools.combinations_with_replacement(sorted(chemistry.RESIDUES), n) if sum(chemistry.RESIDUES[a] for a in c) <= 300}
    assert len(names) == len(want) and set(names) == want and (np.diff(masses) >= 0).all()
    for text in ("A", "GGA", "PEPT"):
        every = sorted({"".join(p) for p in itertools.permutations(text)})
        assert [list(sequencing.orders(text, k)) for k in (1, 5, 99)] == [every[:1], every[:5], every]


def test_longest_paths_by_enumeration():
    edges = [[(1, "A", 1.0), (2, "C", 3.0)], [(2, "D", 1.5), (3, "E", 0.5)], [(3, "F", 1.0)], []]
    assert sequencing.longest_paths(edges, 0, 3, 3) == [(4.0, "CF"), (3.5, "ADF"), (1.5, "AE")]


def test_chemistry():
    elements = {"C": ([12.0, 13.00335], [0.9893, 0.0107]), "H": ([1.007825, 2.014102], [0.99985, 0.00015])}
    assert chemistry.composition("C(2)H(3)N(1)") == {"C": 2, "H": 3, "N": 1}
    assert chemistry.monoisotopic({"C": 1, "H": 4}, elements) == pytest.approx(16.0313)
    pattern = chemistry.isotope_pattern({"C": 60}, elements)
    assert pattern[1][1] / pattern[0][1] == pytest.approx(60 * 0.0107 / 0.9893, rel=1e-6)
    with pytest.raises(ValueError):
        chemistry.isotope_pattern({"C": 1}, elements, 0)
    assert chemistry.peptide_mass("PEPTIDE") == pytest.approx(800.367, abs=1e-2)


def test_config_round_trip():
    cfg = Config.parse("# c\nMASS_LOW=400 ; low\nPRECURSOR_PPM=0\n")
    assert cfg.mass_low == 400 and not cfg.precursor_ppm and Config.parse(cfg.text()) == cfg
    for bad in ("DECOY_MODE=7", "NOPE=1", "MASS_LOW=9000"):
        with pytest.raises(ValueError):
            Config.parse(bad)


def test_long_peptides_are_verified_on_their_proteins(spark):
    body = "ACDEFGHKLM" * 12
    proteins = spark.createDataFrame([(1, "WW" + body + "YY"), (2, body[:60] + "P" + body[:20]), (3, ""), (4, None)], "protein_id int, seq string")
    asked = [body[:32], body[:33], body[:100], body[3:63], "WW", "W", "Y", "", "ACDEFGHKLMW"]
    got = {tuple(r) for r in mapping.locate(spark.createDataFrame([(x,) for x in asked] + [(asked[0],)], "sequence string"), proteins).collect()}
    want = set()
    for x in filter(None, asked):
        for i, seq in ((1, "WW" + body + "YY"), (2, body[:60] + "P" + body[:20])):
            want |= {(x, i, at, at + len(x)) for at in range(len(seq)) if seq.startswith(x, at)}
    assert got == want


def test_mirror_evidence_is_moved_onto_the_first_digest(spark):
    rows = spark.createDataFrame([("GASPVTCLNDQK",)], "seq string")
    site = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(float(v)).alias("inten")) for t, v in ((0, 0), (1, 5), (0, 0))))
    mirror = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(float(v)).alias("inten")) for t, v in ((1, 1), (0, 2), (1, 3))))
    got = rows.select(ions.merged_evidence(site, mirror, F.lit(1)).alias("x"), ions.merged_evidence(site, mirror, F.lit(6)).alias("y")).first()
    assert [tuple(p) for p in got.x] == [(0, 2.0), (1, 8.0), (1, 0.0)]
    assert [tuple(p) for p in got.y] == [(1, 1.0), (1, 7.0), (1, 3.0)]
    peaks = F.array(*(F.struct(F.lit(100.0 + k).alias("mz"), F.lit(float(k)).alias("inten")) for k in range(6)))
    tags = rows.select(ions.strong_sites(ions.merged_evidence(site, mirror, F.lit(1)), peaks, F.lit(1), 3).alias("t")).first().t
    assert tags == [0, 1, 1]
    assert rows.select(ions.site_coverage(F.array(F.lit(1), F.lit(1))).alias("c")).first().c == 1.0


def test_ladder_and_evidence_of_a_known_peptide(spark):
    peptide = "PEPTLDEK"
    b, y = sequencing.ladder(peptide)
    peaks = sorted([(float(m), 10.0) for m in b[:3]] + [(float(m), 7.0) for m in y[::-1][3:]])
    rows = spark.createDataFrame([(peptide, peaks, 2)], "seq string, peaks array<struct<mz:double,inten:double>>, charge int")
    got = rows.select(ions.ladder(F.col("seq")).alias("l"), ions.evidence(F.col("seq"), F.col("peaks"), F.col("charge")).alias("e")).first()
    assert [round(x.b, 5) for x in got.l] == [round(float(m), 5) for m in b] and [round(x.y, 5) for x in got.l] == [round(float(m), 5) for m in y[::-1]]
    assert [x.tag for x in got.e] == [1] * 7 and [x.inten for x in got.e] == [10.0] * 3 + [7.0] * 4


def test_bracketed_strings(spark):
    row = spark.createDataFrame([("a[bc]d[e]",), ("none",)], "s string").select(sequences.between(F.col("s"), "[", "]").alias("x"), sequences.word(F.col("s"), "]", -1).alias("y")).collect()
    assert (row[0].x, row[1].x, row[0].y) == ("bc", None, "")
