"""Element counts, modified masses, isotope removal and small study operators."""

import pytest
from pyspark.sql import functions as F

from palindra import chemistry
from palindra.functions import peaks as P
from palindra.functions import sequences as S
from palindra.operators import study

MONO = dict(zip(chemistry.ELEMENTS, (12.0, 1.00782503207, 14.0030740048, 15.99491461956, 31.972071)))


def test_atoms_weigh_what_residues_weigh(spark):
    for a, counts in chemistry.ATOMS.items():
        assert sum(n * MONO[e] for e, n in zip(chemistry.ELEMENTS, counts)) == pytest.approx(chemistry.RESIDUES[a], abs=2e-4)
    rows = spark.createDataFrame([("PEPTIDE", None), ("MK", "1,Ox;"), ("MK", "1,Novel;"), ("PBP", ""), ("", ""), (None, None)], "seq string, mods string")
    got = [r.c for r in rows.select(S.atoms(F.col("seq"), F.col("mods"), {"Ox": {"O": 1, "Fe": 2}}).alias("c")).collect()]
    assert sum(n * MONO[e] for e, n in zip(chemistry.ELEMENTS, got[0])) + chemistry.PROTON == pytest.approx(chemistry.peptide_mass("PEPTIDE"), abs=1e-3)
    assert got[1] == [11, 23, 3, 4, 1] and got[2:] == [None, None, [0, 2, 0, 1, 0], None]
    text = [r.t for r in rows.select(S.formula(S.atoms(F.col("seq"))).alias("t")).collect()]
    assert text[1] == "C(11)H(23)N(3)O(3)S(1)" and text[3] is None and text[4] == "H(2)O(1)"
    assert chemistry.composition(text[0]) == dict(zip("CHNO", (34, 53, 7, 15)))


def test_modified_masses(spark):
    rows = spark.createDataFrame([("AM(+15.99)C(57.02)K",), ("AMCK",), ("AM(ox)K",), ("A(+1)B",)], "s string")
    got = [r.m for r in rows.select(S.modified_mass(F.col("s")).alias("m")).collect()]
    assert got[0] == pytest.approx(chemistry.peptide_mass("AMCK") + 73.01) and got[1] == pytest.approx(chemistry.peptide_mass("AMCK")) and got[2:] == [None, None]


def test_isotopes_go_by_their_labels(spark):
    peaks, labels = [(100.0, 1.0), (200.0, 5.0), (200.5, 4.0), (300.0, 2.0), (301.0, 1.0)], [(0, 0, 0), (1, 2, 2), (1, 2, 2), (1, 1, 1), (1, 1, 1)]
    rows = spark.createDataFrame([(peaks, labels), ([], [])], "p array<struct<mz:double,inten:double>>, l array<struct<kept:int,cluster:int,charge:int>>")
    got = [[tuple(x) for x in r.q] for r in rows.select(P.without_isotopes(F.col("p"), F.col("l")).alias("q")).collect()]
    assert got == [[(100.0, 1.0), (300.0, 2.0), (400.0 - chemistry.PROTON, 5.0)], []]


def test_confident_locations(spark):
    places = spark.createDataFrame([("A", "p", 0), ("B", "p", 1), ("C", "p", 2)], "sequence string, protein_id string, start int")
    masses = spark.createDataFrame([("A", 900.0, True), ("B", 900.0, False), ("C", 100.0, True)], "sequence string, mass double, evident boolean")
    assert [r.sequence for r in study.confident(places, 500.0, masses).collect()] == ["A"]
