"""One-scan mapping against plain search, and ranges of the q-values."""

import random

import numpy as np
from pyspark.sql import functions as F

from palindra.operators import lineage, mapping, statistics, study


def plain(peptides, proteins):
    return {(x, i, at, at + len(x)) for x in set(filter(None, peptides)) for i, seq in proteins if seq for at in range(len(seq)) if seq.startswith(x, at)}


def located(spark, peptides, proteins, **more):
    rows = mapping.locate(spark.createDataFrame([(x, "clash") for x in peptides], "sequence string, pos string"), spark.createDataFrame([(i, s, 1) for i, s in proteins], "protein_id string, seq string, seed int").repartition(3), **more).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_every_length_of_peptide(spark):
    r = random.Random(3)
    seqs = ["".join(r.choice("ABCé𝔸") for _ in range(n)) for n in (0, 1, 2, 7, 8, 9, 40, 300)] + [None, "A" * 90]
    proteins = [(f"p{k}", s) for k, s in enumerate(seqs)]
    long = seqs[7]
    peptides = [long[a : a + n] for n in (1, 2, 3, 4, 7, 8, 9, 20, 32, 33, 70) for a in (0, 13, len(long) - n)] + ["", None, "A" * 40, "ZZ", "Q" * 9, long + "A"]
    assert located(spark, peptides, proteins) == plain([p for p in peptides if p], proteins)
    assert located(spark, peptides, proteins, k=3, salts=2) == plain([p for p in peptides if p], proteins)
    assert located(spark, [], proteins) == set() and located(spark, ["A"], []) == set()


def test_slices_of_a_batch_do_not_touch(spark, monkeypatch):
    monkeypatch.setattr(mapping, "_LETTERS", 10)
    proteins = [(str(k), s) for k, s in enumerate(["ABCDEF", "FABC", "ABCABCABCABCABC", "A", "BC"])]
    assert located(spark, ["ABC", "FA", "ABCABCAB", "ABCABCABC"], proteins) == plain(["ABC", "FA", "ABCABCAB", "ABCABCABC"], proteins)


def test_a_full_map_of_marks_lets_nothing_wrong_through(spark):
    proteins = spark.createDataFrame([(1, "ABCDEFGHIJ")], "protein_id int, seq string")
    full = {3: np.ones(mapping.SLOTS, bool), 8: np.ones(mapping.SLOTS, bool)}
    got = mapping.seeded(proteins, full, 32).collect()
    assert sorted((r.pos, r.seed) for r in got if len(r.seed) == 3) == [(k, "ABCDEFGHIJ"[k : k + 3]) for k in range(8)]
    assert sorted((r.pos, r.ahead) for r in got if len(r.seed) == 8) == [(k, "ABCDEFGHIJ"[k:]) for k in range(3)]


def test_the_scan_is_the_only_one(spark, tmp_path):
    spark.createDataFrame([(1, "ABCDEFGHIJ")], "protein_id int, seq string").write.parquet(str(tmp_path / "p"))
    found = mapping.locate(spark.createDataFrame([("ABC",)], "sequence string"), spark.read.parquet(str(tmp_path / "p")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Cross" not in plan


def test_coverage_and_forms_read_locations_once(spark):
    proteins = spark.createDataFrame([("x", "KGASPVTKGASPV"), ("y", "GASPVTLL"), ("z", "MMM")], "protein_id string, seq string")
    places = mapping.locate(spark.createDataFrame([("GASP",), ("ASPVT",), ("TLL",)], "sequence string"), proteins)
    got = {r.protein_id: r for r in mapping.coverage(places, proteins).collect()}
    assert (got["x"].covered, got["x"].n_unique, got["x"].n_nonunique) == (10, 0, 2) and (got["y"].covered, got["y"].n_unique, got["y"].n_total) == (8, 1, 3)
    asked = spark.createDataFrame([("KGASPVT", 1), ("KGASPVK", 1), ("AGASPVL", 1)], "sequence string, type_code int")
    both = study.mirror_locations(asked, proteins).collect()
    assert {(r.sequence, r.side) for r in both} == {("KGASPVT", "a"), ("KGASPVT", "b")}
    assert {(r.sequence, r.split) for r in study.whole_or_parts(asked, proteins).collect()} == {("KGASPVT", False)}
    assert lineage.release(spark) > 0


def test_q_values_without_the_other_columns_and_coalesced(spark):
    r = random.Random(1)
    rows = [(k, r.choice([0.1, 0.2, r.random()]), r.choice([0.15, r.random()]), "x" * 50) for k in range(3000)] + [(3000, 0.1, 0.5, None)] * 3
    frame = spark.createDataFrame(rows, "id int, t double, d double, other string").repartition(7)
    want, decoys, targets, order = {}, 0, 0, sorted(rows, key=lambda x: (min(x[1], x[2]), x[0]))
    for x in order:
        decoys, targets = decoys + (x[1] >= x[2]), targets + (x[1] < x[2])
        want.setdefault(x[0], []).append((1 + decoys) / max(targets, 1))
    least, q = float("inf"), {}
    for x in reversed(order):
        least = min(least, want[x[0]][-1])
        q[x[0]] = least
    out = statistics.q_values(frame, "t", "d", ["id"])
    assert {x.id: x.q for x in out.select("id", "q").collect() if x.id < 3000} == {k: v for k, v in q.items() if k < 3000}
    assert out.select("fdr").agg(F.count("*").alias("n")).first().n == len(rows)
    assert statistics.q_values(frame.limit(0), "t", "d", ["id"]).collect() == []
