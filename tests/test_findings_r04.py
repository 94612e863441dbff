"""Cases of the fourth round of findings: each failed before its fix."""

import time
from pathlib import Path

import duckdb
import numpy as np
import pytest

from __spark_entry__ import queries
from palindra import catalog, catalog_pairs
from palindra.kernels import pairscore
from palindra.llm import storage, suffix_dedup
from palindra.operators import kernels, lineage, mapping, study
from tests.llm import fixture


def shuffle_files(spark):
    """The shuffle files of this application that lie on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in dirs for f in Path(d.getPath()).glob("*/shuffle_*.data")}


def test_steps_of_suffix_dedup_leave_no_files_behind(spark, monkeypatch):
    storage.release(spark)
    before, made, materialize = shuffle_files(spark), [], storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df, tag: (out := materialize(df, tag), made.append((tag, shuffle_files(spark) - before)))[0])
    out = suffix_dedup.dedup(fixture.frame(spark, fixture.corpus()))
    written = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in storage._WRITTEN[spark.sparkContext.applicationId]]
    assert [tag for tag, _ in made] == ["anchor-state", "windows", "repeat-runs"] and written == ["repeat-runs"]
    last = made[-1][1] - made[-2][1]
    for _ in range(50):  # files go in the background
        left = last & shuffle_files(spark)
        if not left:
            break
        time.sleep(0.1)
    assert last and not left and out.count() > 0


@pytest.mark.parametrize("ids", [(1, 2, 3, 4, 5), (1, 2, 2, 3, None)])
def test_places_of_short_peptides_have_no_row(spark, monkeypatch, ids):
    texts = ["GASPGASPWGASPGW", "GAßGASPGAW" + "A" * 45 + "S", "G", "", "WWW" + "A" * 41 + "GASPG"]
    asked = spark.createDataFrame([(x,) for x in ["GAS", "SPGA", "G", "GAß", "GASPG", "SPGASPW", "a", "WWW", "W" * 5, "A" * 40, ""]], "sequence string")
    proteins = spark.createDataFrame(list(zip(ids, texts)), "protein_id int, seq string")
    places = mapping.locate(asked, proteins).cache()
    want = sorted(map(tuple, mapping.coverage(places, proteins).collect())), sorted(map(tuple, mapping.depth(places).collect()), key=str)
    asked_for, marked_places = [], mapping.marked_places
    monkeypatch.setattr(mapping, "marked_places", lambda *args: (asked_for.append(args), marked_places(*args))[1])
    found = mapping.peptide_coverage(asked, proteins), mapping.peptide_depth(asked, proteins)
    assert (sorted(map(tuple, found[0].collect())), sorted(map(tuple, found[1].collect()), key=str)) == want
    assert bool(asked_for) == (None in ids)  # repeated ids have their places in several rows


@pytest.mark.parametrize("name", ["protein_coverage", "residue_depth", "coverage_summary"])
def test_queries_of_coverage_list_no_places(spark, monkeypatch, name):
    monkeypatch.setattr(mapping, "marked_places", None)
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("group", [4096, 7])
def test_peaks_are_sent_once_a_group_and_not_once_a_pair(spark, monkeypatch, group):
    monkeypatch.setattr(kernels, "GROUP", group)
    rng, n = np.random.default_rng(3), 24
    sides = []
    for s in range(2):
        rows = [(i, 1500.0 + s, [(m, w) for m, w in zip(rng.uniform(100, 1400, 200).tolist(), rng.uniform(1, 9, 200).tolist())]) for i in range(n)]
        sides.append(spark.createDataFrame([*rows, (n, 1500.0, None), (n + 1, 1500.0, [])], "id long, mass double, peaks array<struct<mz:double,inten:double>>"))
    pairs = spark.createDataFrame([(i, j, 1 + (i + j) % 9) for i in range(n + 1) for j in range(n + 3)], "a_id long, b_id long, type_code int")
    written = lambda: sum(f.stat().st_size for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).glob("*/shuffle_*.data"))
    before = written()
    found = {(r.a_id, r.b_id): tuple(r)[2:] for r in kernels.scored_pairs(pairs, *sides).collect()}
    assert written() - before < n * n * 200 * 16 // 2
    own = [{r.id: pairscore.Side.of(*(np.array(c, float) for c in (list(zip(*sorted(map(tuple, r.peaks)))) if r.peaks else [[], []])), r.mass) for r in t.collect()} for t in sides]
    assert found == {(r.a_id, r.b_id): pairscore.score_pair(own[0][r.a_id], own[1][r.b_id], r.type_code) for r in pairs.collect() if r.b_id < n + 2}


def test_pairs_are_sequenced_in_portions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog_pairs, "_PORTION", 8)
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/part.parquet' LIMIT 20) TO '{(folder := str(tmp_path))}/part.parquet'")
    portions, once = [], lineage.once
    monkeypatch.setattr(lineage, "once", lambda rows: (out := once(rows), portions.append((out.count(), shuffle_files(spark))))[0])
    found = sorted(map(tuple, catalog_pairs.denovo_sequence(spark, folder).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    assert found == sorted(con.sql(catalog.SQL["denovo_sequence"]).fetchall())
    assert len(portions) == 3 and sum(n for n, _ in portions) == 20
    # what a portion shuffled is gone when the next one has ended
    assert len(portions[0][1] & portions[1][1]) < len(portions[0][1]) / 2


@pytest.mark.parametrize("long", [False, True])
def test_writers_look_at_long_lists_row_by_row(spark, long):
    key = "parquet.page.size.row.check.min"
    try:
        of = spark.range(20_000 if long else 100).selectExpr("concat('form', id % 2) AS form", "concat('name', id) AS name")
        study.matching_rows(spark.createDataFrame([(1, "form0")], "k int, sequence string"), of)
        assert spark.conf.get(key, None) == ("1" if long else None)
    finally:
        for k in study._LONG_ROWS:
            spark.conf.unset(k)
