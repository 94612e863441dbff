"""Cases of the third round of findings: each failed before its fix."""

import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palindra import catalog, catalog_labels, catalog_pairs, catalog_study
from palindra.kernels import peaklists
from palindra.llm import line_dedup, memory, packing, storage
from palindra.operators import kernels, mapping, statistics, study
from tests.llm import fixture, test_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Line items of which many share order and line number, with other parts and flags."""
    folder = tmp_path_factory.mktemp("tied")
    (folder / "lineitem.parquet").mkdir()
    # the second file is the larger one, which Spark reads first
    for name, low, high in (("a", 0, 300), ("b", 300, 9000)):
        rows = f"SELECT i % 20 AS l_orderkey, CAST(1 + i // 20 % 2 AS INTEGER) AS l_linenumber, i % 5 AS l_partkey, CAST((i * 7) % 50 AS DOUBLE) AS l_quantity, chr(CAST(65 + (i * 11) % 17 AS INTEGER)) AS l_returnflag FROM range({low}, {high}) t(i)"
        duckdb.sql(f"COPY ({rows}) TO '{folder}/lineitem.parquet/{name}.parquet'")
    return str(folder)


def same_as_sql(spark, folder, name):
    con = duckdb.connect(config={"threads": 1})  # ties in the order of the files
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    mine = catalog.QUERIES[name](spark, folder).toPandas()
    return sorted(map(tuple, mine.values.tolist())) == sorted(con.sql(catalog.SQL[name]).fetchall())


def test_conflict_class_of_tied_lines_is_that_of_sql(spark, tied):
    assert same_as_sql(spark, tied, "conflict_class")


def test_merged_sequence_of_tied_lines_is_that_of_sql(spark, tied):
    assert same_as_sql(spark, tied, "merge_single_mirror")


@pytest.mark.parametrize("name", ["k_longest_paths", "beam_search"])
def test_equal_ladders_are_searched_once(spark, tmp_path, monkeypatch, name):
    duckdb.sql(f"COPY (SELECT i AS p_partkey, ['hot bolt', 'blue ring'][i % 2 + 1] AS p_name, 'SMALL' AS p_type FROM range(40) t(i)) TO '{tmp_path}/part.parquet'")
    asked, searched = [], kernels.sequenced
    monkeypatch.setattr(kernels, "sequenced", lambda rows, *args: (asked.append(rows.count()), searched(rows, *args))[1])
    found = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert asked == [2] and sorted(r.spectrum for r in found) == list(range(40))


def test_equal_answers_are_compared_once(spark):
    rows = spark.createDataFrame([("GAVL", "AGVL")] * 30 + [("GAVL", "GAVL")] * 2, "target string, found string")
    out = study.residue_accuracy(rows)
    assert out.first().asDict() == {"n_match": 68, "n_target": 128, "n_found": 128, "n_whole": 2, "recall": 0.53125, "precision": 0.53125}
    # the comparison stands above the grouping by both sequences
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [target#" in plan


def test_differences_are_counted_where_the_lists_lie(spark):
    plan = catalog.delta_histogram(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate [a_id" not in plan


def test_local_ranks_are_counted_in_arrays(spark):
    rng = np.random.default_rng(1)
    peaks = sorted(zip(rng.integers(0, 4000, 3000).tolist(), rng.integers(1, 9, 3000).tolist()))
    rows = spark.createDataFrame([(1, peaks), (2, []), (3, None), (4, peaks[:1])], "spectrum int, peaks array<struct<mz:int,inten:int>>")
    found = {r.spectrum: list(r.higher) for r in kernels.local_ranks(rows, 100.0).collect()}
    mz, inten = np.array(peaks, float).T
    assert found[1] == [int((inten[np.abs(mz - m) <= 100] > h).sum()) for m, h in zip(mz, inten)]
    assert found[2] == [] and found[3] == [] and found[4] == [0]
    assert "MapInArrow" in catalog.peak_local_rank(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_of_many_peaks_take_a_short_time():
    rng = np.random.default_rng(2)
    mz, inten = np.sort(rng.uniform(100, 1500, 30_000)), rng.uniform(1, 50, 30_000)
    began = time.process_time()
    cluster, charge = peaklists.isotope_clusters(mz, inten, 3)
    peaklists.collapse_losses(*peaklists.deconvolve(mz, inten, cluster, charge))
    assert time.process_time() - began < 1.4


def test_peaks_are_laid_out_once_a_spectrum(spark):
    rows = spark.createDataFrame([(k, 1 + k % 3, "GAVLK", 2) for k in range(60)], "id int, spectrum int, seq string, charge int")
    own = spark.createDataFrame([(1, [(58.03, 5.0), (147.11, 2.0)]), (2, [(129.066, 3.0)])], "spectrum int, peaks array<struct<mz:double,inten:double>>")
    sent = study.site_evidence(rows, "id", 200.0, own)
    joined = study.site_evidence(rows.join(own, "spectrum"), "id", 200.0)
    assert sorted(sent.collect()) == sorted(joined.collect()) and sent.count() == 160
    plan = catalog_study.site_evidence(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Union" in plan


def test_places_of_short_peptides_are_not_shuffled(spark):
    proteins = spark.createDataFrame([(1, "GASPGASP"), (2, "GAßGAS"), (3, "G"), (4, "AGAS")], "protein_id int, seq string")
    asked = ["GAS", "SPGA", "G", "GAß", "GASPG", "a", "ZZZZ"]
    places = mapping.locate(spark.createDataFrame([(x,) for x in asked], "sequence string"), proteins)
    own = {r.protein_id: r.seq for r in proteins.collect()}
    assert sorted(map(tuple, places.collect())) == sorted((x, i, at, at + len(x)) for x in asked for i, t in own.items() for at in range(len(t)) if t.startswith(x, at))
    few = mapping.locate(spark.createDataFrame([("GAS",), ("SPGA",)], "sequence string"), proteins)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "fixed"), [("pair_site_scores", 0), ("denovo_sequence", 1)])
def test_pairs_are_not_broadcast(spark, name, fixed):
    # what is broadcast is the dictionary of compositions, of a fixed size, wherever the plan reads it
    plan = getattr(catalog_pairs, name)(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("mda#" in line for line in joins) and bool(joins) == bool(fixed)


def _all_links(rows):
    """doc_id -> links of its distinct word sets with other sets of the corpus."""
    sets = {}
    for i, text, *_ in rows:
        for words in {frozenset(fixture.WORDS.findall(x)) for x in (text or "").split("\n")} - {frozenset()}:
            sets.setdefault(words, set()).add(i)
    out = dict.fromkeys((i for i, *_ in rows), 0)
    for a, docs in sets.items():
        n = sum(a != b and 5 * len(a & b) >= 4 * len(a | b) for b in sets)
        for i in docs:
            out[i] += n
    return out


@pytest.mark.parametrize("longest", [8192, 16, 1])
def test_links_of_lines_other_than_the_earliest_match_are_counted(spark, longest):
    base = [f"word{k}" for k in range(12)]
    lines = [" ".join(base[:11] + [f"own{k}"]) for k in range(6)]
    rows = [(k, f"{x}\n{x}\n" + " ".join(reversed(x.split())), *[None] * 5) for k, x in enumerate([*lines, lines[2], "lone line"])]
    rows += [(8 + i, *r) for i, *r in test_documents.crowded_lines()]
    found = line_dedup.dedup(fixture.frame(spark, rows), longest=longest, every=True).collect()
    want = _all_links(rows)
    assert {r.doc_id: r.n_similar for r in found} == want
    assert want[2] == want[6] == 5 and want[7] == 0
    plain = test_documents.brute_lines(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.class_id, r.text) for r in found} == plain


def test_anchors_are_found_where_the_lists_lie(spark):
    plan = catalog_pairs.pair_anchors(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Generate" not in plan and "Aggregate" not in plan


def test_doublets_are_merged_where_the_lists_lie(spark):
    plan = catalog_labels.doublet_merge(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Join" not in plan


def test_equal_spectra_are_judged_once(spark, tmp_path, monkeypatch):
    # noise and intensities repeat every 15,000 keys, so the last forty parts are copies of the first
    duckdb.sql(f"COPY (SELECT i % 40 + i // 40 * 30000 AS p_partkey, ['hot bolt', 'blue ring'][i % 2 + 1] AS p_name, 'SMALL' AS p_type, CAST(i % 40 % 3 AS DOUBLE) AS p_retailprice FROM range(80) t(i)) TO '{tmp_path}/part.parquet'")
    asked, scored = [], kernels.scored_pairs
    monkeypatch.setattr(kernels, "scored_pairs", lambda pairs, *args: (asked.append(pairs.count()), scored(pairs, *args))[1])
    found = [tuple(r) for r in catalog_pairs.judge_type(spark, str(tmp_path)).collect()]
    assert asked[0] > 0 and len(found) == 4 * asked[0] == len(set(found))
    copies = lambda r: {(r[0] % 30000 + x, r[1] % 30000 + y, *r[2:]) for x in (0, 30000) for y in (0, 30000)}
    assert all(copies(r) <= set(found) for r in found)


def test_lists_of_matching_rows_are_written_once(spark, tmp_path):
    # 30 forms of 6,000 names each: their lists do not fit into one dictionary of a Parquet file together
    of = spark.range(180_000).selectExpr("concat('form', id % 30) AS form", "concat('name', id) AS name")
    rows = spark.range(310).selectExpr("id", "concat('form', (id * 7) % 31) AS sequence").repartition(4)
    study.matching_rows(rows, of).write.parquet(f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out")
    want = {k: ",".join(sorted(f"name{i}" for i in range(k, 180_000, 30))) for k in range(30)}
    assert sorted(r.id for r in found.select("id").collect()) == list(range(310))
    assert all(r.matches == want.get(r.id * 7 % 31, "") and r.sequence == f"form{r.id * 7 % 31}" for r in found.toLocalIterator())
    assert sum(f.stat().st_size for f in (tmp_path / "out").iterdir()) < 3 * sum(map(len, want.values()))


@pytest.mark.parametrize("piece", [1 << 29, 50])
def test_matching_rows_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(study, "_PIECE", piece)
    of = spark.createDataFrame([("a", "2"), ("a", "10"), ("b", "x"), (None, "y")], "form string, name string")
    rows = spark.createDataFrame([(k, x) for k in range(40) for x in ("a", "b", "c", None)] + [(0, "a")], "k int, sequence string")
    want = {"a": "10,2", "b": "x"}
    assert sorted(map(tuple, study.matching_rows(rows, of).collect()), key=str) == sorted(((r.k, r.sequence, want.get(r.sequence, "")) for r in rows.collect()), key=str)


@pytest.mark.parametrize("longest", [8192, 64])
def test_links_of_near_copies_are_counted_without_a_table_of_pairs(spark, monkeypatch, longest):
    near = [" ".join([*(f"word{k}" for k in range(20)), f"own{i}"]) for i in range(300)]
    # the first common word of these stands beyond the places that a posting keeps
    far = [" ".join([*(f"own{i}x{k}" for k in range(260)), *(f"all{k}" for k in range(2340))]) for i in range(3)]
    rows = [(i, x, *[None] * 5) for i, x in enumerate([*near, *far, near[0]])]
    written, write = [], storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df, tag: (out := write(df, tag), written.append((tag, out.count())))[0])
    found = {r.doc_id: (r.n_similar, r.n_removed, r.class_id) for r in line_dedup.dedup(fixture.frame(spark, rows), longest=longest, every=True).collect()}
    assert all(found[i] == (299, int(i > 0), 0) for i in [*range(300), 303])
    assert [found[i] for i in (300, 301, 302)] == [(2, 0, 300), (2, 1, 300), (2, 1, 300)]
    assert max(n for _, n in written) < 300 * 299 // 4, written


def test_later_passes_do_not_hold_the_encoders_of_an_earlier_one(spark):
    """Every worker kept a tokenizer and up to 400,000 pieces while windows were packed."""

    def held(batches):
        from palindra.llm import tokens

        n = len(tokens._ENCODERS)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    encoded = packing.encode(fixture.frame(spark, fixture.corpus(), 8))
    before = spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()
    packing.statistics(encoded)
    after = spark.range(0, 8, 1, 8).mapInArrow(memory.lean(held), "n long").collect()
    assert any(r.n for r in before) and not any(r.n for r in after)


@pytest.mark.parametrize("shape", ["even", "one value", "far", "not a number"])
def test_q_values_sort_their_rows_once(spark, shape):
    """Every branch of the plan sorted all rows, in ranges named by a tree of all comparisons."""
    r = np.random.default_rng(5)
    n = 3000
    t, d = (np.round(r.random(n), 2).tolist() for _ in "td")
    if shape == "one value":
        t[: n // 2] = d[: n // 2] = [0.25] * (n // 2)
    elif shape == "far":
        t[:5] = d[:5] = [-1e300, 1e300, 1e18, float("inf"), float("-inf")]
    elif shape == "not a number":
        t[:7] = d[3:10] = [float("nan")] * 7
    t = [None if i % 97 == 0 else x for i, x in enumerate(t)]  # a null target makes a decoy, as in SQL
    size = lambda x: (x != x, 0 if x != x else x)  # noqa: E731  (NaN is the greatest)
    ranked = sorted((min(size(x) for x in (a, b) if x is not None), i, a is not None and size(a) < size(b)) for i, (a, b) in enumerate(zip(t, d)))
    hits = np.cumsum([hit for _, _, hit in ranked])
    fdr = (1 + np.arange(1, n + 1) - hits) / np.maximum(hits, 1)
    q = np.minimum.accumulate(fdr[::-1])[::-1]
    out = statistics.q_values(spark.createDataFrame(list(zip(range(n), t, d)), "id long, t double, d double"), "t", "d", ["id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1  # of one row a range
    assert sorted((x.id, x.fdr, x.q) for x in out.collect()) == sorted((i, f, m) for (_, i, _), f, m in zip(ranked, fdr, q))
