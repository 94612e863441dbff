"""Text sources and sinks, plans and streaming on small files."""

import random

import pytest
from pyspark.sql import functions as F

from palindra import chemistry
from palindra.config import Config
from palindra.functions import peaks as P
from palindra.functions import registry
from palindra.functions import sequences as S
from palindra.kernels import sequencing
from palindra.operators import kernels, mapping, recall
from palindra.plans import workflow
from palindra.sources import readers, results, stores, writers
from palindra.streaming import events

MGF = """BEGIN IONS
TITLE=run.5.5.2.0.dta
CHARGE=2+
RTINSECONDS=12.5
PEPMASS=500.25 1000
100.5 10
0.5 3
200.5 20
END IONS
BEGIN IONS
TITLE=run.5.5.3.1.dta
CHARGE=3+
RTINSECONDS=12.5
PEPMASS=333.8
300.5 30
END IONS
BEGIN IONS
TITLE=run.6.6.2.0.dta
CHARGE=2+
RTINSECONDS=13
PEPMASS=400
END IONS
"""


def test_mgf(spark, tmp_path):
    (tmp_path / "a.mgf").write_text(MGF)
    got = {r.title: r for r in readers.mgf(spark, str(tmp_path / "a.mgf")).collect()}
    assert [(p.mz, p.inten) for p in got["run.5.5.2.0.dta"].peaks] == [(100.5, 10.0), (200.5, 20.0)]
    assert got["run.5.5.3.1.dta"].peaks == got["run.5.5.2.0.dta"].peaks and got["run.5.5.3.1.dta"].scan == 5
    assert got["run.6.6.2.0.dta"].peaks == []
    assert got["run.5.5.2.0.dta"].mh == pytest.approx((500.25 - chemistry.PROTON) * 2 + chemistry.PROTON)
    writers.mgf(readers.mgf(spark, str(tmp_path / "a.mgf")), str(tmp_path / "out"))
    again = {r.title: r for r in readers.mgf(spark, str(tmp_path / "out")).collect()}
    assert {t: (r.charge, r.peaks, r.prec_mz) for t, r in again.items()} == {t: (r.charge, r.peaks, r.prec_mz) for t, r in got.items()}


def test_fasta_and_mapping(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">p1 first\nMKIL\nVAAAK\n>p2\nAAAA\n")
    proteins = readers.fasta(spark, str(tmp_path / "a.fa"), whole_header=False)
    assert {r.protein_id: r.seq for r in proteins.collect()} == {"p1": "MKLLVAAAK", "p2": "AAAA"}
    peptides = spark.createDataFrame([("LLVAA",), ("AAA",), ("AAAA",), ("ZZZZZ",), ("",), ("MKLLVAAAK",)], "sequence string")
    got = {tuple(r) for r in mapping.locate(peptides, proteins).collect()}
    want = {(s, p, i, i + len(s)) for s in ("LLVAA", "AAA", "AAAA", "MKLLVAAAK") for p, q in (("p1", "MKLLVAAAK"), ("p2", "AAAA")) for i in range(len(q)) if q.startswith(s, i)}
    assert got == want
    assert [r.covered for r in mapping.coverage(mapping.locate(peptides, proteins), proteins).orderBy("protein_id").collect()] == [9, 4]


def test_candidates_and_report(spark, tmp_path):
    (tmp_path / "c.txt").write_text("s1\tm1\tA1:K-K\n\t1\tPEP\t\t0.9\n\t2\tPEP\t1,Ox;\t0.95\ns2\tm2\tD: K-X\n\t1\tTLDE\t\t0.5\ns3\tm3\tA1:K-K\n")
    got = results.candidates(spark, str(tmp_path / "c.txt"))
    assert {(r.title, r.mirror_anno, r.rank, r.sequence, r.score) for r in got.collect()} == {("s1", "A1:K-K", 1, "PEP", 0.9), ("s1", "A1:K-K", 2, "PEP", 0.95), ("s2", "D: K-X", 1, "TLDE", 0.5)}
    assert {(r.title, r.sequence, r.score, r["rank"]) for r in writers.report(got).collect()} == {("s1", "PEP", 0.95, 1), ("s2", "TLDE", 0.5, 1)}


def test_dictionaries():
    assert readers.elements("C|12.0,13.00335,|0.988,0.011,|\n") == {"C": ([12.0, 13.00335], [0.988, 0.011])}
    mods = readers.modifications("@NUMBER_MODIFICATION=1\nname1=Oxidation[M] 1\nOxidation[M]=M NORMAL 15.994915 15.9994 0 O(1)\n")
    assert mods == {"Oxidation[M]": ("M", "NORMAL", 15.994915, "O(1)", True)}


def test_anchors_and_empty_lists(spark):
    rows = spark.createDataFrame([(1, [(300.0, 5.0), (100.0, 9.0)]), (2, [])], "id int, peaks array<struct<mz double, inten double>>")
    got = {r.id: r.p for r in rows.select("id", P.anchored(F.col("peaks"), F.lit(900.0)).alias("p")).collect()}
    assert len(got[1]) == 6 and {p.inten for p in got[1][:2]} == {9.0} and got[2] == []
    assert {r.id: len(r.p) for r in rows.select("id", P.top(F.col("peaks"), 1).alias("p")).collect()} == {1: 1, 2: 0}


def test_sequence_functions(spark):
    row = spark.range(1).select(S.applied(F.lit("PEM"), F.lit("3,Ox;")).alias("a"), S.stripped(F.lit("IM(+15.99)J")).alias("b"), S.covered_text(F.lit("ABC"), F.array(F.lit(1))).alias("c"), S.half_up(F.lit(-2.5)).alias("d"), S.base_name(F.lit("/x/run.mgf")).alias("e")).first()
    assert tuple(row) == ("PEM(Ox)", "LMM", "AbC", -3, "run")
    assert registry.register(spark) == ["mh", "peptide_mass", "leucine"]
    assert spark.sql("SELECT peptide_mass('PEPTIDE') AS m, leucine('IL') AS l, mh(500D, 2) AS h").first().l == "LL"


def _spectra(spark, sequences):
    rows = []
    for k, s in enumerate(sequences):
        b, y = sequencing.ladder(s)
        rows.append((k, chemistry.peptide_mass(s), 10.0 * k, [(float(m), 50.0) for m in sorted([*b, *y])]))
    return spark.createDataFrame(rows, "id long, mh double, rt double, peaks array<struct<mz double, inten double>>")


def test_pairing_finds_the_mirror(spark):
    a = _spectra(spark, ["PEPTLDEGASKAAGLK", "GAVPEPTLDSYYGHK"])
    b = _spectra(spark, ["KPEPTLDEGASKAAGL", "WWPHDCDGVVNMDDA"])
    pairs = workflow.pair(workflow.clean(a), workflow.clean(b)).collect()
    assert {(p.a_id, p.b_id) for p in pairs if p.a_id == 0} == {(0, 0)}
    decoys = workflow.pair(workflow.clean(a), workflow.clean(b), Config(decoy_mode=3)).collect()
    assert {p.a_id for p in decoys} == {p.a_id for p in pairs} and all(p.target_p == float("inf") and p.target_score == 0 for p in decoys)
    plain = workflow.pair(workflow.clean(a), workflow.clean(b), Config(decoy_mode=0)).collect()
    assert {(p.a_id, p.target_p, p.decoy_p) for p in plain} == {(p.a_id, p.target_p, float("inf")) for p in pairs}
    shifted = a.withColumn("mh", F.col("mh") - 15.0)
    assert workflow.pair(workflow.clean(shifted), workflow.clean(b), Config(decoy_mode=1)).count() == len(pairs)
    assert workflow.pair(workflow.clean(a), workflow.clean(b), Config(mass_low=3000.0)).count() == 0
    found = workflow.sequence(_spectra(spark, ["PEPTLDEK"]).select(F.col("id").alias("spectrum"), F.col("mh").alias("mass"), "peaks"), spark.createDataFrame([("p", "AAPEPTLDEKAA")], "protein_id string, seq string"))
    assert "T" in {r.tag for r in found.collect()}


def test_clusters_become_single_peaks(spark):
    """A doubly charged cluster is one peak of charge one; null and empty lists, other columns and order of rows stay."""
    cluster = [(500.0 + k * chemistry.NEUTRON / 2, 100.0 - 30 * k) for k in range(3)]
    rows = spark.createDataFrame([(1, cluster[::-1], "x"), (2, None, None), (3, [], "z")], "id long, peaks array<struct<mz double, inten double>>, extra string").coalesce(1)
    out = {r.id: r for r in kernels.deisotoped(rows).collect()}
    assert {k: r.extra for k, r in out.items()} == {1: "x", 2: None, 3: "z"}
    assert out[2].peaks == out[3].peaks == []
    assert len(out[1].peaks) == 1 and abs(out[1].peaks[0].mz - (2 * 500.0 - chemistry.PROTON)) < 1e-6
    with pytest.raises(ValueError):
        Config(fragment_ppm=False)


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 day", "60 days", "event_type")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in events.tumbling(rows, "ts", "1 day", "60 days", "event_type").collect()}
    a, b = _spectra(spark, ["PEPTLDEGASKAAGLK"]), _spectra(spark, ["KPEPTLDEGASKAAGL"])
    a.write.parquet(str(tmp_path / "a"))
    q = events.paired(spark.readStream.schema(a.schema).parquet(str(tmp_path / "a")), b).writeStream.format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pairs").count() == recall.mirror_candidates(a, b).count() == 1


def test_headers_are_carried_over_ranges_of_a_file(spark, tmp_path):
    r = random.Random(3)
    want = []
    for name in ("a.txt", "b.txt"):
        lines = ["\t9\tORPHAN\t\t0.1"] if name == "b.txt" else []
        if lines:
            want.append((None, 9, "ORPHAN"))
        for k in range(120):
            title = f"{name}.{k}"
            lines.append(f"{title}\tm{k}\tD: K-X")
            for n in range(1, r.choice([1, 2, 30])):
                lines.append(f"\t{n}\tPEP{'A' * n}\t1,Ox;\t{n / 8}\t0.5,0.25")
                want.append((title, n, f"PEP{'A' * n}"))
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    few = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = results.candidates(spark, [str(tmp_path / n) for n in ("a.txt", "b.txt")])
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", few)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(((x.title, x["rank"], x.sequence) for x in got), key=str) == sorted(want, key=str)
    assert {(x.modifications, tuple(x.aa_scores)) for x in got if x.title} == {("1,Ox;", (0.5, 0.25))}


def test_other_tools_results(spark, tmp_path):
    (tmp_path / "c.mztab").write_text("MTD\tx\nPSH\tsequence\tPSM_ID\tsearch_engine_score[1]\tspectra_ref\nPSM\tPEC+57.021IM+15.995K\t1\t0.5\tms_run[1]:index=7\nPSM\tAAK\t2\t0.75\tms_run[1]:index=7\nPSM\t+42.011AK\t3\tnull\tms_run[1]:index=8\n")
    got = {(x.title, x["rank"]): (x.sequence, x.score) for x in results.mztab(spark, str(tmp_path / "c.mztab")).collect()}
    assert got == {("ms_run[1]:index=7", 1): ("AAK", 0.75), ("ms_run[1]:index=7", 2): ("PEC(+57.02)LM(+15.99)K", 0.5), ("ms_run[1]:index=8", 1): (None, None)}
    (tmp_path / "p.csv").write_text("scan,score,sequence,title\n1,0.5,AIC(+57.02)K,t1\n2,0.5,AM(+3.1)K,t2\n")
    assert {tuple(x) for x in results.tool_table(spark, str(tmp_path / "p.csv"), "title_last").collect()} == {("t1", "ALC(+57.02)K"), ("t2", None)}
    (tmp_path / "q.tsv").write_text("title\tprediction\nt1\tIC[+57.021]M[+15.995]\nt2\tA[+1]K\n")
    assert {tuple(x) for x in results.tool_table(spark, str(tmp_path / "q.tsv"), "square_brackets").collect()} == {("t1", "LC(+57.02)M(+15.99)"), ("t2", None)}
    (tmp_path / "r.tsv").write_text("feature\tx\toutput_seq\nt1\t0\tA,I,M(Oxidation)\nt2\t0\tN(Deamidation),K\n")
    assert {tuple(x) for x in results.tool_table(spark, str(tmp_path / "r.tsv"), "named_brackets").collect()} == {("t1", "ALM(+15.99)"), ("t2", None)}
    (tmp_path / "s.txt").write_text("S1\tt1\nP1\tAaCK\t0.9\nP2\tAAK\t0.1\n\nS2\tt2\n\n")
    assert {(x.title, x["rank"], x.sequence, x.score) for x in results.blocks(spark, str(tmp_path / "s.txt")).collect()} == {("t1", 1, "AM(+15.99)C(+57.02)K", 0.9), ("t1", 2, "AAK", 0.1)}
    (tmp_path / "v.tsv").write_text("Protein\tCoverage_AA_num\tTotal_AA_num\tCoverage_rate\np1\t5\t10\t0.5\nmean\t-\t-\t0.5\n")
    assert [tuple(x) for x in results.coverage_table(spark, str(tmp_path / "v.tsv")).collect()] == [("p1", 5, 10, 0.5)]


def block(title, peaks="100.5 7\n", more=""):
    return f"BEGIN IONS\nTITLE={title}\nCHARGE=2+\nRTINSECONDS=1.5\nPEPMASS=400.5\n{more}{peaks}END IONS\n"


def test_label_lines_are_read(spark, tmp_path):
    more = "NEUCODELABEL=01\nUNFILTERED=1,0\nISOTOPE_CLUSTER=1,0\nISOTOPE_CHARGE=2,0\n"
    (tmp_path / "a.mgf").write_text(block("f.1.1.2.0.dta", "100.5 7\n101.5 3\n", more) + block("f.2.2.2.0.dta"))
    got = {x.scan: x for x in readers.mgf(spark, str(tmp_path / "a.mgf"), labels=True).collect()}
    assert (got[1].doublets, got[1].kept, got[1].clusters, got[1].charges) == ([0, 1], [1, 0], [1, 0], [2, 0]) and got[2].kept is None


def test_only_changed_files_are_parsed(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    one, two = tmp_path / "in" / "one.mgf", tmp_path / "in" / "deep" / "two.MGF"
    one.write_text(block("f.1.1.2.0.dta"))
    two.write_text(block("f.2.2.2.0.dta"))
    (tmp_path / "in" / "note.txt").write_text("no spectra")
    listed, cache = f"{tmp_path / 'in'}|{one}", str(tmp_path / "cache")
    assert stores.files(spark, listed).count() == 2
    scans = lambda: sorted(x.scan for x in stores.cached_spectra(spark, listed, cache).collect())
    manifest = lambda: [x.batch for x in spark.read.parquet(f"{cache}/manifest").collect()]
    assert scans() == [1, 2] and len(set(manifest())) == 1
    assert scans() == [1, 2] and len(manifest()) == 2
    two.write_text(block("f.2.2.2.0.dta") + block("f.3.3.2.0.dta"))
    assert scans() == [1, 2, 3] and len(manifest()) == 3 and len(set(manifest())) == 2
    one.unlink()
    assert sorted(x.scan for x in stores.cached_spectra(spark, str(tmp_path / "in"), cache).collect()) == [2, 3] and len(manifest()) == 3
    with pytest.raises(ValueError):
        stores.files(spark, " | ")


def test_few_titles_read_few_rows(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("title"), F.lit(1).alias("scan"))
    stores.write_titles(rows, str(tmp_path / "t"), 100)
    got = stores.by_titles(spark, str(tmp_path / "t"), ["t000007", "t003999", "absent"])
    assert sorted(x.title for x in got.collect()) == ["t000007", "t003999"]
    leaves = got._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.apply(0).metrics().get("numOutputRows").get().value() <= 2100


def test_two_level_writers_round_trip(spark, tmp_path):
    pairs = [(k % 2, k % 3, f"a{k}", f"b{k}", 500.0 + k, 600.0, 2, 3, "D: K-X") for k in range(30)]
    found = [(f"a{k}", f"b{k}", n, 500.5, "PEPK", "", 1.0 / n, [0.5, 0.25]) for k in range(29) for n in (1, 2)]
    p = spark.createDataFrame(pairs, "a_data_idx int, b_data_idx int, a_title string, b_title string, a_mass double, b_mass double, a_charge int, b_charge int, mirror_anno string")
    c = spark.createDataFrame(found, "a_title string, b_title string, rank int, calc_mh double, sequence string, modifications string, score double, aa_scores array<double>")
    writers.pair_candidates(p, c, str(tmp_path / "out"))
    texts = [f.read_text() for f in (tmp_path / "out").rglob("part-*.txt")]
    assert all(t.startswith("a_title\tb_title\t") and t.count("a_title") == 1 for t in texts) and len({f.parent.parent for f in (tmp_path / "out").rglob("part-*.txt")}) == 6
    rows = results.under_headers(spark, str(tmp_path / "out"), r"[^\t]", r"\t\d").collect()
    assert len(rows) == 58 and {x.header.split("\t")[0] for x in rows} == {f"a{k}" for k in range(29)}
    assert any(line.startswith("a29\tb29\t529.00000\t600.00000\t2\t3\tD: K-X") for t in texts for line in t.splitlines())
    writers.single_candidates(spark.createDataFrame([("a1",), ("a2",), ("none",)], "title string"), c.withColumnRenamed("a_title", "title").where("title IN ('a1', 'a2')"), str(tmp_path / "single"))
    back = results.candidates(spark, str(tmp_path / "single")).collect()
    assert {(x.title, x["rank"], x.sequence) for x in back} == {(t, n, "PEPK") for t in ("a1", "a2") for n in (1, 2)}
