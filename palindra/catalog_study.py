"""Queries of the study operators over the driver's tables, with their SQL twins; part names stand for peptides."""

from __future__ import annotations

from pyspark.sql import functions as F

from palindra import chemistry
from palindra.catalog import _CUT_SQL, _LETTERS, _MAPPED, _PEAKS, peptides, proteins, query, spectra, table
from palindra.functions import ions
from palindra.functions import sequences as S
from palindra.operators import mapping, merging, study

_SEQ = "translate(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), 'IBJOUXZ', 'LAAAAAA')"
_PART = f"s AS (SELECT p_partkey, {_SEQ} AS seq, p_size, p_retailprice FROM part)"
_RESIDUES = ", ".join(f"('{a}', {m!r}::DOUBLE)" for a, m in chemistry.RESIDUES.items())
_PREFIX = (
    f"r(c, m) AS (VALUES {_RESIDUES}), l AS (SELECT p_partkey, unnest(range(1, length(seq) + 1)) AS i, seq FROM s), "
    "w AS (SELECT p_partkey, i, length(seq) AS n, substr(seq, i, 1) AS c, sum(m) OVER (PARTITION BY p_partkey ORDER BY i) AS m, sum(m) OVER (PARTITION BY p_partkey) AS total FROM l JOIN r ON r.c = substr(seq, i, 1))"
)
_P, _W = f"{chemistry.PROTON!r}::DOUBLE", f"{chemistry.WATER!r}::DOUBLE"


def part(spark, sf_dir):
    seq = F.translate(F.regexp_replace(F.upper("p_name"), "[^A-Z]", ""), "IBJOUXZ", "LAAAAAA")
    return table(spark, sf_dir, "part").select("p_partkey", seq.alias("seq"), "p_size", "p_retailprice", "p_name")


@query(
    f"WITH {_PART}, {_PREFIX} SELECT p_partkey, CAST(i AS INTEGER) AS site, round(m + {_P}, 4) AS b, round(total - m + {_W} + {_P}, 4) AS y, round(m + {_P} - {chemistry.CO!r}::DOUBLE, 4) AS a, "
    f"round((m + 2 * {_P}) / 2, 4) AS b2, round((total - m + {_W} + 2 * {_P}) / 2, 4) AS y2, round(m + {_P} - {_W}, 4) AS b_water, round(total - m + {_P}, 4) AS y_water, "
    f"round(m + {_P} - {chemistry.AMMONIA!r}::DOUBLE, 4) AS b_ammonia, round(total - m + {_W} + {_P} - {chemistry.AMMONIA!r}::DOUBLE, 4) AS y_ammonia FROM w WHERE i < n"
)
def theoretical_ions(spark, sf_dir):
    """Fragment ions of every cleavage site."""
    rows = part(spark, sf_dir).select("p_partkey", F.explode(ions.ladder(F.col("seq"))).alias("x")).select("p_partkey", "x.*")
    return rows.select("p_partkey", "site", *(F.round(c, 4).alias(c) for c in rows.columns[2:]))


_MATCH = (
    f"WITH {_PART}, {_PREFIX}, f AS (SELECT p_partkey, substr(seq, 1, p_size % 8) || reverse(substr(seq, p_size % 8 + 1, 2)) || substr(seq, p_size % 8 + 3) AS seq FROM s), "
    "l2 AS (SELECT p_partkey, unnest(range(1, length(seq) + 1)) AS i, seq FROM f), w2 AS (SELECT p_partkey, substr(seq, i, 1) AS c, sum(m) OVER (PARTITION BY p_partkey ORDER BY i) AS m FROM l2 JOIN r ON r.c = substr(seq, i, 1)), "
    "h AS (SELECT w.p_partkey, count(*) AS n FROM w JOIN w2 ON w2.p_partkey = w.p_partkey AND abs(w.m - w2.m) < 0.05 AND w.c = w2.c GROUP BY w.p_partkey), "
    "q AS (SELECT s.p_partkey, CAST(coalesce(h.n, 0) AS INTEGER) AS n_match, CAST(length(s.seq) AS INTEGER) AS n_target, CAST(length(f.seq) AS INTEGER) AS n_found FROM s JOIN f ON f.p_partkey = s.p_partkey LEFT JOIN h ON h.p_partkey = s.p_partkey) "
)


def _answers(spark, sf_dir):
    """(p_partkey, target, found): found has two neighbouring residues exchanged."""
    at = F.col("p_size") % 8
    found = F.concat(F.substr("seq", F.lit(1), at), F.reverse(F.substr("seq", at + 1, F.lit(2))), F.substr("seq", at + 3))
    return part(spark, sf_dir).select("p_partkey", F.col("seq").alias("target"), found.alias("found"))


@query(_MATCH + "SELECT * FROM q")
def residue_match(spark, sf_dir):
    """Residues at equal prefix masses in both sequences."""
    rows = _answers(spark, sf_dir)
    return rows.select("p_partkey", ions.residue_matches(F.col("target"), F.col("found")).alias("n_match"), F.length("target").alias("n_target"), F.length("found").alias("n_found"))


@query(
    _MATCH + "SELECT CAST(sum(n_match) AS BIGINT) AS n_match, CAST(sum(n_target) AS BIGINT) AS n_target, CAST(sum(n_found) AS BIGINT) AS n_found, count(CASE WHEN n_match = n_target AND n_match = n_found THEN 1 END) AS n_whole, "
    "round(CAST(sum(n_match) AS DOUBLE) / sum(n_target), 6) AS recall, round(CAST(sum(n_match) AS DOUBLE) / sum(n_found), 6) AS precision FROM q"
)
def residue_accuracy(spark, sf_dir):
    return study.residue_accuracy(_answers(spark, sf_dir))


@query(
    f"WITH {_PART}, {_PREFIX}, z AS (SELECT max(l_suppkey) AS last FROM lineitem), p AS (SELECT p_partkey, i, p_partkey % last + 1 AS spectrum, p_partkey % 2 > 0 AS many, m + {_P} AS b, total - m + {_W} + {_P} AS y FROM w, z WHERE i < n), "
    "k AS (SELECT l_suppkey, 100 + l_extendedprice / 60 AS mz, CAST(l_quantity AS DOUBLE) AS inten FROM lineitem), "
    f"v AS (SELECT p_partkey, i, spectrum, unnest([b, y, CASE WHEN many THEN (b + {_P}) / 2 END, CASE WHEN many THEN (y + {_P}) / 2 END]) AS ion_mz, unnest([1, 2, 3, 4]) AS u FROM p), "
    "x AS (SELECT v.p_partkey, v.i, v.u, arg_min(k.inten, (abs(k.mz - v.ion_mz), k.inten)) AS inten FROM v JOIN k ON k.l_suppkey = v.spectrum AND abs(k.mz - v.ion_mz) <= v.ion_mz * 200 * 1e-6::DOUBLE GROUP BY ALL) "
    "SELECT p.p_partkey, CAST(p.i AS INTEGER) AS site, CAST(count(x.u) > 0 AS INTEGER) AS tag, round(coalesce(sum(x.inten), 0), 4) AS inten FROM p LEFT JOIN x ON x.p_partkey = p.p_partkey AND x.i = p.i GROUP BY p.p_partkey, p.i"
)
def site_evidence(spark, sf_dir):
    """Evidence of every part's cleavage sites in one of the spectra, at 200 ppm; odd parts have ions of charge two."""
    rows = part(spark, sf_dir).select("p_partkey", "seq", (2 + F.col("p_partkey") % 2).alias("charge"))
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_suppkey").alias("c"))  # one row
    rows = rows.crossJoin(F.broadcast(last)).withColumn("spectrum", F.col("p_partkey") % F.col("c") + 1)
    found = study.site_evidence(rows, "p_partkey", 200.0, spectra(spark, sf_dir).select("spectrum", "peaks"))
    return found.select("p_partkey", "site", "tag", F.round("inten", 4).alias("inten"))


@query(f"WITH {_PEAKS}, r AS (SELECT *, row_number() OVER (PARTITION BY spectrum ORDER BY inten DESC, mz DESC, k DESC, j DESC) / CAST(count(*) OVER (PARTITION BY spectrum) AS DOUBLE) AS share FROM p) SELECT spectrum, k, j, round(7 * exp(-7 * share), 8) AS density FROM r")
def intensity_density(spark, sf_dir):
    """Exponential density of each peak's rank among all of its spectrum."""
    ranked = F.reverse(F.array_sort(F.transform("peaks", lambda p: F.struct(p.inten.alias("inten"), p.mz.alias("mz"), p.k.alias("k"), p.j.alias("j")))))
    rows = spectra(spark, sf_dir).select("spectrum", F.size("peaks").alias("n"), F.posexplode(ranked).alias("i", "p"))
    return rows.select("spectrum", F.col("p.k").alias("k"), F.col("p.j").alias("j"), F.round(ions.intensity_density((F.col("i") + 1) / F.col("n")), 8).alias("density"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(exp(-0.5 * pow(least(greatest(l_discount / 5, 0.0025), 0.01) / 0.01, 2)) / (0.01 * sqrt(2 * pi()))), 6) AS score FROM lineitem")
def error_score(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(ions.error_score(F.col("l_discount") / 5), 6).alias("score"))


@query(f"WITH {_PEAKS} SELECT spectrum, count(*) AS n, round(avg(inten), 6) AS mean, round(stddev_pop(inten), 6) AS deviation FROM p GROUP BY spectrum")
def intensity_moments(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("spectrum"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("deviation"))


# ---- confirmation and merging -------------------------------------------------------------------

_CUT = "CASE p_size % 9 + 1 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in study.CUTS.items()) + " END"


@query(
    f"WITH {_PART}, c AS (SELECT *, {_CUT} AS cut FROM s), "
    "d AS (SELECT p_partkey, seq || CASE WHEN p_partkey % 5 = 0 THEN 'G' ELSE replace(cut[1], 'X', '') END AS a, replace(cut[2], 'X', '') || CASE WHEN p_partkey % 7 = 0 THEN reverse(seq) ELSE seq END AS b, cut, p_size, p_partkey % 5 = 0 AS wrong, p_partkey % 7 = 0 AND reverse(seq) <> seq AS other FROM c) "
    "SELECT p_partkey, NOT (CASE WHEN cut[1] = 'X' THEN wrong ELSE wrong END) AND NOT other AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS confirmed FROM d"
)
def pair_confirmation(spark, sf_dir):
    """Pairs whose search results agree: every fifth has a wrong last residue, every seventh another sequence, every
    eleventh other modifications and every thirteenth no result."""
    code = (F.col("p_size") % 9 + 1).cast("int")
    rows = part(spark, sf_dir).select("p_partkey", "seq", code.alias("type_code"))
    key = F.col("p_partkey")
    bare = lambda side: F.replace(study._cut(F.col("type_code"), side), F.lit("X"), F.lit(""))
    shift = F.length(bare(1))
    a = rows.select(key.alias("title"), F.concat("seq", F.when(key % 5 == 0, "G").otherwise(bare(0))).alias("sequence"), F.lit("1,Acetyl;3,Oxidation;").alias("mods")).where(key % 13 != 0)
    mods = F.concat((1 + shift).cast("string"), F.lit(",Acetyl;"), (3 + shift).cast("string"), F.when(key % 11 == 0, ",Phospho;").otherwise(",Oxidation;"))
    b = rows.select(key.alias("title"), F.concat(bare(1), F.when(key % 7 == 0, F.reverse("seq")).otherwise(F.col("seq"))).alias("sequence"), mods.alias("mods"))
    pairs = rows.select(key.alias("a_title"), key.alias("b_title"), "type_code")
    return study.confirmed_pairs(pairs, a, b).select(F.col("a_title").alias("p_partkey"), "confirmed")


_TAG = "CASE l_linenumber % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'TD' WHEN 2 THEN 'NoMatch' ELSE 'D' END"


@query(
    f"WITH r AS (SELECT l_partkey AS sequence, l_orderkey * 10 + l_linenumber AS title, l_discount > 0.05 AS evident, l_tax > 0.03 AS found, {_TAG} AS tag FROM lineitem), "
    "m AS (SELECT sequence, min(length(tag)) AS n FROM r GROUP BY sequence) "
    "SELECT r.sequence, bool_or(evident) AS evident, bool_or(found) AS found, min(CASE WHEN length(tag) = n THEN tag END) AS tag, count(DISTINCT CASE WHEN length(tag) = n THEN tag END) > 1 AS conflict, "
    "array_to_string(list_sort(list(CAST(title AS VARCHAR))), ',') AS titles FROM r JOIN m ON m.sequence = r.sequence GROUP BY r.sequence"
)
def peptide_rollup(spark, sf_dir):
    line = F.col("l_linenumber") % 4
    tag = F.when(line == 0, "T").when(line == 1, "TD").when(line == 2, "NoMatch").otherwise("D")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sequence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("title"), (F.col("l_discount") > 0.05).alias("evident"), (F.col("l_tax") > 0.03).alias("found"), tag.alias("tag"))
    return study.peptide_rollup(rows)


@query("SELECT l_suppkey AS protein_id, array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), ',') AS sequences FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey")
def merged_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("protein_id"), F.col("l_partkey").cast("string").alias("sequence"), "l_returnflag")
    out = study.merged_sequences([rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'")])
    return out.select("protein_id", F.array_join("sequences", ",").alias("sequences"))


@query(
    "WITH a AS (SELECT l_orderkey AS t, l_returnflag AS s FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_orderkey AS t, l_returnflag AS s FROM lineitem WHERE l_linenumber = 2) "
    "SELECT count(CASE WHEN a.s = b.s THEN 1 END) AS n_same, count(CASE WHEN a.s <> b.s THEN 1 END) AS n_different FROM a JOIN b ON a.t = b.t"
)
def agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    of = lambda n: rows.where(f"l_linenumber = {n}").select(F.col("l_orderkey").alias("title"), F.col("l_returnflag").alias("sequence"))
    return study.agreement(of(1), of(2))


@query("SELECT l_partkey AS title, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_titles(spark, sf_dir):
    return study.repeated_titles(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("title")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey % 7 = l.l_linenumber % 7)")
def true_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("a_title"), (F.col("l_linenumber") % 7).alias("b_title"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a_title"), (F.col("o_custkey") % 7).alias("b_title"))
    return study.true_pairs(rows, known).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE abs(o_totalprice - (o_totalprice + o_custkey % 5)) / (o_totalprice + o_custkey % 5) * 1e6::DOUBLE <= 20")
def precursor_check(spark, sf_dir):
    calculated = F.col("o_totalprice") + F.col("o_custkey") % 5
    return table(spark, sf_dir, "orders").where(study.precursor_matches(F.col("o_totalprice"), calculated, 20.0)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size % 3 <> 2")
def known_modifications(spark, sf_dir):
    """Rows without a modification that is not in the list."""
    mods = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "1,Acetyl;2,Oxidation;").otherwise("1,Acetyl;2,Novel;")
    rows = table(spark, sf_dir, "part").select("p_partkey", mods.alias("mods"))
    return study.without_unknown(rows, ["Acetyl", "Oxidation"]).select("p_partkey")


@query(
    "WITH s AS (SELECT o_orderkey AS t FROM orders WHERE o_custkey % 3 = 0) SELECT o_orderkey FROM orders WHERE o_totalprice / 100 <= 3500 AND (o_orderkey IN (SELECT t FROM s) OR o_orderkey + 1 IN (SELECT t FROM s))"
)
def usable_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    known = rows.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("title"))
    pairs = rows.select("o_orderkey", F.col("o_orderkey").alias("a_title"), (F.col("o_orderkey") + 1).alias("b_title"), (F.col("o_totalprice") / 100).alias("a_mass"))
    return study.usable(pairs, known).select("o_orderkey")


@query(
    f"WITH {_PART}, n AS (SELECT substr(seq, 1, 5) AS form, array_to_string(list_sort(list(CAST(p_partkey AS VARCHAR))), ',') AS matches FROM s WHERE p_size > 25 GROUP BY 1) "
    "SELECT s.p_partkey, coalesce(n.matches, '') AS matches FROM s LEFT JOIN n ON n.form = substr(s.seq, 1, 5) WHERE s.p_size <= 25"
)
def matching_rows(spark, sf_dir):
    rows = part(spark, sf_dir).withColumn("sequence", F.substring("seq", 1, 5))
    of = rows.where("p_size > 25").select(F.col("sequence").alias("form"), F.col("p_partkey").cast("string").alias("name"))
    return study.matching_rows(rows.where("p_size <= 25").select("p_partkey", "sequence"), of).select("p_partkey", "matches")


# ---- strings ------------------------------------------------------------------------------------


@query(
    f"WITH {_PART}, t AS (SELECT *, CAST(p_size % 9 + 1 AS INTEGER) AS type_code FROM s WHERE p_size % 9 <> 2), "
    "q AS (SELECT p_partkey, CASE WHEN type_code IN (1, 4, 8) THEN 'K' WHEN type_code IN (2, 5, 9) THEN 'R' ELSE '' END AS cut, seq, type_code FROM t) "
    "SELECT p_partkey, cut || seq AS restored, CASE WHEN type_code IN (8, 9) THEN cut || seq ELSE substr(cut || seq, 1, length(cut || seq) - 1) END AS b_form FROM q"
)
def restored_sequence(spark, sf_dir):
    """The restored sequence of the first digest's peptide, and its mirror's form."""
    rows = part(spark, sf_dir).withColumn("type_code", (F.col("p_size") % 9 + 1).cast("int")).where("type_code <> 3")
    rows = rows.withColumn("restored", S.restored(F.col("seq"), F.col("type_code")))
    return rows.select("p_partkey", "restored", S.second_form(F.col("restored"), F.col("type_code")).alias("b_form"))


@query(
    f"WITH {_PART} SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'K' || seq || 'R' WHEN 1 THEN 'K' || seq WHEN 2 THEN seq || 'R' WHEN 3 THEN seq WHEN 4 THEN seq ELSE NULL END AS joined FROM s"
)
def joined_sequence(spark, sf_dir):
    """Restored sequences of both digests' peptides: both cut, either alone, equal ones, one missing, and no mirrors."""
    kind, seq = F.col("p_size") % 6, F.col("seq")
    a = F.when(kind.isin(0, 2), F.concat(seq, F.lit("R"))).when(kind == 4, F.lit(None)).otherwise(seq)
    b = F.when(kind.isin(0, 1), F.concat(F.lit("K"), seq)).when(kind == 5, F.concat(seq, F.lit("WWW"))).otherwise(seq)
    return part(spark, sf_dir).select("p_partkey", S.joined(a, b).alias("joined"))


@query("SELECT p_partkey, replace(replace(translate(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), 'I', 'L'), 'J', 'M(+15.99)'), 'C', 'C(+57.02)') AS plain FROM part")
def tool_letters(spark, sf_dir):
    seq = F.regexp_replace(F.upper("p_name"), "[^A-Z]", "")
    return table(spark, sf_dir, "part").select("p_partkey", S.tool_letters(seq, "large_j").alias("plain"))


@query("SELECT p_partkey, split_part(p_name, ' ', 2) AS second, split_part(p_name, ' ', -1) AS last, length(p_name) - length(replace(p_name, 'e', '')) AS n_e FROM part WHERE contains(p_name, ' ')")
def positional_words(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").where("contains(p_name, ' ')").select("p_partkey", S.word(name, " ", 1).alias("second"), S.word(name, " ", -1).alias("last"), S.count_of(name, "e").cast("long").alias("n_e"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_suppkey || '$' || l_linenumber || '$' || (l_linenumber + 5))), '&') AS places FROM lineitem GROUP BY l_orderkey")
def place_lists(spark, sf_dir):
    place = S.place_text(F.col("l_suppkey").cast("string"), F.col("l_linenumber"), F.col("l_linenumber") + 5)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(place)), "&").alias("places"))


@query("SELECT CASE WHEN starts_with(p_name, 'c') THEN 'antibody' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def header_split(spark, sf_dir):
    """Proteins told apart by the beginning of their header."""
    kind = F.when(F.startswith("p_name", F.lit("c")), "antibody").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# ---- mapping of pairs ---------------------------------------------------------------------------

_FORMS = (
    f"d AS (SELECT doc_id AS protein_id, {_LETTERS.format('text')} AS seq FROM documents), b AS (SELECT {_LETTERS.format('text')} AS seq FROM benchmark), "
    "z AS (SELECT DISTINCT substr(seq, CAST(o AS INTEGER), 11) AS sequence, CAST(o % 3 * 2 + 4 AS INTEGER) AS type_code FROM (SELECT seq, unnest(range(2, length(seq) - 9, 8)) AS o FROM b)), "
    "m AS (SELECT sequence, type_code, CASE WHEN type_code IN (6, 7) THEN sequence ELSE substr(sequence, 2) END AS a, CASE WHEN type_code IN (8, 9) THEN sequence ELSE substr(sequence, 1, length(sequence) - 1) END AS b FROM z), "
    "f AS (SELECT DISTINCT form FROM (SELECT a AS form FROM m UNION ALL SELECT b FROM m UNION ALL SELECT sequence FROM m)), "
    "h AS (SELECT f.form, d.protein_id, d.seq FROM f JOIN d ON contains(d.seq, f.form)), "
    "g AS (SELECT form, protein_id, i AS start, i + length(form) AS \"end\" FROM (SELECT form, protein_id, seq, unnest(range(0, length(seq) - length(form) + 1)) AS i FROM h) WHERE substr(seq, i + 1, length(form)) = form) "
)


def _restored(spark, sf_dir):
    """Restored sequences of eleven letters at every eighth place of whole passages, with a type by place."""
    seq = S.leucine(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")))
    cut = F.transform(F.sequence(F.lit(2), F.length("seq") - 10, F.lit(8)), lambda at: F.struct(F.substr("seq", at, F.lit(11)).alias("sequence"), (at % 3 * 2 + 4).alias("type_code")))
    return table(spark, sf_dir, "benchmark").select(seq.alias("seq")).where("length(seq) >= 12").select(F.explode(cut).alias("x")).select("x.*").distinct()


@query(
    f"WITH {_FORMS} SELECT m.sequence, m.type_code, x.n AS n_a, y.n AS n_b FROM m JOIN (SELECT form, count(*) AS n FROM g GROUP BY form) x ON x.form = m.a JOIN (SELECT form, count(*) AS n FROM g GROUP BY form) y ON y.form = m.b"
)
def mirror_map(spark, sf_dir):
    """Places of both digests' forms of restored sequences that have both."""
    found = study.mirror_locations(_restored(spark, sf_dir), proteins(spark, sf_dir))
    n = lambda s: F.sum((F.col("side") == s).cast("long")).alias(f"n_{s}")
    return found.groupBy("sequence", "type_code").agg(n("a"), n("b"))


@query(
    f"WITH {_FORMS}, p AS (SELECT protein_id, start, \"end\" FROM m JOIN g ON g.form = m.sequence UNION ALL SELECT g.protein_id, g.start, g.\"end\" FROM (SELECT m.*, m.a AS form FROM m UNION ALL SELECT m.*, m.b FROM m) m JOIN g ON g.form = m.form "
    "WHERE m.sequence NOT IN (SELECT form FROM g) AND m.a IN (SELECT form FROM g) AND m.b IN (SELECT form FROM g)), u AS (SELECT DISTINCT protein_id, unnest(range(start, \"end\")) AS pos FROM p) SELECT protein_id, count(*) AS covered FROM u GROUP BY protein_id"
)
def mirror_coverage(spark, sf_dir):
    """Residues covered by restored sequences, whole where they are found, else by both forms."""
    return merging.coverage_union([study.whole_or_parts(_restored(spark, sf_dir), proteins(spark, sf_dir))])


@query(
    f"WITH d AS (SELECT {_LETTERS.format('text')} AS seq FROM documents), {_PART}, c AS (SELECT p_size AS title, p_partkey AS rank, substr(seq, 1, 4) AS sequence FROM s), "
    "k AS (SELECT DISTINCT sequence FROM c JOIN d ON contains(d.seq, c.sequence)) SELECT title, rank, sequence FROM c WHERE sequence IN (SELECT sequence FROM k) QUALIFY row_number() OVER (PARTITION BY title ORDER BY rank, sequence) = 1"
)
def first_mapped(spark, sf_dir):
    """The first candidate of every title that lies in a protein."""
    rows = part(spark, sf_dir).select(F.col("p_size").alias("title"), F.col("p_partkey").alias("rank"), F.substring("seq", 1, 4).alias("sequence"))
    return study.first_mapped(rows, mapping.locate(rows, proteins(spark, sf_dir)))


@query(
    f"WITH d AS (SELECT doc_id AS protein_id, {_LETTERS.format('text')} AS seq FROM documents), b AS (SELECT {_LETTERS.format('text')} AS seq FROM benchmark), "
    f"x AS (SELECT DISTINCT sequence FROM ({_CUT_SQL}) q(sequence) WHERE length(sequence) IN (3, 4, 10)) "
    "SELECT sequence, count(*) AS n_proteins FROM x JOIN d ON contains(d.seq, x.sequence) GROUP BY sequence"
)
def mapped_proteins(spark, sf_dir):
    """Proteins that contain each peptide: the mapping held against a plain substring search."""
    return mapping.locate(peptides(spark, sf_dir), proteins(spark, sf_dir)).groupBy("sequence").agg(F.countDistinct("protein_id").alias("n_proteins"))


@query(
    f"WITH {_MAPPED}, n AS (SELECT protein_id, unnest(range(start, \"end\")) AS pos FROM loc), c AS (SELECT protein_id, pos, count(*) AS depth FROM n GROUP BY protein_id, pos), "
    "g AS (SELECT *, pos - row_number() OVER (PARTITION BY protein_id, depth ORDER BY pos) AS run FROM c) "
    "SELECT protein_id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS \"end\", depth FROM g GROUP BY protein_id, depth, run"
)
def residue_depth(spark, sf_dir):
    """Runs of residues with equally many peptides over them; SQL counts every residue."""
    return mapping.peptide_depth(peptides(spark, sf_dir), proteins(spark, sf_dir))


@query(
    f"WITH {_FORMS}, has AS (SELECT DISTINCT form FROM g), "
    "p AS (SELECT m.sequence, g.protein_id, g.start, false AS split FROM m JOIN g ON g.form = m.sequence UNION SELECT m.sequence, g.protein_id, g.start, true FROM (SELECT m.*, m.a AS form FROM m UNION ALL SELECT m.*, m.b FROM m) m JOIN g ON g.form = m.form "
    "WHERE m.sequence NOT IN (SELECT form FROM has) AND m.a IN (SELECT form FROM has) AND m.b IN (SELECT form FROM has)), "
    "q AS (SELECT DISTINCT p.sequence, p.protein_id, p.start, p.split FROM p), e AS (SELECT sequence, protein_id, bool_or(split) AS split FROM q GROUP BY ALL), t AS (SELECT sequence, count(*) AS n FROM e GROUP BY sequence) "
    "SELECT protein_id, count(CASE WHEN n = 1 THEN 1 END) AS n_unique, count(CASE WHEN n > 1 THEN 1 END) AS n_nonunique, count(*) AS n_total, count(CASE WHEN split THEN 1 END) AS n_split FROM e JOIN t USING (sequence) GROUP BY protein_id"
)
def mirror_counts(spark, sf_dir):
    """Restored sequences of every protein, of it alone and of several, and those mapped by their two forms."""
    return study.mirror_counts(study.whole_or_parts(_restored(spark, sf_dir), proteins(spark, sf_dir))).drop("n_places")


_ATOM_SUMS = ", ".join(f"{base} + " + " + ".join(f"{v[k]} * (length(seq) - length(replace(seq, '{a}', '')))" for a, v in chemistry.ATOMS.items() if v[k]) + f" AS n{k}" for k, base in enumerate((0, 2, 0, 1, 0)))
_FORMULA = " || ".join(f"CASE WHEN n{k} > 0 THEN '{e}(' || n{k} || ')' ELSE '' END" for k, e in enumerate(chemistry.ELEMENTS))


@query(f"WITH s AS (SELECT p_partkey, translate(regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g'), 'I', 'L') AS seq FROM part), n AS (SELECT p_partkey, seq, {_ATOM_SUMS} FROM s) SELECT p_partkey, CASE WHEN regexp_matches(seq, '[BJOUXZ]') THEN NULL ELSE {_FORMULA} END AS formula FROM n")
def peptide_formula(spark, sf_dir):
    """Element counts of part names and kinds read as residues; null where a letter is none."""
    seq = F.regexp_replace(F.upper(F.concat("p_name", "p_type")), "[^A-Z]", "")
    return table(spark, sf_dir, "part").select("p_partkey", S.formula(S.atoms(seq)).alias("formula"))


@query("SELECT l_orderkey AS title, l_partkey AS sequence, l_tax AS q FROM lineitem WHERE l_tax <= 0.01 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax, l_partkey) = 1")
def best_matches(spark, sf_dir):
    """The best search result of every title under a q-value of one hundredth."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("title"), F.col("l_partkey").alias("sequence"), F.col("l_tax").alias("q"))
    return study.best_matches(rows)


@query(
    "WITH r AS (SELECT DISTINCT l_partkey AS sequence, l_orderkey AS title FROM lineitem), c AS (SELECT o_orderkey AS title, CAST(o_custkey % 10 + 1 AS INTEGER) AS class FROM orders WHERE o_custkey % 3 > 0) "
    "SELECT coalesce(class, 0) AS class, count(DISTINCT sequence) AS n_peptides, count(*) AS n_titles FROM r LEFT JOIN c ON c.title = r.title GROUP BY 1"
)
def class_histogram(spark, sf_dir):
    """Peptides and titles by the class of their titles."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sequence"), F.col("l_orderkey").cast("string").alias("title")).distinct()
    peptides_ = rows.groupBy("sequence").agg(F.array_join(F.collect_list("title"), ",").alias("titles"))
    classes = table(spark, sf_dir, "orders").where("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("title"), (F.col("o_custkey") % 10 + 1).cast("int").alias("class"))
    return study.class_histogram(peptides_, classes)

