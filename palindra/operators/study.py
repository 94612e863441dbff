"""Operators of a study: confirmation against search results, peptide roll-ups, mirror mapping and coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.functions import ions
from palindra.functions import sequences as S

from . import bands, mapping, merging
from .lineage import once

#: The residue that the first digest leaves at the end and its mirror at the beginning, by type; X is none.
CUTS = {1: "KK", 2: "RR", 3: "XX", 4: "RK", 5: "KR", 6: "KX", 7: "RX", 8: "XK", 9: "XR"}


def _cut(type_code: Column, side: int) -> Column:
    return F.element_at(F.create_map(*(x for k, v in CUTS.items() for x in (F.lit(k), F.lit(v[side])))), type_code.cast("int"))


def confirmed(a_seq: Column, a_mods: Column, b_seq: Column, b_mods: Column, type_code: Column) -> Column:
    """Whether search results of two spectra ('pos,name;' modifications) are a mirror pair of that type.

    Without the cut residues the sequences must be equal, and so must the modifications, of the mirror moved by its cut
    residue. A null result confirms nothing.
    """
    last, first = _cut(type_code, 0), _cut(type_code, 1)
    a_core = F.when(last == "X", a_seq).when(F.right(a_seq, F.lit(1)) == last, F.substr(a_seq, F.lit(1), F.length(a_seq) - 1))
    b_core = F.when(first == "X", b_seq).when(F.left(b_seq, F.lit(1)) == first, F.substr(b_seq, F.lit(2)))
    items = lambda mods: F.filter(F.split(F.coalesce(mods, F.lit("")), ";"), lambda m: m != "")
    place = lambda m: F.substring_index(m, ",", 1).cast("int")
    a_left = F.when(last == "X", items(a_mods)).otherwise(F.filter(items(a_mods), lambda m: place(m) < F.length(a_seq)))
    moved = F.transform(F.filter(items(b_mods), lambda m: place(m) >= 2), lambda m: F.concat((place(m) - 1).cast("string"), F.lit(","), F.substring_index(m, ",", -1)))
    b_left = F.when(first == "X", items(b_mods)).otherwise(moved)
    return F.coalesce((a_core == b_core) & (F.array_join(a_left, ";") == F.array_join(b_left, ";")), F.lit(False))


def confirmed_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``pairs`` (a_title, b_title, type_code) with ``confirmed`` by search results (title, sequence, mods) of both digests."""
    side = lambda t, s: t.select(F.col("title").alias(f"{s}_title"), F.col("sequence").alias(f"{s}_sequence"), F.col("mods").alias(f"{s}_mods"))
    rows = pairs.join(side(a, "a"), "a_title", "left").join(side(b, "b"), "b_title", "left")
    c = F.col
    return rows.select(*pairs.columns, confirmed(c("a_sequence"), c("a_mods"), c("b_sequence"), c("b_mods"), c("type_code")).alias("confirmed"))


def residue_accuracy(rows: DataFrame) -> DataFrame:
    """One row of (target, found): residues matched, residue recall and precision, and sequences wholly matched; equal rows are compared once."""
    n = F.col("n")
    each = rows.groupBy("target", "found").agg(F.count("*").alias("n"))
    per = each.select("n", ions.residue_matches(F.col("target"), F.col("found")).alias("m"), F.length("target").alias("t"), F.length("found").alias("f"))
    out = per.agg(F.sum(n * F.col("m")).alias("n_match"), F.sum(n * F.col("t")).alias("n_target"), F.sum(n * F.col("f")).alias("n_found"), F.sum(F.when((F.col("m") == F.col("t")) & (F.col("m") == F.col("f")), n).otherwise(0)).alias("n_whole"))
    return out.select("*", F.round(F.col("n_match") / F.col("n_target"), 6).alias("recall"), F.round(F.col("n_match") / F.col("n_found"), 6).alias("precision"))


def true_pairs(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates whose (a_title, b_title) is among ``pairs``."""
    return candidates.join(pairs.select("a_title", "b_title"), ["a_title", "b_title"], "left_semi")


def peptide_rollup(rows: DataFrame) -> DataFrame:
    """(sequence, evident, found, tag, conflict, titles) of rows (title, sequence, evident, found, tag).

    A peptide is evident or found if any of its titles is; its tag is the shortest one, and two different tags of that
    length are a conflict. Titles are sorted and joined by commas; null sequences are left out.
    """
    own = rows.where("sequence IS NOT NULL")
    least = F.min(F.struct(F.length("tag").alias("n"), F.col("tag")))
    out = own.groupBy("sequence").agg(F.max("evident").alias("evident"), F.max("found").alias("found"), least.alias("x"), F.collect_set("tag").alias("tags"), F.array_join(F.sort_array(F.collect_list(F.col("title").cast("string"))), ",").alias("titles"))
    same = F.size(F.filter("tags", lambda t: F.length(t) == F.col("x.n")))
    return out.select("sequence", "evident", "found", F.col("x.tag").alias("tag"), (same > 1).alias("conflict"), "titles")


def merged_sequences(parts: list[DataFrame]) -> DataFrame:
    """(protein_id, sequences): distinct unique sequences of every protein over several tables, sorted."""
    rows = parts[0].select("protein_id", "sequence")
    for p in parts[1:]:
        rows = rows.union(p.select("protein_id", "sequence"))
    return rows.groupBy("protein_id").agg(F.sort_array(F.collect_set("sequence")).alias("sequences"))


def first_mapped(candidates: DataFrame, locations: DataFrame) -> DataFrame:
    """The first candidate by rank of every title whose sequence has a place in a protein."""
    found = candidates.join(locations.select("sequence").distinct(), "sequence", "left_semi")
    return merging.best(found, ["title"], [F.col("rank"), F.col("sequence")])


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row (n_same, n_different): titles of both tables (title, sequence) whose bare sequences agree or not."""
    both = one.select("title", S.stripped(F.col("sequence")).alias("s")).join(two.select("title", S.stripped(F.col("sequence")).alias("t")), "title")
    same = F.col("s") == F.col("t")
    return both.agg(F.sum(same.cast("long")).alias("n_same"), F.sum((~same).cast("long")).alias("n_different"))


def repeated_titles(rows: DataFrame) -> DataFrame:
    """Titles that occur more than once, with how often."""
    return rows.groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


#: Bytes of result that a task of :func:`matching_rows` makes of a form with long lists, and tasks at most.
_PIECE, _MOST_TASKS = 1 << 29, 4096
#: Bytes of a list from which Parquet's writer has to look at its pages and row groups more often than every 100 to 10,000 rows.
_LONG = 1 << 16
_LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.check.estimate": "false", "parquet.block.size.row.check.max": "100"}


def matching_rows(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` (sequence, ...) with ``matches``: the sorted names of the rows of ``of`` (form, name) of that form, joined by commas, or ''.

    The rows of a form lie together, so a writer with dictionaries keeps a list once and not once a row. Only narrow rows and one
    list a piece are shuffled; a form whose rows and names make a large result is dealt out in pieces. Where lists are long, what
    ``_LONG_ROWS`` names is set for the session unless it has a value: else a writer holds 100 or more lists before it ends a page.
    """
    names = of.groupBy("form").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("matches"))
    text = of.groupBy("form").agg(F.sum(F.length("name") + 1).alias("_bytes"))
    wanted = rows.groupBy(F.col("sequence").alias("form")).agg(F.count("*").alias("_n"))
    sizes = text.join(wanted, "form").select("form", F.greatest(F.ceil(F.col("_n") * F.col("_bytes") / _PIECE), F.lit(1)).cast("int").alias("_pieces"))
    # several tasks a piece, so that few tasks get more than one
    all_pieces, longest = sizes.join(text, "form").agg(F.sum("_pieces"), F.max("_bytes")).first()
    n = min(4 * (all_pieces or 1), _MOST_TASKS)
    conf = rows.sparkSession.conf
    for key, value in _LONG_ROWS.items() if (longest or 0) > _LONG else ():
        if conf.get(key, None) is None:
            conf.set(key, value)
    n = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = rows.join(sizes, rows.sequence == sizes.form, "left").withColumn("_piece", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_pieces", F.lit(1))).cast("int"))
    right = names.join(sizes, "form").select("form", "matches", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"))
    left, right = left.select(*rows.columns, "_piece").repartition(n, "sequence", "_piece"), right.repartition(n, "form", "_piece")
    both = left.hint("merge").join(right, (left.sequence == right.form) & (left["_piece"] == right["_piece"]), "left")
    return both.select(*(left[c] for c in rows.columns), F.coalesce("matches", F.lit("")).alias("matches"))


def precursor_matches(observed: Column, calculated: Column, tolerance: float, ppm: bool = True) -> Column:
    """Whether an observed mass is within the tolerance of the calculated one, relative to it if ``ppm``."""
    gap = F.abs(observed - calculated)
    return gap / calculated * 1e6 <= tolerance if ppm else gap <= tolerance


def usable(rows: DataFrame, spectra: DataFrame, most: float = 3500.0) -> DataFrame:
    """Pairs (a_title, b_title, a_mass) with a mass of at most ``most`` of which at least one spectrum exists."""
    seen = lambda s: spectra.select(F.col("title").alias(f"{s}_title"), F.lit(True).alias(f"_{s}")).distinct()
    both = rows.where(F.col("a_mass") <= most).join(seen("a"), "a_title", "left").join(seen("b"), "b_title", "left")
    return both.where("_a OR _b").select(*rows.columns)


def without_unknown(rows: DataFrame, known: list[str]) -> DataFrame:
    """Rows whose 'pos,name;' modifications are all among ``known``."""
    names = F.transform(F.filter(F.split(F.coalesce("mods", F.lit("")), ";"), lambda m: m != ""), lambda m: F.substring_index(m, ",", -1))
    return rows.where(F.forall(names, lambda n: n.isin(known)))


def _located_forms(peptides: DataFrame, proteins: DataFrame, sides: list[str]) -> DataFrame:
    """(sequence, type_code, side, protein_id, start, end) of the wanted forms of restored sequences, found in one search."""
    forms = {"a": S.first_form(F.col("sequence"), F.col("type_code")), "b": S.second_form(F.col("sequence"), F.col("type_code")), "whole": F.col("sequence")}
    one = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), forms[s].alias("form")) for s in sides))).alias("x")
    asked = peptides.select("sequence", "type_code").distinct().select("sequence", "type_code", one).select("sequence", "type_code", "x.*")
    places = mapping.locate(asked.select(F.col("form").alias("sequence")), proteins).withColumnRenamed("sequence", "form")
    return once(asked.join(places, "form").drop("form"))


def mirror_locations(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(sequence, type_code, side, protein_id, start, end): places of both digests' forms of restored sequences.

    Only those of which both forms have a place count.
    """
    found = _located_forms(peptides, proteins, ["a", "b"])
    both = found.groupBy("sequence", "type_code").agg(F.count_distinct("side").alias("n")).where("n = 2").select("sequence", "type_code")
    return found.join(both, ["sequence", "type_code"])


def whole_or_parts(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(sequence, type_code, protein_id, start, end, split): places of whole restored sequences, else of both forms."""
    found = _located_forms(peptides, proteins, ["whole", "a", "b"])
    sides = found.groupBy("sequence", "type_code").agg(F.collect_set("side").alias("sides"))
    whole = F.array_contains("sides", "whole")
    wanted = F.when(whole, F.col("side") == "whole").otherwise(F.array_contains("sides", "a") & F.array_contains("sides", "b"))
    return found.join(sides, ["sequence", "type_code"]).where(wanted).select("sequence", "type_code", "protein_id", "start", "end", (~whole).alias("split"))


def mirror_counts(found: DataFrame) -> DataFrame:
    """(protein_id, n_unique, n_nonunique, n_total, n_places, n_split) of restored sequences located by :func:`whole_or_parts`.

    A sequence mapped by its two forms counts once a protein, as one mapped whole does; ``n_split`` counts the former.
    """
    split = found.where("split").select("sequence", "protein_id").distinct().groupBy("protein_id").agg(F.count("*").alias("n_split"))
    return mapping.counts(found).join(split, "protein_id", "left").withColumn("n_split", F.coalesce("n_split", F.lit(0)))


def site_evidence(rows: DataFrame, key: str, ppm: float = 20.0, spectra: DataFrame | None = None, spectrum: str = "spectrum") -> DataFrame:
    """(key, site, tag, inten) of peptides (key, seq, charge, peaks of mz and inten): what :func:`palindra.functions.ions.evidence` finds.

    Ions and peaks are sorted by the logarithm of m/z, where a tolerance in ppm is a band of one width, so no ion looks at all peaks.
    ``key`` names a peptide with its spectrum; sequences of one residue, or without known residues, have no sites, null peaks none.
    With ``spectra`` (spectrum, peaks), one row a spectrum, peptides name theirs in the column ``spectrum``, and its peaks are laid out
    once for all of them; peptides of other spectra have no sites.
    """
    share = ppm * 1e-6
    group = [spectrum] if spectra is not None else [key]
    kind = rows.schema[key].dataType.simpleString()
    target, peak = f"struct<key:{kind},site:int,ion:double>", "struct<d:double,mz:double,inten:double>"
    ion = lambda x, c: F.struct(F.ln(c).alias("at"), F.struct(F.col(key).alias("key"), x["site"].cast("int").alias("site"), c.alias("ion")).alias("target"), F.lit(None).cast(peak).alias("peak"))
    asked = F.flatten(F.transform(ions.ladder(F.col("seq")), lambda x: F.filter(F.array(*(ion(x, x[c]) for c in ("b", "y")), *(ion(x, F.when(F.col("charge") > 2, x[c])) for c in ("b2", "y2"))), lambda v: v["at"].isNotNull())))
    own = F.transform("peaks", lambda p: F.struct(F.ln(p.mz.cast("double")).alias("at"), F.lit(None).cast(target).alias("target"), F.struct(F.lit(0.0).alias("d"), p.mz.cast("double").alias("mz"), p.inten.cast("double").alias("inten")).alias("peak")))
    listed = lambda t, x: t.select(*group, F.explode(x).alias("x")).select(*group, "x.*")
    if spectra is None:
        flat = listed(rows, F.concat(asked, F.coalesce(own, F.array().cast(f"array<struct<at:double,target:{target},peak:{peak}>>"))))
    else:
        flat = listed(rows.join(spectra.select(spectrum), spectrum, "left_semi"), asked).union(listed(spectra, own))
    found = bands.near(flat, group, -math.log1p(-share) + 1e-12)
    at = F.col("target.ion")
    best = F.array_min(F.transform("near", lambda p: F.struct(F.abs(p.mz - at).alias("d"), p.inten.alias("inten"))))
    hit = ions.bound(best, lambda b: F.when(b["d"] <= at * ppm * 1e-6, b["inten"]))
    each = found.select(F.col("target.key").alias(key), F.col("target.site").alias("site"), hit.alias("hit"))
    return each.groupBy(key, "site").agg(F.max(F.col("hit").isNotNull().cast("int")).alias("tag"), F.sum(F.coalesce("hit", F.lit(0.0))).alias("inten"))


def best_matches(rows: DataFrame, most: float = 0.01) -> DataFrame:
    """Of the search results (title, sequence, q, ...) with a q-value of at most ``most`` the best of every title, ties by sequence."""
    return merging.best(rows.where(F.col("q") <= most), ["title"], [F.col("q"), F.col("sequence")])


def class_histogram(peptides: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, n_peptides, n_titles): peptides (sequence, titles, comma-joined) by the classes (title, class) of their titles.

    A peptide counts once in every class that one of its titles has; titles without a class count as class 0.
    """
    rows = peptides.select("sequence", F.explode(F.split("titles", ",")).alias("title"))
    named = rows.join(classes.select(F.col("title").cast("string").alias("title"), "class"), "title", "left")
    return named.groupBy(F.coalesce("class", F.lit(0)).alias("class")).agg(F.count_distinct("sequence").alias("n_peptides"), F.count("*").alias("n_titles"))


def confident(cover: DataFrame, least_mass: float, masses: DataFrame) -> DataFrame:
    """The locations (sequence, protein_id, ...) of peptides whose mass is at least ``least_mass`` and whose evidence is full.

    ``masses`` is (sequence, mass, evident), one row a sequence.
    """
    kept = masses.where((F.col("mass") >= least_mass) & F.col("evident")).select("sequence")
    return cover.join(kept, "sequence", "left_semi")

