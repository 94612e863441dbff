"""Peptide strings: modifications, mirror forms, masses and their expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palindra import chemistry

TOKEN = r"[A-Z](?:\([^)]*\))?"


def leucine(seq: Column) -> Column:
    """I read as L."""
    return F.translate(seq, "I", "L")


def stripped(seq: Column) -> Column:
    """Bare residues: bracketed modifications dropped, I as L, J (oxidised methionine) as M."""
    return F.translate(F.regexp_replace(seq, r"\([^)]*\)", ""), "IJ", "LM")


def residues(seq: Column) -> Column:
    """Residues with their bracketed modification, as an array."""
    return F.regexp_extract_all(seq, F.lit(f"({TOKEN})"), F.lit(1))


def applied(seq: Column, mods: Column) -> Column:
    """Write 'pos,name;pos,name;' (positions from 1) behind the residues as (name)."""
    items = F.filter(F.split(F.coalesce(mods, F.lit("")), ";"), lambda m: m != "")
    by_place = F.map_from_entries(F.transform(items, lambda m: F.struct(F.substring_index(m, ",", 1).cast("int"), F.substring_index(m, ",", -1))))
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c, i: F.concat(c, F.coalesce(F.concat(F.lit("("), F.try_element_at(by_place, i + 1), F.lit(")")), F.lit("")))), "")


def first_form(seq: Column, type_code: Column) -> Column:
    """The first digest's peptide of a sequence with its flanking residues: without the cut residue on its left."""
    return F.when(type_code.isin(6, 7), seq).otherwise(F.substr(seq, F.lit(2)))


def second_form(seq: Column, type_code: Column) -> Column:
    """The mirror digest's peptide: without the cut residue on its right."""
    return F.when(type_code.isin(8, 9), seq).otherwise(F.substr(seq, F.lit(1), F.length(seq) - 1))


def restored(a_form: Column, type_code: Column) -> Column:
    """The sequence with its flanking cut residues of the first digest's peptide: the inverse of :func:`first_form`."""
    cut = F.when(type_code.isin(1, 4, 8), "K").when(type_code.isin(2, 5, 9), "R").otherwise("")
    return F.concat(cut, a_form)


def joined(a_form: Column, b_form: Column) -> Column:
    """The restored sequence of both digests' peptides; null if they do not overlap as mirrors do, one alone stands for both."""
    head = F.substr(a_form, F.lit(1), F.length(a_form) - 1)
    tail = F.substr(b_form, F.lit(2))
    both = F.when(a_form == b_form, a_form).when((F.length(a_form) == F.length(b_form)) & (head == tail), F.concat(b_form, F.right(a_form, F.lit(1))))
    both = both.when(head == b_form, a_form).when(a_form == tail, b_form)
    return F.when(a_form.isNull(), b_form).when(b_form.isNull(), a_form).otherwise(both)


def tool_letters(seq: Column, tool: str) -> Column:
    """Other tools' letters for modified residues in the bracket form: 'small_a' writes a, 'large_j' J for oxidised methionine."""
    oxidised = {"small_a": "a", "large_j": "J"}[tool]
    out = F.regexp_replace(F.regexp_replace(seq, oxidised, "M(+15.99)"), "C", "C(+57.02)")
    return leucine(out) if tool == "large_j" else F.regexp_replace(out, "^0(.)", "B(+42.01)$1")


def place_text(protein: Column, start: Column, end: Column) -> Column:
    """A place as 'protein$start$end'; several are joined by '&'."""
    return F.concat_ws("$", protein, start.cast("string"), end.cast("string"))


def word(value: Column, separator: str, nth: int) -> Column:
    """The nth piece, from 0, negative ones from the end; null if there is none."""
    parts = F.split(value, f"\\Q{separator}\\E")
    return F.get(parts, F.lit(nth) if nth >= 0 else F.size(parts) + nth)


def between(value: Column, left: str, right: str) -> Column:
    """What lies between the first ``left`` and the next ``right``; null if either is missing."""
    return F.nullif(F.regexp_extract(value, f"(?s)\\Q{left}\\E(.*?)\\Q{right}\\E", 0), F.lit("")).substr(F.lit(len(left) + 1), F.length(F.regexp_extract(value, f"(?s)\\Q{left}\\E(.*?)\\Q{right}\\E", 1)))


def count_of(value: Column, letter: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(letter)))


def mass(seq: Column) -> Column:
    """MH+ of unmodified residues; null where a letter is no residue."""
    table = F.create_map(*(x for a, m in chemistry.RESIDUES.items() for x in (F.lit(a), F.lit(m))))
    letters = F.filter(F.split(leucine(seq), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.try_element_at(table, c)) + (chemistry.WATER + chemistry.PROTON)


def covered_text(seq: Column, places: Column) -> Column:
    """The sequence with the residues at ``places`` (from 0) in lower case."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c, i: F.when(F.array_contains(places, i), F.lower(c)).otherwise(c)), "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def half_up(x: Column) -> Column:
    """Halves away from zero, as an integer."""
    return (F.floor(F.abs(x) + 0.5) * F.signum(x)).cast("long")


def atoms(seq: Column, mods: Column | None = None, known: dict[str, dict[str, int]] | None = None) -> Column:
    """Counts of C, H, N, O and S of a peptide with water, as an array; null where a letter is no residue or a modification is unknown.

    ``mods`` are 'pos,name;' pairs, ``known`` the atoms that a modification adds, by name; elements other than the five are left out.
    """
    counts = lambda values: F.array(*(F.lit(int(v)) for v in values))
    table = F.create_map(*(x for a, v in chemistry.ATOMS.items() for x in (F.lit(a), counts(v))))
    add = lambda acc, more: F.zip_with(acc, more, lambda x, y: x + y)
    letters = F.filter(F.split(leucine(seq), ""), lambda c: c != "")
    out = F.aggregate(letters, counts((0, 2, 0, 1, 0)), lambda acc, c: add(acc, F.try_element_at(table, c)))
    if mods is not None:
        entries = [x for name, c in (known or {}).items() for x in (F.lit(name), counts(c.get(e, 0) for e in chemistry.ELEMENTS))]
        by_name = F.create_map(*entries) if entries else F.create_map().cast("map<string,array<int>>")
        names = F.transform(F.filter(F.split(F.coalesce(mods, F.lit("")), ";"), lambda m: m != ""), lambda m: F.substring_index(m, ",", -1))
        out = F.aggregate(names, out, lambda acc, n: add(acc, F.try_element_at(by_name, n)))
    return F.when(~F.exists(out, lambda n: n.isNull()), out)


def formula(counts: Column) -> Column:
    """Atom counts as 'C(2)H(3)...', elements without atoms left out."""
    named = F.arrays_zip(F.array(*map(F.lit, chemistry.ELEMENTS)).alias("e"), counts.alias("n"))
    return F.array_join(F.transform(F.filter(named, lambda x: x["n"] != 0), lambda x: F.concat(x["e"], F.lit("("), x["n"].cast("string"), F.lit(")"))), "")


def modified_mass(seq: Column) -> Column:
    """MH+ of a sequence with bracketed mass shifts, M(+15.99); null where a letter is no residue or a bracket holds no number."""
    shifts = F.regexp_extract_all(seq, F.lit(r"\(([^)]*)\)"), F.lit(1))
    return mass(F.regexp_replace(seq, r"\([^)]*\)", "")) + F.aggregate(shifts, F.lit(0.0), lambda acc, x: acc + x.try_cast("double"))

