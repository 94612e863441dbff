"""Masses, mirror types and dictionaries.

Fixed values of the domain: monoisotopic residue masses, proton masses by stage, mirror-type shifts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

PROTON = 1.00727645224
PROTON_PAIRING = 1.007276
NEUTRON = 1.003
WATER = 18.0105647
AMMONIA = 17.0265491
CO = 27.9949146
K, R = 128.09496, 156.10111
#: Residues; isoleucine is read as leucine everywhere.
RESIDUES = {"A": 71.037114, "C": 103.009185, "D": 115.026943, "E": 129.042593, "F": 147.068414, "G": 57.021464, "H": 137.058912, "K": K, "L": 113.084064, "M": 131.040485, "N": 114.042927, "P": 97.052764, "Q": 128.058578, "R": R, "S": 87.032028, "T": 101.047679, "V": 99.068414, "W": 186.079313, "Y": 163.063329}

#: Elements of residues and how many atoms of each a residue has.
ELEMENTS = ("C", "H", "N", "O", "S")
ATOMS = {"A": (3, 5, 1, 1, 0), "C": (3, 5, 1, 1, 1), "D": (4, 5, 1, 3, 0), "E": (5, 7, 1, 3, 0), "F": (9, 9, 1, 1, 0), "G": (2, 3, 1, 1, 0), "H": (6, 7, 3, 1, 0), "K": (6, 12, 2, 1, 0), "L": (6, 11, 1, 1, 0), "M": (5, 9, 1, 1, 1), "N": (4, 6, 2, 2, 0), "P": (5, 7, 1, 1, 0), "Q": (5, 8, 2, 2, 0), "R": (6, 12, 4, 1, 0), "S": (3, 5, 1, 2, 0), "T": (4, 7, 1, 2, 0), "V": (5, 9, 1, 1, 0), "W": (11, 10, 2, 1, 0), "Y": (9, 9, 1, 2, 0)}


@dataclass(frozen=True)
class MirrorType:
    """How a precursor and its b and y ions shift from the first digest to its mirror."""

    code: int
    name: str
    precursor: float
    b: float
    y: float
    on: bool = True


MIRROR_TYPES = (
    MirrorType(1, "A1:K-K", 0.0, -K, K),
    MirrorType(2, "A2:R-R", 0.0, -R, R),
    MirrorType(3, "A3:X-X", 0.0, 0.0, 0.0, False),
    MirrorType(4, "B: R-K", R - K, -K, R),
    MirrorType(5, "C: K-R", K - R, -R, K),
    MirrorType(6, "D: K-X", K, 0.0, K),
    MirrorType(7, "E: R-X", R, 0.0, R),
    MirrorType(8, "F: X-K", -K, -K, 0.0),
    MirrorType(9, "G: X-R", -R, -R, 0.0),
)


#: Masses of K and R that carry the two labels of doubly labelled samples.
K_LABELLED, R_LABELLED = 136.10916, 160.08925


def mirror_types(labelled: bool = False) -> tuple[MirrorType, ...]:
    """The mirror types, with the shifts of labelled K and R if asked for."""
    if not labelled:
        return MIRROR_TYPES
    heavy = {0.0: 0.0, K: K_LABELLED, R: R_LABELLED, -K: -K_LABELLED, -R: -R_LABELLED, R - K: R_LABELLED - K_LABELLED, K - R: K_LABELLED - R_LABELLED}
    return tuple(MirrorType(t.code, t.name, heavy[t.precursor], heavy[t.b], heavy[t.y], t.on) for t in MIRROR_TYPES)


def recall_types(labelled: bool = False) -> list[tuple[int, float]]:
    """(code, precursor shift) of the recall; the types without a shift are recalled together as 0."""
    return [(0, 0.0), *((t.code, t.precursor) for t in mirror_types(labelled) if t.on and t.code > 3)]


def composition(formula: str) -> dict[str, int]:
    """Element counts of 'C(2)H(3)N(1)O(1)'."""
    return {e: int(n) for e, n in re.findall(r"([A-Z][a-z]?\d*)\((-?\d+)\)", formula)}


def monoisotopic(counts: dict[str, int], elements: dict[str, tuple[list[float], list[float]]]) -> float:
    """Mass of the most abundant isotopes."""
    return sum(n * elements[e][0][max(range(len(elements[e][1])), key=elements[e][1].__getitem__)] for e, n in counts.items())


def isotope_pattern(counts: dict[str, int], elements: dict[str, tuple[list[float], list[float]]], charge: int = 1, least: float = 1e-10) -> list[tuple[float, float]]:
    """(m/z, share) of the isotope peaks at whole mass steps, by repeated squaring of element patterns.

    Patterns hold mean mass and share by nominal step; shares below ``least`` are cut.
    """
    if charge == 0:
        raise ValueError("a pattern needs a charge")

    def fold(a: list, b: list) -> list:
        out: dict[int, list[float]] = {}
        for i, (ma, pa) in enumerate(a):
            for j, (mb, pb) in enumerate(b):
                cell = out.setdefault(i + j, [0.0, 0.0])
                cell[0] += pa * pb * (ma + mb)
                cell[1] += pa * pb
        rows = [(m / p if p else 0.0, p) for m, p in (out.get(k, [0.0, 0.0]) for k in range(max(out) + 1))]
        while len(rows) > 1 and rows[-1][1] < least:
            rows.pop()
        return rows

    total = [(0.0, 1.0)]
    for element, n in counts.items():
        masses, shares = elements[element]
        steps = [(0.0, 0.0)] * (round(masses[-1] - masses[0]) + 1)
        for m, p in zip(masses, shares):
            steps[round(m - masses[0])] = (m, p)
        power = steps
        while n:
            if n & 1:
                total = fold(total, power)
            n >>= 1
            if n:
                power = fold(power, power)
    top = max(p for _, p in total)
    return [((m + charge * PROTON) / abs(charge), p / top) for m, p in total if p >= least]


def peptide_mass(sequence: str, shifts: dict[int, float] | None = None) -> float:
    """MH+ of a sequence with mass shifts by 1-based position; an unknown residue raises KeyError."""
    return sum(RESIDUES["L" if a == "I" else a] for a in sequence) + sum((shifts or {}).values()) + WATER + PROTON
