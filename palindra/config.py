"""Run configuration: typed defaults, read from and written to KEY=VALUE text."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Settings of cleaning, recall, scoring and filtering."""

    mass_low: float = 300.0
    mass_high: float = 3500.0
    precursor_tolerance: float = 20.0
    precursor_ppm: bool = True
    fragment_tolerance: float = 20.0
    fragment_ppm: bool = True
    rt_window: float = 10_000.0
    keep_peaks: int = 350
    final_peaks: int = 200
    peaks_per_bin: int = 7
    bin_width: float = 100.0
    deisotope: bool = True
    most_charge: int = 3
    remove_precursor: bool = True
    anchor_peaks: bool = True
    remove_immonium: bool = True
    labelled: bool = False
    doublet_gap: float = 0.036
    doublet_ratio: float = 2.0
    decoy_mode: int = 2
    p_threshold: float = 0.05
    fdr_threshold: float = 0.02
    report_limit: int = 10
    proton: float = 1.00727645224

    def __post_init__(self) -> None:
        if not 0 < self.mass_low < self.mass_high:
            raise ValueError("mass_low must be positive and below mass_high")
        if self.decoy_mode not in (0, 1, 2, 3):
            raise ValueError("decoy_mode is 0, 1, 2 or 3")
        if not self.fragment_ppm:
            raise ValueError("fragment tolerances are in ppm")
        for name in ("most_charge", "doublet_gap", "doublet_ratio", "precursor_tolerance", "fragment_tolerance", "keep_peaks", "final_peaks", "peaks_per_bin", "bin_width", "report_limit"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @classmethod
    def parse(cls, text: str) -> Config:
        """Settings from lines KEY=VALUE; # begins a comment line, ; ends a value. Unknown keys raise ValueError."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            key, _, value = line.partition("=")
            key, value = key.strip().lower(), value.partition(";")[0].strip()
            if key not in kinds:
                raise ValueError(f"unknown setting {key}")
            found[key] = value.lower() in ("1", "true", "yes") if kinds[key] is bool else kinds[key](value)
        return cls(**found)

    def text(self) -> str:
        return "".join(f"{f.name.upper()}={int(v) if isinstance(v := getattr(self, f.name), bool) else v}\n" for f in fields(self))
