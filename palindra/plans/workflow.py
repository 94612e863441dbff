"""The three stages as plans: clean spectra, pair them, sequence and map the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra import chemistry
from palindra.config import Config
from palindra.functions import peaks as P
from palindra.kernels import pairscore
from palindra.operators import doublets, kernels, mapping, merging, recall, sequencing, statistics
from palindra.operators.lineage import once


#: Fixed value: peaks of a doubly labelled spectrum that are looked at for doublets.
LABELLED_PEAKS = 600


def clean(spectra: DataFrame, cfg: Config | None = None, key: str = "id") -> DataFrame:
    """``spectra`` (with mh and peaks of mz, inten) with cleaned peaks.

    The strongest peaks are read as charge one, the strongest of those lose the precursor's region and get anchor peaks, are scaled, lose
    immonium ions and are thinned out by bins of m/z. Nothing is shuffled but for labelled spectra, whose doublets are merged first (``key``
    names a spectrum) and whose peaks have a third field, label.
    """
    cfg = cfg or Config()
    if cfg.labelled:
        rows = spectra.withColumn("peaks", P.top(F.col("peaks"), max(cfg.keep_peaks, LABELLED_PEAKS)))
        rows = doublets.merged(rows, key, step=cfg.doublet_gap, ratio=cfg.doublet_ratio)
        rows = doublets.deisotoped(rows, cfg.most_charge, cfg.fragment_tolerance, max(cfg.keep_peaks, 350), cfg.final_peaks)
    else:
        rows = spectra.withColumn("peaks", P.top(F.col("peaks"), max(cfg.keep_peaks, 350)))
        rows = kernels.deisotoped(rows, cfg.most_charge, cfg.fragment_tolerance, cfg.final_peaks) if cfg.deisotope else rows.withColumn("peaks", P.top(F.col("peaks"), cfg.final_peaks))
    if cfg.remove_precursor:
        rows = rows.withColumn("peaks", P.trimmed(F.col("peaks"), F.col("mh"), cfg.proton))
        if cfg.anchor_peaks:
            rows = rows.withColumn("peaks", P.anchored(F.col("peaks"), F.col("mh"), cfg.proton, labelled=cfg.labelled))
    rows = rows.withColumns({"_lo": F.array_min(F.transform("peaks", lambda p: p.inten)), "_hi": F.array_max(F.transform("peaks", lambda p: p.inten))})
    more = lambda p: [p.label.alias("label")] if cfg.labelled else []
    scale = F.transform("peaks", lambda p: F.struct(p.mz.alias("mz"), P.scaled(p.inten, F.col("_lo"), F.col("_hi")).alias("inten"), *more(p)))
    rows = rows.withColumn("peaks", scale).drop("_lo", "_hi")
    if cfg.remove_immonium:
        rows = rows.withColumn("peaks", P.without_immonium(F.col("peaks")))
    rows = rows.withColumn("_bins", P.by_bin(F.col("peaks"), cfg.bin_width)).withColumn("peaks", P.top_by_bin(F.col("_bins"), cfg.peaks_per_bin))
    return rows.drop("_bins")


def pair(a: DataFrame, b: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Scored mirror pairs for spectra (id, mh, rt, peaks), with q-values in the decoy mode that has both sides (2).

    In mode 1 the precursors of a are shifted for the recall and the mass range, not for the scores.
    """
    cfg = cfg or Config()
    shifted = a.withColumn("mh", F.col("mh") + pairscore.SHIFT) if cfg.decoy_mode == 1 else a
    found = recall.mirror_candidates(shifted, b, cfg.precursor_tolerance, cfg.precursor_ppm, cfg.rt_window, chemistry.recall_types(cfg.labelled), (cfg.mass_low, cfg.mass_high))
    named = lambda t: t.select("id", F.col("mh").alias("mass"), "peaks")
    scored = kernels.scored_pairs(found, named(a), named(b), cfg.decoy_mode, cfg.labelled)
    return statistics.q_values(scored, "target_p", "decoy_p", ["a_id", "b_id", "mirror_type"]) if cfg.decoy_mode == 2 else scored


def accepted(pairs: DataFrame, cfg: Config | None = None, by: str = "fdr") -> DataFrame:
    """Pairs accepted as targets under the false discovery rate ('fdr'), by p-value and type ('p'), or by the judged type alone ('type')."""
    cfg = cfg or Config()
    if by == "p":
        return pairs.where((F.col("target_p") <= cfg.p_threshold) & (F.col("mirror_type") != 0))
    if by == "type":
        return pairs.where("mirror_type > 0")
    if by != "fdr":
        raise ValueError("pairs are accepted by fdr, p or type")
    return statistics.accepted(pairs, cfg.fdr_threshold)


def sequence(spectra: DataFrame, proteins: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Candidates of cleaned spectra (spectrum, mass, peaks) with their target-decoy tag."""
    cfg = cfg or Config()
    found = kernels.sequenced(spectra, cfg.report_limit)
    both = mapping.with_decoys(proteins)
    places = mapping.locate(found, both).join(both.select("protein_id", "is_decoy"), "protein_id")
    return found.join(mapping.tags(found, places), "sequence", "left")


def best_of(candidates: DataFrame) -> DataFrame:
    """The best candidate of every spectrum."""
    return merging.best(candidates, ["spectrum"], [F.col("rank"), F.col("sequence")])


def sequence_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Candidates (a_id, b_id, mirror_type, rank, sequence, score, aa_scores) of accepted ``pairs`` (a_id, b_id, mirror_type).

    Spectra (id, mh, charge, peaks) come as they were read: anchors are taken from their cleaned peaks, segments are scored on
    all of their peaks of charge one. A negative type, whose top difference was another's, is read as its type.
    """
    cfg = cfg or Config()
    named = pairs.select("a_id", "b_id", "mirror_type", F.concat_ws("@", "a_id", "b_id").alias("pair_id"), F.abs("mirror_type").alias("type_code"))

    def side(spectra: DataFrame, s: str) -> DataFrame:
        used = spectra.join(named.select(F.col(f"{s}_id").alias("id")).distinct(), "id", "left_semi").select("id", "mh", "charge", "peaks")
        plain = lambda peaks: F.transform(peaks, lambda p: F.struct(p.mz.alias("mz"), p.inten.alias("inten")))
        whole = kernels.deisotoped(used, cfg.most_charge, cfg.fragment_tolerance).select("id", F.col("peaks").alias("all"))
        rows = clean(used, cfg).withColumn("peaks", plain("peaks")).join(whole, "id")
        return rows.select(F.col("id").alias(f"{s}_id"), F.col("mh").alias(f"{s}_mass"), F.col("charge").alias(f"{s}_charge"), F.col("peaks").alias(f"{s}_peaks"), F.col("all").alias(f"{s}_all"))

    rows = named.join(side(a, "a"), "a_id").join(side(b, "b"), "b_id")
    found = sequencing.sequenced_pairs(rows, cfg.report_limit)
    return named.join(found, "pair_id").select("a_id", "b_id", "mirror_type", "rank", "sequence", "score", "aa_scores")


def run(a: DataFrame, b: DataFrame, cfg: Config | None = None, stage: int = 3, by: str = "fdr") -> dict[str, DataFrame]:
    """The tables up to a stage: 1 cleaned spectra (a, b), 2 also pairs and accepted, 3 also candidates.

    Spectra are (id, mh, rt, charge, peaks). Every table is a plan of its own; what several of them read is computed once.
    """
    if stage not in (1, 2, 3):
        raise ValueError("stage is 1, 2 or 3")
    cfg = cfg or Config()
    out = {"a": once(clean(a, cfg)), "b": once(clean(b, cfg))}
    if stage > 1:
        out["pairs"] = once(pair(out["a"], out["b"], cfg))
        out["accepted"] = accepted(out["pairs"], cfg, by)
    if stage > 2:
        out["candidates"] = sequence_pairs(out["accepted"], a, b, cfg)
    return out
