"""Spark jobs for paired mass spectra: cleaning, mirror pairing, scoring, sequencing and mapping."""
