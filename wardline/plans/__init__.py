"""Whole jobs: enrichment, training, scoring, alerts."""
