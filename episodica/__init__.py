"""Curation of trajectory data on Spark: episodes, action chunks, profiles, samples, scores, repairs and reports."""
