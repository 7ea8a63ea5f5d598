"""Findings analytics on Spark: detect, merge, score, compare, sample, gate."""
