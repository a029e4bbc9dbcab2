"""Vital-sign style time-series analytics on Spark: per-entity grids, events, segments, features and evaluation."""
