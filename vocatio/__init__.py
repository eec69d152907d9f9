"""Spark-native matching of people to openings: ingest, normalise, match, rank, learn."""

__version__ = "0.1.0"
