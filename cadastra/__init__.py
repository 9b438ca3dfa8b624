"""Cadastra: Spark-native spatial integrity analytics over place records."""

__version__ = "0.1.0"
