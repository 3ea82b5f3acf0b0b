"""Plumbline: a PySpark-native data-quality and statistical-audit engine."""

__version__ = "0.1.0"
