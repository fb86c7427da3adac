"""Spark-native analytics over public notices: sources, scalars, operators, plans and streams."""

__version__ = "0.1.0"
