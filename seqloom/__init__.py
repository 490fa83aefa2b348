"""Seqloom: a PySpark engine for labelled vector sequences."""
